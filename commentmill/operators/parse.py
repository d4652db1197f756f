"""Reading a scorer's raw answers: JSON recovery, validation and normalisation.

JSON is held as Spark ``variant`` values, so that a number, a string and an array in the same
field stay apart: strict rules such as "a score may be 65 or "65" but not true" need that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentmill.functions import lexicons as lex
from commentmill.functions.text import as_text, bind, strip, text_map

# How a row object and a result object begin.
ROW_START = r'\{\s*"row_id"\s*:'
RESULT_START = r'\{\s*"(?:overall_score|scores|category)"\s*:'


def allow_repeated_keys(spark: SparkSession) -> None:
    """Of a key repeated in one object the last value counts, in JSON parsed from now on. Without
    this setting Spark takes such an object for no JSON at all."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


#: What a walk over JSON looks at: an escape, a quote, a brace, or a stretch of anything else.
_STEPS = r'\\[\s\S]?|["{}]|[^"{}\\]+'


def _balanced(tail: Column) -> Column:
    """The object a text begins with, nested to any depth, braces in strings skipped; null if it
    does not end. One walk over quotes, braces, escapes and the stretches between them."""
    start = F.struct(F.lit(0).alias("open"), F.lit(False).alias("quoted"), F.lit(0).alias("read"),
                     F.lit(False).alias("done"))

    def step(s: Column, piece: Column) -> Column:
        # a backslash escapes in strings only; elsewhere what follows it counts
        ch = F.when(F.substring(piece, 1, 1) != "\\", piece).when(s["quoted"], "").otherwise(F.substring(piece, 2, 1))
        depth = s["open"] + F.when(s["quoted"], 0).when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(
            depth.alias("open"), F.when(ch == '"', ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["read"] + F.length(piece)).alias("read"), (depth == 0).alias("done")))

    return F.aggregate(_all(tail, _STEPS, 0), start, step, lambda s: F.when(
        s["done"], F.substring(tail, F.lit(1), s["read"])))


def objects_starting(text: Column, start: str) -> Column:
    """Every complete object that begins as given, also inside one that never closes. Each start
    is walked on its own; an answer has few of them, as a batch has few rows."""

    def found(parts: Column) -> Column:
        tails = F.transform(parts, lambda p, i: F.when(p.rlike(rf"\A{start}"), F.array_join(
            F.slice(parts, i + 1, F.size(parts) - i), "")))
        return F.array_compact(F.transform(F.array_compact(tails), _balanced))

    return bind(F.split(text, f"(?={start})"), found)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strict_json(text: Column) -> Column:
    """The text as one JSON value; null when it is not JSON or something follows the value.

    The built-in parser stops after the first complete value. Text that closes an enclosing
    array early cannot also close an enclosing object, so it has to survive inside both.
    """
    inside_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    inside_array = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(inside_object.isNotNull(), bind(
        inside_array, lambda one: F.when(F.size(one) == 1, F.get(one, F.lit(0)))))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (JSON null) or a number type; null if missing."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_object(v: Column) -> Column:
    """Tested by a cast: describing the type of a large value would walk all of it."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _no_variants() -> Column:
    return F.array().cast("array<variant>")


def items(v: Column) -> Column:
    """The elements of an array variant; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def as_string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


# --- containers ------------------------------------------------------------------------


def row_list(doc: Column) -> Column:
    """An array, or the ``results`` array of an object; null otherwise."""
    return F.coalesce(items(doc), items(field(doc, "results")))


def row_id_of(obj: Column) -> Column:
    """Whole-number row id; fractions are cut, numeric text is accepted, else null."""
    return F.try_variant_get(obj, "$.row_id", "bigint")


def salvage_rows(text: Column) -> Column:
    """Every complete row object of a cut-off answer, the first one of each row id."""
    objs = F.filter(F.transform(objects_starting(text, ROW_START), F.try_parse_json),
                    lambda v: row_id_of(v).isNotNull())

    def firsts(found: Column) -> Column:
        ids = F.transform(found, row_id_of)
        return bind(ids, lambda known: F.filter(
            found, lambda v, i: F.array_position(known, row_id_of(v)) == i + 1))

    return bind(objs, firsts)


def parse_rows(raw: Column) -> Column:
    """Row objects of one batch answer, null when nothing can be read.

    In order: the widest ``[...]``, the whole text, an object with ``results``, then salvage.
    """

    def read(t: Column) -> Column:
        bracketed = strict_json(F.regexp_extract(t, r"(?s)\[.*\]", 0))
        return F.coalesce(bind(bracketed, row_list), bind(strict_json(t), row_list), bind(
            salvage_rows(t), lambda some: F.when(F.size(some) > 0, some)))

    return bind(strip(as_text(raw)), read)


def completed_row_ids(raw: Column) -> Column:
    """Sorted distinct row ids whose objects are complete."""
    ids = F.transform(F.transform(objects_starting(as_text(raw), ROW_START), F.try_parse_json), row_id_of)
    return F.sort_array(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))


def has_complete_container(raw: Column, opening: str) -> Column:
    """Does the first container that starts with ``opening`` close? Brackets in strings do not
    count. One walk over the characters with (open stack, in string, escaped, verdict)."""
    closing = {"[": "]", "{": "}"}
    text = as_text(raw)
    tail = F.substring(text, F.instr(text, opening), F.length(text))
    start = F.struct(F.lit("").alias("stack"), F.lit(False).alias("quoted"),
                     F.lit(False).alias("escaped"), F.lit(0).alias("verdict"))

    def state(stack, quoted, escaped, verdict) -> Column:
        return F.struct(stack.alias("stack"), quoted.alias("quoted"),
                        escaped.alias("escaped"), verdict.alias("verdict"))

    def step(s: Column, ch: Column) -> Column:
        stack, no, zero = s["stack"], F.lit(False), F.lit(0)
        top = F.substring(stack, -1, 1)
        popped = F.substring(stack, F.lit(1), F.length(stack) - 1)
        opened = F.try_element_at(text_map(closing), ch)
        in_string = state(stack, s["escaped"] | (ch != '"'), ~s["escaped"] & (ch == "\\"), zero)
        closed = F.when(top != ch, state(stack, no, no, F.lit(-1))).otherwise(
            state(popped, no, no, F.when(F.length(stack) == 1, F.lit(1)).otherwise(zero)))
        return (F.when(s["verdict"] != 0, s)
                .when(s["quoted"], in_string)
                .when(ch == '"', state(stack, F.lit(True), no, zero))
                .when(opened.isNotNull(), state(F.concat(stack, opened), no, no, zero))
                .when(ch.isin("]", "}"), closed)
                .otherwise(s))

    done = F.aggregate(F.split(tail, ""), start, step, lambda s: s["verdict"] == 1)
    return F.when(F.instr(text, opening) == 0, F.lit(False)).otherwise(done)


# --- one free-form result --------------------------------------------------------------

_UNION_IN_ARRAY = (
    r'(?s)((?:"(?:category|toxicity_type)"\s*:\s*\[|(?!\A)\G)[^\]]*?)"\s*\|\s*"(?=[^\]]*\])'
)


def repair_unions(blob: Column) -> Column:
    """``"A" | "B"`` inside the two name arrays becomes ``"A", "B"``."""
    return F.regexp_replace(blob, _UNION_IN_ARRAY, '$1", "')


# What an answer that repeats its instructions contains, and the patterns of the
# fields that are picked out of text that is not JSON.
def looks_like_schema_echo(raw: Column) -> Column:
    """Did the scorer repeat its instructions instead of answering?"""
    return F.lower(raw).contains("allowed_categories") | (
        raw.rlike(r'"tasks"\s*:\s*\[') & (F.length(raw) > 500))


def loose_fields(raw: Column) -> Column:
    """Level, name arrays and explanation picked out of text that is not JSON."""

    def found(pattern: str) -> Column:
        return F.get(_all(raw, pattern), F.lit(0))

    def names(key: str) -> Column:
        inner = F.coalesce(found(rf'(?s)"{key}"\s*:\s*\[(.*?)\]\s*(?:,|\}})'),
                           found(rf'(?s)"{key}"\s*:\s*\[(.*?)\]'))
        quoted = F.filter(_all(inner, r'"([^"]*)"'), lambda q: strip(q) != "")
        return F.when(F.size(quoted) > 0, quoted)

    said = F.coalesce(found(r'(?s)"explanation"\s*:\s*"(.*?)"\s*\}\s*\z'),
                      found(r'(?s)"explanation"\s*:\s*"(.*)"'))
    return F.struct(found(r'"toxicity_level"\s*:\s*"([^"]*)"').alias("toxicity_level"),
                    names("category").alias("category"),
                    names("toxicity_type").alias("toxicity_type"),
                    strip(said).alias("explanation"))


def _says_something(loose: Column) -> Column:
    return (F.coalesce(loose["toxicity_level"], F.lit("")) != "") \
        | loose["category"].isNotNull() | (F.coalesce(loose["explanation"], F.lit("")) != "")


def parse_single(raw: Column) -> Column:
    """One result object as a variant; null when nothing can be read.

    Candidates, last found first, then the whole text and the widest ``{...}``; each as it is
    and with repaired unions. After that the loose fields of the candidates.
    """

    def read(t: Column) -> Column:
        widest = F.regexp_extract(t, r"(?s)\{.*\}", 0)
        return bind(objects_starting(t, RESULT_START), lambda found: choose(t, widest, found))

    def choose(t: Column, widest: Column, found: Column) -> Column:
        blobs = F.concat(F.reverse(found), F.array(t, widest))
        tries = F.flatten(F.transform(blobs, lambda b: F.array(b, repair_unions(b))))
        strict = F.filter(F.transform(tries, strict_json), is_object)
        last = F.array(F.when(widest != "", widest).otherwise(t))
        loose = F.filter(F.transform(F.concat(F.reverse(found), last), loose_fields),
                         _says_something)
        return F.coalesce(F.get(strict, F.lit(0)),
                          F.to_variant_object(F.get(loose, F.lit(0))))

    return bind(strip(as_text(raw)), read)


# --- validation ------------------------------------------------------------------------


def score(v: Column) -> Column:
    """A whole number from 0 to 100, also as text or as 65.0; anything else is null."""
    text = F.trim(as_string(v))
    numeric = ~kind(v).isin("BOOLEAN", "VOID", "OBJECT", "ARRAY") & text.rlike(
        r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z")
    x = F.when(numeric, text.try_cast("double"))
    return F.when((x == F.floor(x)) & x.between(0, 100), x.cast("int"))


def six_scores(v: Column) -> dict[str, Column]:
    """The six scores of an object with all six keys or of an array of exactly six."""
    values = items(v)
    out = {}
    for i, name in enumerate(lex.SCORE_FIELDS):
        by_place = F.when(F.size(values) == len(lex.SCORE_FIELDS), F.get(values, F.lit(i)))
        out[name] = F.coalesce(score(field(v, name)), score(by_place))
    return out


def _texts(v: Column, *, cut: bool) -> Column:
    """Trimmed non-empty strings of a list or of (comma-separated) text."""
    listed = F.transform(items(v), lambda x: strip(F.coalesce(as_string(x), F.lit("None"))))
    said = F.split(as_string(v), ",") if cut else F.array(as_string(v))
    out = F.coalesce(listed, F.transform(said, strip))
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.filter(out, lambda x: x != ""))


def _one_of(x: Column, allowed: Sequence[str]) -> Column:
    return F.try_element_at(text_map({a.lower(): a for a in allowed}), F.lower(x))


def name_list(v: Column, allowed: Sequence[str], fallback: Sequence[str]) -> Column:
    """Allowed names in any case, distinct, in order; the fallback when none is left."""
    known = F.array_distinct(F.filter(
        F.transform(_texts(v, cut=True), lambda x: _one_of(x, allowed)),
        lambda x: x.isNotNull()))
    return F.when(F.size(known) > 0, known).otherwise(F.array(*map(F.lit, fallback)))


def level(v: Column, allowed: Sequence[str] = lex.LEVELS, fallback: str = "Low") -> Column:
    return F.coalesce(_one_of(strip(as_string(v)), allowed), F.lit(fallback))


def type_name(x: Column) -> Column:
    """Exact name, else a near miss: any "threat", or "identity" with "attack", or spellings."""
    key = F.lower(x)
    identity = (key.contains("identity") & key.contains("attack")) | (key == "id attack")
    return F.coalesce(_one_of(x, lex.TOXICITY_TYPES),
                      F.when(key.contains("threat"), F.lit("Threat"))
                      .when(identity, F.lit("Identity Attack")))


def type_list(v: Column) -> Column:
    """Known types, distinct, in order; a list of 7 or more says nothing and is emptied."""
    known = F.coalesce(F.array_distinct(F.filter(F.transform(_texts(v, cut=True), type_name),
                                                 lambda x: x.isNotNull())),
                       F.array().cast("array<string>"))
    limit = max(5, len(lex.TOXICITY_TYPES) - 2)
    return F.when(F.size(known) >= limit, F.array().cast("array<string>")).otherwise(known)


# The category that stands for a type, most serious first.
CATEGORY_OF_TYPE = (
    (("threat",), "Threats"),
    (("identity attack",), "Harassment"),
    (("bullying",), "Harassment"),
    (("graphic violence",), "Violence"),
    (("extremist language", "political abuse"), "Political Extremism"),
    (("religious intolerance",), "Religious Hate"),
    (("profanity",), "Profanity"),
    (("insult",), "Harassment"),
)


def category_from_types(v: Column) -> Column:
    """One category for an answer that listed (almost) all of them."""
    said = F.transform(_texts(v, cut=False), F.lower)
    out = F.lit(None).cast("string")
    for keys, name in reversed(CATEGORY_OF_TYPE):
        hit = F.coalesce(F.arrays_overlap(said, F.array(*map(F.lit, keys))), F.lit(False))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("None"))


def analyses(df: DataFrame, obj: str = "obj") -> DataFrame:
    """Add the validated analysis of a row object: ``overall_score``, six scores,
    ``category``, ``toxicity_level``, ``toxicity_type``, ``explanation`` and ``error``.

    ``error`` is null for a valid row. Scores are never derived from labels.
    """
    o = F.col(obj)
    types = F.when(field(o, "toxicity_type").isNull()
                   & items(field(o, "toxicity_types")).isNotNull(), field(o, "toxicity_types")) \
        .otherwise(field(o, "toxicity_type"))
    read = df.withColumn("_types", types).withColumn("_scores", field(o, "scores")).withColumn(
        "_cats", name_list(field(o, "category"), lex.CATEGORIES, ["None"]))
    read = read.withColumns({
        "overall_score": score(field(o, "overall_score")),
        **six_scores(F.col("_scores")),
        "category": F.when(F.size("_cats") >= 9, F.array(category_from_types(F.col("_types"))))
        .otherwise(F.col("_cats")),
        "toxicity_level": level(field(o, "toxicity_level")),
        "toxicity_type": type_list(F.col("_types")),
        "explanation": strip(F.coalesce(as_string(field(o, "explanation")), F.lit(""))),
    })
    shape = F.when(~(is_object(F.col("_scores")) | F.coalesce(
        F.size(items(F.col("_scores"))) == 6, F.lit(False))),
        F.lit("scores must be an object or an array of six"))
    bad = [F.when(F.col(c).isNull(), F.lit(f"score '{c}' is missing or not a whole number 0-100"))
           for c in (*lex.SCORE_FIELDS, "overall_score")]
    nothing = F.when(o.isNull(), F.lit("no scored result was returned"))
    return read.withColumn("error", F.coalesce(nothing, shape, *bad)).drop("_types", "_scores", "_cats")


def expected_rows(df: DataFrame, raw_col: str = "raw", ids_col: str = "row_ids") -> DataFrame:
    """One line per expected row of each batch: ``row_id`` and ``obj``, the first object of
    that id or null. Objects of other ids are dropped. Ids of a batch are few, so this is a
    look-up inside the row and shuffles nothing."""
    read = df.withColumn("_rows", F.coalesce(parse_rows(F.col(raw_col)), _no_variants()))
    known = read.withColumn("_ids", F.transform("_rows", row_id_of))
    one = known.select(*df.columns, "_rows", "_ids", F.explode(ids_col).alias("row_id"))
    place = F.array_position("_ids", F.col("row_id")).cast("int")
    return one.withColumn("obj", F.when(place > 0, F.get("_rows", place - 1))).drop("_rows", "_ids")


def explode_rows(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """One line per parsed object: ``pos``, ``obj``, ``row_id``. Unreadable answers give one
    line with ``unreadable`` true."""
    parsed = df.withColumn("_rows", parse_rows(F.col(raw_col)))
    lines = parsed.select(*df.columns, F.col("_rows").isNull().alias("unreadable"),
                          F.posexplode_outer("_rows").alias("pos", "obj"))
    return lines.withColumn("row_id", row_id_of(F.col("obj")))
