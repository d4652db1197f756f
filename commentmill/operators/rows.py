"""Row-level projections, predicates, sampling, paging and edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentmill.functions import lexicons as lex
from commentmill.functions.cut import materialized
from commentmill.functions.numbers import draw_hex
from commentmill.functions.text import as_text, is_blank, strip

DERIVED = ("clean_text", "augmented_text", "processed_text")  # newest version first
SCAN_COLUMNS = ("has_profanity", "profanity_count", "profanity_matches")
PAGE_ROWS = 500
SINGLE_TEXT_LIMIT = 12_000
TOXIC_FROM = 20


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add the 1-based position of each row, without a global window or an RDD.

    Position = rows in earlier partitions + place in its own partition. A shuffle may deal rows
    to other partitions when it is planned again, so the tagged rows are written to reliable
    storage once, and both the counts and the positions are read from there. A row whose
    partition has no count is an error, never dropped.
    """
    spark = df.sparkSession
    tagged = materialized(df.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    counts = sorted(tagged.groupBy(part.alias("p")).count().collect())  # one line per partition
    offsets, before = [], 0
    for p, n in counts:
        offsets.append((p, before))
        before += n
    starts = spark.createDataFrame(offsets, "_part bigint, _before bigint")
    placed = tagged.withColumn("_part", part).join(F.broadcast(starts), "_part", "left")
    start = F.when(F.col("_before").isNull(), F.raise_error(F.lit("a partition without an offset"))
                   .cast("bigint")).otherwise(F.col("_before"))
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, start + inside + 1).drop("_mid", "_part", "_before")


def active_text_column(df: DataFrame, chosen: str) -> str:
    """The most derived version of the text that is present."""
    return next((c for c in DERIVED if c in df.columns), chosen)


def drop_stale(df: DataFrame, step: str) -> DataFrame:
    """Drop the versions derived from an older text than the one ``step`` produces."""
    later = {"processed_text": ("augmented_text", "clean_text", "clean_replacements"),
             "augmented_text": ("clean_text", "clean_replacements")}
    return df.drop(*later.get(step, ()))


def fill_text(df: DataFrame, *cols: str) -> DataFrame:
    """Null cells become empty text."""
    return df.withColumns({c: as_text(F.col(c)) for c in cols})


def blank_counts(df: DataFrame, text_col: str) -> DataFrame:
    """All rows, and the blank ones that are skipped."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(is_blank(as_text(F.col(text_col)))).alias("skipped"))


def without_blank(df: DataFrame, text_col: str) -> DataFrame:
    return df.filter(~is_blank(as_text(F.col(text_col))))


def truncate_text(df: DataFrame, text_col: str, limit: int = SINGLE_TEXT_LIMIT) -> DataFrame:
    """Trimmed text cut to ``limit`` characters, and whether it was cut."""
    full = df.withColumn("_full", strip(as_text(F.col(text_col))))
    return full.withColumns({"text_cut": F.substring("_full", 1, limit),
                             "was_cut": F.length("_full") > limit}).drop("_full")


def preview(text: Column, length: int = 180, *, tabs: bool = True) -> Column:
    """Start of the text on one line."""
    return F.substring(F.translate(text, "\n\t" if tabs else "\n", "  "), 1, length)


def preview_page(df: DataFrame, text_col: str, page: int = 0, *, row_id: str = "row_id",
                 size: int = PAGE_ROWS) -> DataFrame:
    """One page of the text that later steps would use: newline shown as ``\\n``, tab as space.

    Pages are ranges of the row id, so a page is a filter, not an offset."""
    shown = active_text_column(df, text_col)
    flat = F.translate(F.replace(as_text(F.col(shown)), F.lit("\n"), F.lit("\\n")), "\t", " ")
    return page_of(df, page, row_id=row_id, size=size).select(row_id, flat.alias(shown))


def page_of(df: DataFrame, page: int, *, row_id: str = "row_id",
            size: int = PAGE_ROWS) -> DataFrame:
    return df.filter(F.col(row_id).between(size * page + 1, size * (page + 1)))


def page_count(df: DataFrame, size: int = PAGE_ROWS) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.greatest(
        F.lit(1), F.ceil(n / size)).cast("bigint").alias("pages"))


def preview_columns(columns: Sequence[str], text_col: str) -> list[str]:
    """Scan columns hidden, the text and its versions first."""
    shown = [c for c in columns if c not in SCAN_COLUMNS]
    order = [text_col, "processed_text", "augmented_text", "clean_text", "clean_replacements"]
    first = [c for c in dict.fromkeys(order) if c in shown]
    return first + [c for c in shown if c not in first]


def apply_edits(base: DataFrame, edits: DataFrame, *, row_id: str, text_col: str,
                label_col: str | None = None,
                edited_page: int | None = None, size: int = PAGE_ROWS) -> DataFrame:
    """Overwrite editable columns of the rows named in ``edits``; the label never changes.

    With ``edited_page``, rows of that page that ``edits`` leaves out become empty text.
    """
    allowed = {text_col, "processed_text", "augmented_text", "clean_text", "clean_replacements"}
    names = [c for c in edits.columns if c in allowed and c in base.columns
             and c not in (label_col, row_id)]
    patch = edits.select(F.col(row_id), F.lit(True).alias("_edited"),
                         *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = base.join(patch, row_id, "left")
    touched = F.coalesce(F.col("_edited"), F.lit(False))
    if edited_page is not None:
        touched = touched | F.col(row_id).between(size * edited_page + 1, size * (edited_page + 1))
    new = {c: F.when(touched, F.coalesce(F.col(f"_new_{c}"), F.lit(""))).otherwise(F.col(c))
           for c in names}
    return joined.withColumns(new).select(*base.columns) if new else base


def is_toxic(scores: Mapping[str, Column] | None = None, *, overall: Column | None = None,
             limit: int = TOXIC_FROM) -> Column:
    """Any of the six scores, and the overall score where given, reaches the limit."""
    cols = list((scores or {c: F.col(c) for c in lex.SCORE_FIELDS}).values())
    return F.greatest(*cols, *([] if overall is None else [overall])) >= limit


def severity_band(overall: Column) -> Column:
    """low below 35, medium below 70, else high; the score is clamped to 0..100 first."""
    o = F.least(F.greatest(overall, F.lit(0)), F.lit(100))
    return F.when(o < 35, "low").when(o < 70, "medium").otherwise("high")


def scores_line(overall: Column, scores: Mapping[str, Column] | None = None) -> Column:
    """``Overall: n% | Toxicity: n% | ...`` in the fixed order."""
    cols = scores or {c: F.col(c) for c in lex.SCORE_FIELDS}
    named = [("Overall", overall)] + [(lex.SCORE_TITLES[c], cols[c]) for c in lex.SCORE_FIELDS]
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{n}: "), c.cast("string"), F.lit("%"))
                                for n, c in named])


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. ``min_by`` combines on the map side, so one hot key costs
    one row per task in the shuffle."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


# --- exact selection by hash -----------------------------------------------------------


def hash_cuts(df: DataFrame, quotas: DataFrame, *, group: str, draw: str = "_draw") -> DataFrame:
    """Per group, the draw of the row that fills its quota: ``draw <= cut`` selects exactly
    ``quota`` rows.

    No group is sorted as a whole: a count per (group, five hex digits) finds the stretch of
    hashes in which the quota is reached, and only that stretch is ranked.
    """
    prefix = F.substring(draw, 1, 5)
    counts = df.groupBy(group, prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(group).orderBy("_p")
    upto = counts.withColumn("_to", F.sum("_n").over(running))
    edge = (upto.join(quotas, group)
            .filter((F.col("_to") >= F.col("quota")) & (F.col("_to") - F.col("_n") < F.col("quota")))
            .select(group, "_p", (F.col("quota") - F.col("_to") + F.col("_n")).alias("_need")))
    inside = df.select(group, draw, prefix.alias("_p")).join(edge, [group, "_p"])
    ranked = inside.withColumn("_rk", F.row_number().over(
        Window.partitionBy(group, "_p").orderBy(draw)))
    return ranked.filter(F.col("_rk") == F.col("_need")).select(group, F.col(draw).alias("cut"))


def with_draw(df: DataFrame, key: str, seed: int, op: str) -> DataFrame:
    """A per-row hash, made distinct by the key itself."""
    k = F.col(key).cast("string")
    return df.withColumn("_draw", F.concat(draw_hex(seed, k, op), F.lit(":"), k))


def sample_rows(df: DataFrame, n: int, *, key: str = "row_id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if there are fewer), the same ones every time, in key order.

    Rows that share a key are drawn by their other columns too; only rows equal in every column
    tie, and any of those is the same row."""
    if n < 1:
        raise ValueError("ask for one row at least")
    if n >= df.count():
        return df.orderBy(key)
    whole = F.concat("_draw", F.lit(":"), F.hex(F.xxhash64(*df.columns)))
    drawn = with_draw(df, key, seed, "sample").withColumns({"_draw": whole, "_all": F.lit(1)})
    quota = df.sparkSession.createDataFrame([(1, n)], "_all int, quota bigint")
    cut = hash_cuts(drawn, quota, group="_all").first()["cut"]
    below = drawn.filter(F.col("_draw") < cut)
    ties = drawn.filter(F.col("_draw") == cut).limit(n - below.count())
    return below.unionByName(ties).orderBy(key).drop("_draw", "_all")
