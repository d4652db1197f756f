"""Scan and sanitise with a lexicon that is a table: 100,000 terms or more.

The plan does not grow with the lexicon. A text is cut into runs of word characters. A direct hit is a run
equal to a term or to a term with a suffix, so every distinct run of the table is looked up once, as it is
and without each suffix it ends in. Letters with separators between them spell a term exactly where
neighbouring runs, put together, equal it: from each run on, runs are joined up to the length of the longest
term, and the distinct strings that come out are looked up too. Neither the words of the rows nor the forms
of the lexicon are written: rows meet what the table as a whole was found to hold, where they stand. Look-ups
and the strings that runs spell are taken for many rows at once, in Arrow arrays; patterns are run only on
rows with letters whose case they compare otherwise, or where what is put in may spell a term.

Results are those of ``profanity.scan`` and ``profanity.sanitize``, for terms of letters and digits; any
other term is an error here. Upper case is compared by ``lower``, also where a pattern that ignores case
would fold more (dotless i, long s, Kelvin sign). Null texts are empty; repeated rows stay; terms are trimmed, made
lower-case and taken once; an empty lexicon finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentmill.functions import lexicons as lex
from commentmill.functions.cut import materialized, spread
from commentmill.functions.hot import join_keys
from commentmill.functions.text import W, WORD, as_text, bind, replacement_quote
from commentmill.operators.profanity import undisguise

#: What the texts hold of the lexicon is sent to every task up to this many bytes and lines; beyond, words
#: and lines are joined by a shuffle, with hot words apart.
BROADCAST_BYTES, BROADCAST_LINES = 64 << 20, 1_000_000

#: Strings that a task holds before it passes them on; runs or pieces that are looked at together.
HELD_STRINGS, RUNS_AT_ONCE = 1_000_000, 500_000

#: Letters at the edge of a term by which most strings are told from terms, and how many edges are sent.
EDGE, EDGES = 4, 500_000

#: Characters that a pattern that ignores case takes for no others than ``lower`` does, so that strings put
#: together from lower-cased runs are found exactly where patterns find them.
REGULAR = (r"\x00-\xb4\xb6-\u012f\u0132-\u0148\u014a-\u017e\u0180-\u01ef\u01f1-\u024f\u0400-\u0481\u048a-\u04ff"
           r"\u05d0-\u06ff\u0900-\u097f\u0e00-\u0e7f\u2000-\u20bf\u2190-\u23ff\u2500-\u27bf\u3000-\u9fff\uac00-\ud7a3"
           r"\uff01-\uff20\x{1F300}-\x{1FAFF}")

_GAP = r"[^\p{L}\p{N}]*"
HITS = "array<struct<i:int,to:int,term:string,phrase:string>>"
TODO = "array<struct<term:string,phrase:string>>"
_LINE = [("term", pa.string()), ("phrase", pa.string())]
HITS_ARROW, TODO_ARROW = (pa.list_(pa.struct(fields)) for fields in ([("i", pa.int32()), ("to", pa.int32()), *_LINE], _LINE))
_SPELT = r"\A[\p{L}\p{N}]+\z"


def lexicon(terms: DataFrame) -> DataFrame:
    """(term, phrase) of a table with the column ``term`` and, at will, ``phrase``: the smallest one
    given for the term, or null. Terms that are not letters and digits only are an error."""
    phrase = F.col("phrase") if "phrase" in terms.columns else F.lit(None)
    known = materialized(
        terms.select(F.lower(F.trim("term")).alias("term"), phrase.cast("string").alias("phrase"))
        .filter("term != ''").groupBy("term").agg(F.min("phrase").alias("phrase")))
    odd = known.filter(~F.col("term").rlike(_SPELT)).select("term").first()
    if odd:
        raise ValueError(f"a lexicon table takes terms of letters and digits, not {odd['term']!r}")
    return known


def _known_of(tried: DataFrame, known: DataFrame) -> DataFrame:
    """Inner join with the lexicon by ``term``. Few lines go to the lexicon, which then stays where it is."""
    tried = materialized(tried)
    return known.join(F.broadcast(tried) if tried.count() <= BROADCAST_LINES else tried, "term")


def _forms(runs: DataFrame, known: DataFrame) -> DataFrame:
    """(form, term, phrase): the distinct runs that are a term or a term with a suffix; of several terms
    the shortest."""
    form = F.col("form")
    stems = [F.when(form.endswith(s) & (F.length(form) > len(s)), F.left(form, F.length(form) - len(s)))
             for s in lex.PROFANITY_SUFFIXES if s.isalpha()]
    tried = runs.distinct().select("form", F.explode(F.array_compact(F.array(form, *stems))).alias("term"))
    return materialized(_known_of(tried, known).groupBy("form").agg(F.min(F.struct("term", "phrase")).alias("t"))
                        .select("form", "t.*"))


def _few(table: DataFrame, key: str) -> bool:
    lines, size = table.agg(F.count("*"), F.sum(F.octet_length(key) * 2 + F.coalesce(
        F.octet_length("phrase"), F.lit(0)))).first()
    return lines <= BROADCAST_LINES and (size or 0) <= BROADCAST_BYTES


def _sent(table: DataFrame) -> Broadcast:
    """A table of few lines, for every task."""
    return table.sparkSession.sparkContext.broadcast(table.toArrow())


# W and NOT_W, with the commonest of them as ranges, which are tried first.
_RUN = rf"[a-zA-Z0-9{WORD}]++"
_REST = rf"[ -/\x00-\x1f:-@\x5b-\x5e`\x7b-\x7f[^a-zA-Z0-9{WORD}]]++"


def _pieces(text: Column) -> Column:
    """Runs of word characters and what stands between them; together they are the text."""
    return F.regexp_extract_all(text, F.lit(f"{_RUN}|{_REST}"), F.lit(0))


def _is_run(piece: Column) -> Column:
    return piece.rlike(rf"\A{W}")


def _runs(text: Column) -> Column:
    """The distinct runs of a row, in lower case."""
    runs = F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))
    return F.explode(F.array_distinct(F.transform(runs, F.lower))).alias("form")


def _bare_pieces(bare: Column) -> Column:
    """The pieces of an undisguised text: runs of letters and figures with single spaces between them."""
    return F.split(bare, " ")


def _row_stretches(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Neighbouring rows whose lists hold ``RUNS_AT_ONCE`` values at most; a longer one stands alone."""
    ends, lo = np.append(0, pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).cumsum()), 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + RUNS_AT_ONCE, "right")) - 1)
        yield lo, hi
        lo = hi


def _column(table: pa.Table, name: str) -> pa.Array:
    return table[name].combine_chunks()


def _places(forms: Broadcast):
    """The direct hits among the lower-cased pieces of a row, as (i, to, term, phrase)."""
    def found(rows: pa.ListArray, form: pa.Array, term: pa.Array, phrase: pa.Array) -> pa.Array:
        pieces, first = rows.flatten(), np.append(0, pc.list_value_length(rows).to_numpy(zero_copy_only=False).cumsum())
        which = pc.index_in(pieces, value_set=form)
        at = np.flatnonzero(which.is_valid().to_numpy(zero_copy_only=False))
        which = which.take(pa.array(at))
        row = np.searchsorted(first, at, "right") - 1
        to, own = at.copy(), pc.equal(form.take(which), term.take(which)).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(own & (at + 2 < first[row + 1])):
            if pieces[int(at[k]) + 1].as_py() == "'" and pieces[int(at[k]) + 2].as_py() == "s":
                to[k] += 2
        kept, past = np.ones(len(at), bool), -1
        for k in np.flatnonzero((to > at) | np.append(False, at[1:] <= to[:-1])):
            if at[k] <= past:  # the s of a hit before it
                kept[k] = False
            else:
                past = to[k]
        at, to, row, which = at[kept], to[kept], row[kept], which.filter(pa.array(kept))
        hits = pa.StructArray.from_arrays([pa.array((at - first[row]).astype(np.int32)), pa.array((to - first[row]).astype(np.int32)),
                                           term.take(which), phrase.take(which)], ["i", "to", "term", "phrase"])
        offsets = np.searchsorted(row, np.arange(len(rows) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), hits).cast(HITS_ARROW)

    @F.arrow_udf(HITS)
    def place(rows: pa.Array) -> pa.Array:
        form, term, phrase = (_column(forms.value, c).cast(pa.string()) for c in ("form", "term", "phrase"))
        rows = pc.if_else(rows.is_valid(), rows, pa.scalar([], rows.type)) if rows.null_count else rows
        parts = [found(rows.slice(lo, hi - lo), form, term, phrase) for lo, hi in _row_stretches(rows)]
        return pa.concat_arrays(parts) if parts else pa.array([], HITS_ARROW)

    # see augment._token_udf: the input is a column of its own, and named twice
    return lambda c: F.when(F.size(c) == 0, F.array().cast(HITS)).otherwise(place.asNondeterministic()(c))


def _direct(pieces: DataFrame, forms: DataFrame) -> DataFrame:
    """(_row, _hits): of each row with ``_pieces`` the direct hits in order, as (i, to, term, phrase),
    from piece i to piece ``to``. A term itself takes a following 's with it."""
    def near(i: Column) -> Column:
        return F.coalesce(F.get("_pieces", i), F.lit(""))

    # only what a run needs to know goes on with it, not the row's other pieces
    placed = F.filter(F.transform("_pieces", lambda p, i: F.struct(
        i.alias("i"), F.lower(p).alias("form"), (F.lower(F.concat(near(i + 1), near(i + 2))) == "'s").alias("possessive"))),
        lambda x: _is_run(x["form"]))
    words = pieces.select("_row", F.inline(placed))
    to = F.when(F.col("possessive") & (F.col("form") == F.col("term")), F.col("i") + 2).otherwise(F.col("i"))
    found = join_keys(words, forms, "form").groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("i", to.alias("to"), "term", "phrase"))).alias("all"))

    def next_hit(kept: Column, hit: Column) -> Column:
        inside = F.coalesce(F.element_at(kept, -1)["to"] >= hit["i"], F.lit(False))
        return F.when((F.size(kept) > 0) & inside, kept).otherwise(F.array_append(kept, hit))

    none = F.filter("all", lambda _: F.lit(False))
    return found.select("_row", F.aggregate("all", none, lambda kept, hit: F.when(
        F.size(kept) == 0, F.array(hit)).otherwise(next_hit(kept, hit))).alias("_hits"))


def _with_hits(rows: DataFrame, forms: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """The rows, which are written and have a ``_row``, with a column of direct hits for each list of pieces."""
    if _few(forms, "form"):
        place = _places(_sent(forms))
        out = rows.withColumns({f"_l{name}": F.transform(t, F.lower) for name, t in texts.items()})
        return out.withColumns({name: place(F.col(f"_l{name}")) for name in texts}).drop(*[f"_l{name}" for name in texts])
    out = rows
    for name, pieces in texts.items():
        hits = _direct(rows.select("_row", pieces.alias("_pieces")), forms)
        out = out.join(hits.withColumnRenamed("_hits", name), "_row", "left")
    return out


def _numbered(df: DataFrame, text_col: str) -> DataFrame:
    """The rows with a number each, and their text; written, which fixes the numbers."""
    return materialized(spread(df).withColumn("_text", as_text(F.col(text_col)))
                        .withColumn("_row", F.monotonically_increasing_id()))


def _no_terms() -> Column:
    return F.array().cast("array<string>")


def scan_table(df: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """``profanity.scan`` with a table of terms: adds ``profanity_matches`` (distinct terms in order of
    the first hit, raw text before undisguised text), ``has_profanity`` and ``profanity_count``."""
    known = lexicon(terms)
    numbered = _numbered(df, text_col)
    text = F.col("_text")
    texts = {"_raw": _pieces(text), "_bare": _bare_pieces(undisguise(text))}
    raw, bare = numbered.select(_runs(text)), numbered.select(F.explode(F.array_distinct(texts["_bare"])).alias("form"))
    found = _with_hits(numbered, _forms(raw.unionByName(bare), known), texts)
    matches = F.array_distinct(F.concat(*[F.coalesce(F.col(c)["term"], _no_terms()) for c in texts]))
    return (found.withColumn("profanity_matches", matches).withColumns({
        "has_profanity": F.size("profanity_matches") > 0, "profanity_count": F.size("profanity_matches")})
        .drop("_row", "_text", *texts))


def _spelt_by(runs: list[str], longest: int) -> set[str]:
    """What neighbouring runs spell together, up to a length. A hit does not begin or end at an
    underscore, which is a word character and a separator."""
    found = set()
    for i, first in enumerate(runs):
        if first[0] == "_":
            continue
        word = ""
        for at in range(i, len(runs)):
            run = runs[at]
            word += run.replace("_", "")
            if len(word) > longest:
                break
            if run[-1] != "_":
                found.add(word)
    return found


def _spelt_runs() -> Column:
    return F.regexp_extract_all(F.lower("_clean"), F.lit(_RUN), F.lit(0))


def _spelt(rows: DataFrame, longest: int) -> DataFrame:
    """(_row, term): what each row's present text spells. Growing strings step by step in Python took half
    the time that nested lambdas of array functions took (10.9 and 20.6 s in one task over 2.4 MB)."""
    cut = rows.select("_row", _spelt_runs().alias("runs"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, own in zip(batch.column("_row"), batch.column("runs"), strict=True):
                words = list(_spelt_by(own.as_py(), longest))
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(words), pa.int64()),
                                                  pa.array(words, pa.string())], ["_row", "term"])

    return cut.mapInArrow(spell, "_row bigint, term string")


def _begins(words: pa.Array) -> pa.Array:
    return pc.utf8_slice_codeunits(words, 0, EDGE)


def _spellings(runs: pa.Array, row: np.ndarray, longest: int, edges: tuple[pa.Array, pa.Array] | None,
               shortest: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """What ``_spelt_by`` finds in the runs of many rows, as (first run, last run, strings): first what single
    runs spell, then two, and so on. ``edges``: how terms begin and end; strings that begin otherwise do not
    grow, and those that end otherwise are left out."""
    bare = pc.replace_substring(runs, "_", "")
    size = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    starts, ends = (~f(runs, "_").to_numpy(zero_copy_only=False) for f in (pc.starts_with, pc.ends_with))
    first = np.flatnonzero(starts & (size <= longest))
    last, length, word = first, size[first], bare.take(pa.array(first))
    while len(first):
        whole = ends[last] & (length >= shortest)
        if edges:
            known = pc.is_in(_begins(word), value_set=edges[0]).to_numpy(zero_copy_only=False)
            whole &= known
            grows = np.flatnonzero(known | (length < EDGE))
            if len(grows) < len(first):
                first, last, length, whole = first[grows], last[grows], length[grows], whole[grows]
                word = word.take(pa.array(grows))
        some = np.flatnonzero(whole)
        found = word.take(pa.array(some))
        if edges:
            also = np.flatnonzero(pc.is_in(pc.utf8_slice_codeunits(found, -EDGE), value_set=edges[1]).to_numpy(zero_copy_only=False))
            some, found = some[also], found.take(pa.array(also))
        yield first[some], last[some], found
        more = np.flatnonzero(last + 1 < len(row))
        more = more[(row[last[more] + 1] == row[first[more]]) & (length[more] + size[np.minimum(last[more] + 1, len(row) - 1)] <= longest)]
        first, last = first[more], last[more] + 1
        length = length[more] + size[last]
        word = pc.binary_join_element_wise(word.take(pa.array(more)), bare.take(pa.array(last)), "")


def _flat_runs(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    return lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def _edges(known: DataFrame) -> Broadcast | None:
    """The distinct beginnings and ends of the terms, if there are few."""
    both = known.select(F.explode(F.array(*[F.struct(F.lit(i).alias("side"), f("term", F.lit(EDGE)).alias("edge"))
                                            for i, f in enumerate((F.left, F.right))])).alias("e")).select("e.*").distinct()
    some = both.limit(EDGES + 1).toArrow()
    return known.sparkSession.sparkContext.broadcast(some) if some.num_rows <= EDGES else None


def _edge_sets(edges: Broadcast | None) -> tuple[pa.Array, pa.Array] | None:
    if edges is None:
        return None
    side, edge = edges.value["side"].combine_chunks(), _column(edges.value, "edge").cast(pa.string())
    return tuple(edge.filter(pc.equal(side, i)) for i in range(2))


def _edges_of(terms: pa.Array) -> tuple[pa.Array, pa.Array]:
    return pc.unique(_begins(terms)), pc.unique(pc.utf8_slice_codeunits(terms, -EDGE))


def _spelt_terms(rows: DataFrame, edges: Broadcast | None, shortest: int, longest: int) -> DataFrame:
    """(term): the distinct strings that the rows spell, of lengths that terms have, and that begin and end as
    terms do. Most repetitions stay in the task."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = pa.array([], pa.string()), _edge_sets(edges)
        for batch in batches:
            runs = batch.column("runs")
            for lo, hi in _row_stretches(runs):
                new = [pc.unique(w) for *_, w in _spellings(
                    *_flat_runs(runs.slice(lo, hi - lo)), longest, known, shortest)]
                found = pc.unique(pa.concat_arrays([found, *new]))
                if len(found) > HELD_STRINGS:
                    yield pa.RecordBatch.from_arrays([found], ["term"])
                    found = found.slice(0, 0)
        yield pa.RecordBatch.from_arrays([found], ["term"])

    return rows.select(_spelt_runs().alias("runs")).mapInArrow(spell, "term string").distinct()


def _spelt_hits(rows: DataFrame, found: Broadcast, longest: int) -> DataFrame:
    """The rows that spell a term of ``found`` whose turn is still to come, with these as ``_todo``."""
    cut = rows.select("_row", "_clean", "_replaced", "_last", _spelt_runs().alias("runs"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = dict(zip(found.value["term"].to_pylist(), found.value["phrase"].to_pylist()))
        terms = _column(found.value, "term").cast(pa.string())
        edges = _edges_of(terms)
        for batch in batches:
            spelt = [set() for _ in range(batch.num_rows)]
            for lo, hi in _row_stretches(batch.column("runs")):
                runs, row = _flat_runs(batch.column("runs").slice(lo, hi - lo))
                for first, _, word in _spellings(runs, row, longest, edges):
                    some = np.flatnonzero(pc.is_in(word, value_set=terms).to_numpy(zero_copy_only=False))
                    for r, t in zip(row[first[some]] + lo, word.take(pa.array(some)).to_pylist()):
                        spelt[r].add(t)
            todo = []
            for own, done, last in zip(spelt, batch.column("_replaced"), batch.column("_last"), strict=True):
                gone, past = set(done.as_py()) if own else (), last.as_py()
                todo.append([{"term": t, "phrase": phrases[t]} for t in sorted(own) if t > past and t not in gone])
            some = pa.array([bool(t) for t in todo], pa.bool_())
            cols = ["_row", "_clean", "_replaced", "_last"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(todo, TODO_ARROW)],
                                             [*cols, "_todo"]).filter(some)

    return cut.mapInArrow(spell, f"_row bigint, _clean string, _replaced array<string>, _last string, _todo {TODO}")


PUT = "struct<text:string,done:array<string>>"


def _masked(found: Broadcast, longest: int, mask_token: str):
    """(pieces, the runs among them in lower case, whether the first piece is one, terms replaced before) -> the
    text with its spelt terms masked in their order, and all terms replaced. For masks that no spelt term can
    reach into, and regular texts."""
    def part(pieces: pa.ListArray, runs: pa.ListArray, begins: pa.Array, gone: list[list[str]], terms: pa.Array,
             edges: tuple) -> pa.Array:
        flat, first = pieces.flatten(), np.append(0, pc.list_value_length(pieces).to_numpy(zero_copy_only=False).cumsum())
        key, row = _flat_runs(runs)  # every second piece is a run
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        place = first[row] + ~begins.to_numpy(zero_copy_only=False).astype(bool)[row] + 2 * nth
        hits: dict[int, list[tuple[str, int, int]]] = {}
        for start, end, word in _spellings(key, row, longest, edges):
            some = np.flatnonzero(pc.is_in(word, value_set=terms).to_numpy(zero_copy_only=False))
            for r, t, i, j in zip(row[start[some]].tolist(), word.take(pa.array(some)).to_pylist(),
                                  place[start[some]].tolist(), place[end[some]].tolist()):
                hits.setdefault(r, []).append((t, i, j))
        masked, blank, done = np.zeros(len(flat), bool), np.zeros(len(flat), bool), [list(g) for g in gone]
        for r, own in hits.items():
            before = set(gone[r])
            for t, i, j in sorted(own):  # a term's places from left to right
                if t not in before and not (masked[i:j + 1].any() or blank[i:j + 1].any()):
                    masked[i], blank[i + 1:j + 1] = True, True
                    if done[r][-1:] != [t]:
                        done[r].append(t)
        new = pc.if_else(pa.array(masked), pa.scalar(mask_token), pc.if_else(pa.array(blank), pa.scalar(""), flat)).cast(pa.large_string())
        at = np.frombuffer(new.buffers()[1], np.int64)[new.offset:][first]  # put together: fewer cuts
        text = pa.LargeStringArray.from_buffers(len(pieces), pa.py_buffer(np.ascontiguousarray(at)), new.buffers()[2]).cast(pa.string())
        return pa.StructArray.from_arrays([text, pa.array(done, pa.list_(pa.string()))], ["text", "done"])

    @F.arrow_udf(PUT)
    def put(pieces: pa.Array, runs: pa.Array, begins: pa.Array, gone: pa.Array) -> pa.Array:
        terms = _column(found.value, "term").cast(pa.string())
        edges = _edges_of(terms)
        parts = [part(*(c.slice(lo, hi - lo) for c in (pieces, runs, begins)), gone.slice(lo, hi - lo).to_pylist(), terms, edges)
                 for lo, hi in _row_stretches(pieces)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("text", pa.string()), ("done", pa.list_(pa.string()))]))

    # see augment._token_udf: the input is a column of its own, and named twice
    return lambda pieces, runs, begins, gone: F.when(F.size(pieces) == 0, F.struct(
        F.lit("").alias("text"), gone.alias("done"))).otherwise(put.asNondeterministic()(pieces, runs, begins, gone))


def _pattern(term: Column) -> Column:
    """The letters of a term with anything but letters and digits between them."""
    return F.concat(F.lit(f"(?iu)(?<!{W})"), F.array_join(F.split(term, ""), _GAP), F.lit(f"(?!{W})"))


def _candidates(rows: DataFrame, known: DataFrame, edges: Broadcast | None, shortest: int, longest: int) -> DataFrame:
    """The rows whose present text spells terms with separators, and these in order (``_todo``), but for
    terms already replaced and those whose turn is over."""
    met = materialized(_known_of(_spelt_terms(rows, edges, shortest, longest), known))
    if _few(met, "term"):
        return _spelt_hits(rows, _sent(met), longest)
    found = join_keys(_spelt(rows, longest), met, "term").groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("term", "phrase"))).alias("_todo"))
    return (rows.join(found, "_row").withColumn("_todo", F.filter("_todo", lambda t: (
        t["term"] > F.col("_last")) & ~F.array_contains("_replaced", t["term"]))).filter(F.size("_todo") > 0))


def _replace_spelt(rows: DataFrame, put: Column) -> DataFrame:
    """Every term of ``_todo`` replaced in turn; later terms see earlier output."""
    def step(s: Column, hit: Column) -> Column:
        rx = _pattern(hit["term"])
        text = put(hit)
        new = F.struct(F.regexp_replace(s["text"], rx, text).alias("text"),
                       F.array_append(s["done"], hit["term"]).alias("done"))
        return F.when(F.regexp_like(s["text"], rx), new).otherwise(s)

    start = F.struct(F.col("_clean").alias("text"), F.col("_replaced").alias("done"))
    return rows.withColumn("_s", F.aggregate("_todo", start, step)).select(
        "_row", F.col("_s.text").alias("_clean"), F.col("_s.done").alias("_replaced"),
        F.element_at("_todo", -1)["term"].alias("_last"))


def sanitize_table(df: DataFrame, text_col: str, terms: DataFrame, *, mask_token: str = lex.MASK_TOKEN) -> DataFrame:
    """``profanity.sanitize`` with a table of terms: adds ``clean_text`` and ``clean_replacements``. A term's
    ``phrase`` takes its place where the table gives one, the mask elsewhere.

    Direct hits go first, then separated terms in their order. Where all that is put in is a mask whose
    letters no term has inside, a replacement cannot make up a new hit, and all terms of a row go in one
    pass; else each pass takes the first term of every row that still has one, and looks again.
    """
    known = lexicon(terms)
    facts = known.agg(F.min(F.length("term")).alias("shortest"), F.max(F.length("term")).alias("longest"),
                       F.count("phrase").alias("phrases")).first()
    shortest, longest = facts["shortest"] or 1, facts["longest"] or 1
    core = "".join(c for c in mask_token if c.isalnum()).lower()
    settled = bool(core) and not facts["phrases"] and known.filter(F.contains("term", F.lit(core))).isEmpty()

    def put(hit: Column) -> Column:
        return F.coalesce(hit["phrase"], F.lit(mask_token))

    def quoted(hit: Column) -> Column:
        return F.coalesce(F.regexp_replace(hit["phrase"], r"([\\$])", r"\\$1"), F.lit(replacement_quote(mask_token)))

    numbered = _numbered(df, text_col)
    forms = _forms(numbered.select(_runs(F.col("_text"))), known)

    def cut(pieces: Column) -> Column:
        def stretch(hit: Column, j: Column) -> Column:
            """What stands before a hit, from the hit before it, and what is put in."""
            start = F.coalesce(F.get("_hits", j - 1)["to"] + 1, F.lit(0))
            return F.concat(F.array_join(F.slice(pieces, start + 1, hit["i"] - start), ""), put(hit))

        past = F.coalesce(F.get("_hits", F.size("_hits") - 1)["to"] + 1, F.lit(0))
        rest = F.array_join(F.slice(pieces, past + 1, F.size(pieces)), "")
        return F.concat(F.array_join(F.transform("_hits", stretch), ""), rest)

    direct = _with_hits(numbered, forms, {"_hits": _pieces(F.col("_text"))}).withColumns({
        "_clean": F.when(F.size("_hits") > 0, bind(_pieces(F.col("_text")), cut)).otherwise(F.col("_text")),
        "_replaced": F.coalesce(F.array_distinct(F.col("_hits")["term"]), _no_terms())}).drop("_text", "_hits")
    direct = materialized(direct)

    odd, edges = F.col("_clean").rlike(f"[^{REGULAR}]"), _edges(known)
    masked = None
    if settled and re.fullmatch(r"[^\w]*[A-Za-z0-9]+[^\w]*", mask_token):
        met = materialized(_known_of(_spelt_terms(direct, edges, shortest, longest), known))
        if _few(met, "term") and met.filter(F.col("term").rlike(f"[^{REGULAR}]")).isEmpty():
            masked = _masked(_sent(met), longest, mask_token)
    now = direct.select("_row", "_clean", "_replaced", F.lit("").alias("_last"))
    if masked:  # where they stand; patterns are left for the other rows
        now = now.filter(odd)
        def of(strings: Column) -> Column:
            return F.when(F.col("_odd"), F.array().cast("array<string>")).otherwise(strings)

        direct = direct.withColumn("_odd", odd).withColumns({
            "_pieces": of(_pieces(F.col("_clean"))), "_runs": of(_spelt_runs()), "_begins": _is_run(F.col("_clean"))})
        direct = direct.withColumn("_new", masked(*(F.col(c) for c in ("_pieces", "_runs", "_begins", "_replaced"))))
        direct = direct.withColumns({"_clean": F.when(F.col("_odd"), F.col("_clean")).otherwise(F.col("_new.text")),
                                     "_replaced": F.col("_new.done")}).drop("_pieces", "_runs", "_begins", "_odd", "_new")
    done = []
    while not (masked and now.isEmpty()):
        todo = materialized(_candidates(now, known, edges, shortest, longest))
        if todo.isEmpty():
            break
        if not settled:
            todo = todo.withColumn("_todo", F.slice("_todo", 1, 1))
        now = materialized(_replace_spelt(todo, quoted))
        done.append(now.withColumn("_pass", F.lit(len(done))))
        if settled:
            break
    out = direct.withColumnsRenamed({"_clean": "clean_text", "_replaced": "clean_replacements"})
    if not done:
        return out.drop("_row")
    later = done[0]
    for more in done[1:]:
        later = later.unionByName(more)
    later = later.groupBy("_row").agg(F.max_by(F.struct("_clean", "_replaced"), "_pass").alias("_new"))
    return out.join(later, "_row", "left").withColumns({
        "clean_text": F.coalesce("_new._clean", "clean_text"),
        "clean_replacements": F.coalesce("_new._replaced", "clean_replacements")}).drop("_row", "_new")
