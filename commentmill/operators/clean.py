"""Text cleaning. Every step is a column expression; a configured clean is one projection."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentmill.functions import lexicons as lex
from commentmill.functions.cut import materialized
from commentmill.functions.text import (
    BOUNDARY, NOT_WS, PUNCT, SPACE, W, WORD, WS, as_text, in_words, text_map, tokens, within,
)

PROCESSED = "processed_text"


@dataclass(frozen=True)
class CleanConfig:
    """Which cleaning steps run; the order is fixed and does not depend on this."""

    lowercase: bool = False
    remove_punctuation: bool = False
    remove_stopwords: bool = False
    remove_numbers: bool = False
    normalize_whitespace: bool = False
    normalize_unicode: bool = False
    remove_noise: bool = False
    reduce_elongations: bool = False
    map_slang: bool = False
    expand_contractions: bool = False

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]


# Characters that NFKC leaves alone wherever they stand (quick-check "yes", combining
# class 0). Text made only of these never travels to Python.
NFKC_STABLE = (
    r"\x00-\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131"
    r"\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0482\u048a-\u04ff\u2010\u2012-\u2016"
    r"\u2018-\u2023\u2030-\u2032\u20a0-\u20a7\u20a9-\u20c0\u3001-\u3029\u4e00-\u9fff\uac00-\ud7a3"
)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


# Declared non-deterministic (it is not) so that the optimizer never folds it into the
# nested lambdas of a later step, where Spark cannot run Python. Filter before this step.
_nfkc = _nfkc.asNondeterministic()


def normalize_unicode(col: Column) -> Column:
    """NFKC. Spark has no built-in for it; rows that cannot change are sent as null."""
    needs = F.when(col.rlike(within(r"\u0080-\x{10ffff}", f"^{NFKC_STABLE}")), col)
    return F.coalesce(_nfkc(needs), col)


QUOTE_FENCE = within(r"\"\u00ab-\uff02", lex.QUOTE_GLYPHS) + "{2,}"


def strip_invisible(col: Column) -> Column:
    return F.regexp_replace(col, within(r"\u00ad-\uffff", lex.INVISIBLE), "")


def collapse_quote_fences(col: Column) -> Column:
    return F.regexp_replace(col, QUOTE_FENCE, " ")


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, "<[^>]{1,2000}>", " ")


def strip_urls(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?iu)https?://{NOT_WS}+|www\.{NOT_WS}+", " ")


def strip_emails(col: Column) -> Column:
    # the boundary before one of the first characters, told by that character; no way back from the at sign
    start = f"(?:(?={W})(?<!{W})|(?=[.%+-])(?<={W}))"
    return F.regexp_replace(
        col, rf"{start}[{WORD}.%+-]++@[{WORD}.-]+\.[A-Za-z]{{2,63}}{BOUNDARY}", " ")


def strip_mentions(col: Column) -> Column:
    return F.regexp_replace(col, f"@{W}{{1,80}}(?!{W})", " ")


def unhash_hashtags(col: Column) -> Column:
    return F.regexp_replace(col, f"#({W}{{1,80}})(?!{W})", "$1")


def drop_stray_hashes(col: Column) -> Column:
    return F.regexp_replace(col, f"#+(?={W})", " ")


def strip_retweet_prefix(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?iu)\A{WS}*rt{WS}+[:@]?{WS}*", " ")


def collapse_bangs(col: Column) -> Column:
    return F.regexp_replace(col, "[!?]{3,}", " ")


NOISE_STEPS = (
    strip_tags, strip_urls, strip_emails, strip_mentions, unhash_hashtags, drop_stray_hashes,
    strip_retweet_prefix, collapse_bangs,
)


def remove_noise(col: Column) -> Column:
    for step in NOISE_STEPS:
        col = step(col)
    return col


def reduce_elongations(col: Column) -> Column:
    return F.regexp_replace(col, r"([A-Za-z])\1{2,}", "$1$1")


def lowercase(col: Column) -> Column:
    return F.lower(col)


_CORE = rf"{W}[{WORD}']*+"
_TRAIL = rf"(?=[^{WORD}{SPACE}]*+(?:{WS}|\z))"
_PIECE = rf"[^{WORD}{SPACE}]++(?={_CORE}{_TRAIL})|{_CORE}{_TRAIL}|{WS}+|{NOT_WS}+"


def map_tokens(col: Column, phrases: Mapping[str, str]) -> Column:
    """Replace whole tokens by phrases, keeping outer punctuation and the spacing.

    The text is cut into pieces that join back to it. Where a token is word characters and
    inner apostrophes with punctuation around it, that core is a piece of its own; other
    tokens stay whole, so they match no key. Each piece then costs one hash probe, and the
    literal map, whose look-up is linear, is read after a hit only.
    """
    reachable = {k: v for k, v in phrases.items() if re.fullmatch(r"\w[\w']*", k)}
    if not reachable:
        return col
    table = text_map(reachable)

    def replace(piece: Column) -> Column:
        key = F.lower(piece)
        return F.when(in_words(key, reachable), F.try_element_at(table, key)).otherwise(piece)

    pieces = F.regexp_extract_all(col, F.lit(_PIECE), F.lit(0))
    return F.array_join(F.transform(pieces, replace), "")


#: Tokens that are sent to every task: so many bytes and lines at most, the commonest first.
SENT_BYTES, SENT_LINES = 64 << 20, 1_000_000
#: A token without a phrase is worth sending if it is in so many rows; steps of the count, per doubling.
OFTEN, STEPS = 16, 8
#: Pieces whose phrases are looked up at once.
PIECES_AT_ONCE = 1 << 21


def _core_tokens(pieces: Column) -> Column:
    """The pieces in lower case, null where a piece is not a token that can have a phrase."""
    return F.transform(pieces, lambda p: F.when(p.rlike(rf"\A{_CORE}\z"), F.lower(p)))


def _looked_up(pieces: pa.ListArray, keys: pa.ListArray, words: list[tuple[pa.Array, pa.Array]]) -> pa.Array:
    """Each row's pieces put together, with the phrase of a piece where one of ``words`` has its key."""
    out, ends = [], np.append(0, pc.list_value_length(pieces).to_numpy(zero_copy_only=False).cumsum())
    lo = 0
    while lo < len(pieces):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECES_AT_ONCE, "right")) - 1)
        own, key = pieces.slice(lo, hi - lo).flatten().cast(pa.large_string()), keys.slice(lo, hi - lo).flatten()
        found = [phrase.take(pc.index_in(key, value_set=token)) for token, phrase in words]
        new = pc.coalesce(*found, own)
        at = np.frombuffer(new.buffers()[1], np.int64)[new.offset:][ends[lo:hi + 1] - ends[lo]]  # put together: fewer cuts
        out.append(pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(at), new.buffers()[2]).cast(pa.string()))
        lo = hi
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _lines(sent: Broadcast) -> tuple[pa.Array, pa.Array]:
    return tuple(sent.value[c].combine_chunks().cast(kind) for c, kind in (("_token", pa.string()), ("_phrase", pa.large_string())))


def _phrases_put(sent: Broadcast):
    """(pieces, tokens[, found]) -> text: phrases of the words that are sent and of those a row brings."""
    @F.arrow_udf(T.StringType())
    def common(pieces: pa.Array, keys: pa.Array) -> pa.Array:
        return _looked_up(pieces, keys, [_lines(sent)])

    @F.arrow_udf(T.StringType())
    def both(pieces: pa.Array, keys: pa.Array, token: pa.Array, phrase: pa.Array) -> pa.Array:
        own = token.flatten(), phrase.flatten().cast(pa.large_string())  # a token has one phrase in all rows
        return _looked_up(pieces, keys, [_lines(sent), own])

    # see augment._token_udf: the input is a column of its own, and named twice
    return lambda pieces, *rest: F.when(F.size(pieces) == 0, F.lit("")).otherwise(
        (both if len(rest) > 1 else common).asNondeterministic()(pieces, *rest))


def _common(met: DataFrame) -> Column:
    """Which lines of (_token, _phrase, _n) are sent: all that have a phrase if these are few, else the commonest."""
    size = F.octet_length("_token") + F.coalesce(F.octet_length("_phrase"), F.lit(0))
    step = F.floor(F.log2("_n") * STEPS)
    steps = met.groupBy(step.alias("step")).agg(
        F.count("*").alias("lines"), F.sum(size).alias("bytes"), F.count("_phrase").alias("known"),
        F.coalesce(F.sum(F.when(F.col("_phrase").isNotNull(), size)), F.lit(0)).alias("known_bytes")).collect()
    if sum(r["known"] for r in steps) <= SENT_LINES and sum(r["known_bytes"] for r in steps) <= SENT_BYTES:
        return F.col("_phrase").isNotNull()
    least, lines, held = None, 0, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        lines, held = lines + r["lines"], held + r["bytes"]
        if lines > SENT_LINES or held > SENT_BYTES:
            break
        least = r["step"]
    return F.lit(False) if least is None else step >= least


def map_tokens_table(df: DataFrame, text_col: str, phrases: DataFrame, output: str = PROCESSED) -> DataFrame:
    """``map_tokens`` with a (token, phrase) table of any size; adds ``output``.

    The tokens that the texts hold are counted and meet the table. The commonest go to every task, where
    rows are rebuilt; if that is all that have a phrase, no row moves. Else the others, distinct tokens of
    distinct texts, are joined with the table, and what is found comes back as one list per text, no longer
    than the text. Texts are known by a hash, and two with one hash only share their lists, which does no
    harm. ``df`` is read up to three times and must give the same rows; it is not written.

    Missing texts are empty. Tokens of the table are compared in lower case; of a token that is listed
    twice the smallest phrase counts; lines without token or phrase are left out. Equal rows stay.
    """
    known = (phrases.select(F.lower("token").alias("_token"), F.col("phrase").cast("string").alias("_phrase")).dropna()
             .groupBy("_token").agg(F.min("_phrase").alias("_phrase")))
    text = as_text(F.col(text_col))
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    tokens_of = F.array_distinct(F.array_compact(_core_tokens(pieces)))
    counts = df.select(F.explode(tokens_of).alias("_token")).groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    met = materialized(counts.join(known, "_token", "left").filter(F.col("_phrase").isNotNull() | (F.col("_n") >= OFTEN)))
    common = _common(met)
    sent = df.sparkSession.sparkContext.broadcast(met.filter(common).select("_token", "_phrase").toArrow())
    rare = met.filter(~common & F.col("_phrase").isNotNull()).select("_token", "_phrase")
    put, rest = _phrases_put(sent), []
    rows = df.withColumn("_text", text)
    if not rare.isEmpty():
        def not_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = _lines(sent)[0]
            for batch in batches:
                keys = batch.column("_tokens")
                row = pc.list_parent_indices(keys)
                some = pc.invert(pc.is_in(keys.flatten(), value_set=words))
                yield pa.RecordBatch.from_arrays([batch.column("_hash").take(row.filter(some)), keys.flatten().filter(some)],
                                                 ["_hash", "_token"])

        others = df.select(F.xxhash64(text).alias("_hash"), tokens_of.alias("_tokens")).mapInArrow(
            not_sent, "_hash bigint, _token string")
        found = others.join(rare, "_token").groupBy("_hash").agg(
            F.collect_set(F.struct("_token", "_phrase")).alias("_found"))
        rows = rows.withColumn("_hash", F.xxhash64("_text")).join(found, "_hash", "left")
        rest = [F.col("_found._token"), F.col("_found._phrase")]
    cut = rows.withColumn("_pieces", F.regexp_extract_all("_text", F.lit(_PIECE), F.lit(0)))
    cut = cut.withColumn("_keys", _core_tokens(F.col("_pieces")))
    own = dict.fromkeys([*df.columns, output])
    return cut.withColumn(output, put(F.col("_pieces"), F.col("_keys"), *rest)).select(*[F.col(f"`{c}`") for c in own])


def token_phrases(cfg: CleanConfig, slang: Mapping[str, str] | None = None,
                  contractions: Mapping[str, str] | None = None) -> dict[str, str]:
    """The look-up of one token pass; a contraction wins over a slang entry."""
    out: dict[str, str] = {}
    if cfg.map_slang:
        out.update(lex.SLANG if slang is None else slang)
    if cfg.expand_contractions:
        out.update(lex.CONTRACTIONS if contractions is None else contractions)
    return out


def remove_punctuation(col: Column) -> Column:
    return F.regexp_replace(col, f"[{PUNCT}]+", "")


def remove_numbers(col: Column) -> Column:
    return F.regexp_replace(col, r"\p{Nd}+", "")


def remove_stopwords(col: Column, stop_words: Iterable[str] = lex.STOP_WORDS) -> Column:
    stop = list(stop_words)
    return F.array_join(F.filter(tokens(col), lambda t: ~in_words(F.lower(t), stop)), " ")


def normalize_whitespace(col: Column) -> Column:
    # single spaces, the most of them, stay as they are
    return F.trim(F.regexp_replace(col, rf"[\x00-\x1f\x85-\u3000&&[{SPACE}]]{WS}*+| {WS}++", " "))


def blank_to_empty(col: Column) -> Column:
    return F.regexp_replace(col, rf"\A{WS}+\z", "")


def clean_expr(col: Column, cfg: CleanConfig, *, stop_words: Iterable[str] = lex.STOP_WORDS,
               slang: Mapping[str, str] | None = None,
               contractions: Mapping[str, str] | None = None) -> Column:
    """All configured steps as one nested expression. Switched-off steps are not in the plan;
    the removal of invisible characters and quote fences always is."""
    out = as_text(col)
    if cfg.normalize_unicode:
        out = normalize_unicode(out)
    out = collapse_quote_fences(strip_invisible(out))
    if cfg.remove_noise:
        out = remove_noise(out)
    if cfg.reduce_elongations:
        out = reduce_elongations(out)
    if cfg.lowercase:
        out = lowercase(out)
    out = map_tokens(out, token_phrases(cfg, slang, contractions))
    if cfg.remove_punctuation:
        out = remove_punctuation(out)
    if cfg.remove_numbers:
        out = remove_numbers(out)
    if cfg.remove_stopwords:
        out = remove_stopwords(out, stop_words)
    return normalize_whitespace(out) if cfg.normalize_whitespace else blank_to_empty(out)


def clean(df: DataFrame, text_col: str, cfg: CleanConfig, *, output: str = PROCESSED,
          **lists) -> DataFrame:
    """Add the cleaned text. A newly cleaned version invalidates what was derived later."""
    stale = [c for c in ("augmented_text", "clean_text", "clean_replacements") if c != text_col]
    expr = clean_expr(F.col(text_col), cfg, **lists)
    return df.withColumn(output, expr).drop(*stale)
