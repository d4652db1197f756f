"""Dataset text statistics and the cleaning steps they suggest: one pass, one output row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from commentmill.functions import lexicons as lex
from commentmill.functions.numbers import ratio, round_digits
from commentmill.functions.text import (
    DIGIT_LIKE, PUNCT, SPACE, W, WORD, WS, as_text, count_matching, in_words, tokens, within,
)
from commentmill.operators.clean import QUOTE_FENCE, CleanConfig

# statistic -> per-row flag it averages
ROW_FLAGS = {
    "messy_whitespace_ratio": "messy_whitespace",
    "rows_with_url_like": "url_like",
    "rows_with_mentions": "mention",
    "rows_with_html_angle_tags": "angle_tag",
    "rows_with_char_elongations": "elongation",
    "rows_with_multi_quote_fences": "quote_fence",
    "rows_with_punctuation_only": "punctuation_only",
    "rows_with_heavy_punctuation": "heavy_punctuation",
    "rows_with_repeated_punctuation": "repeated_punctuation",
    "rows_with_slang_hint_tokens": "slang_hint",
}
CHAR_SHARES = {
    "uppercase_ratio": "n_upper",
    "punctuation_ratio": "n_punct",
    "digit_ratio": "n_digit",
    "non_ascii_ratio": "n_non_ascii",
}
STATISTICS = [*CHAR_SHARES, "avg_stopword_ratio", *ROW_FLAGS]


def row_measures(text: Column, toks: Column, stop_words: Iterable[str] = lex.STOP_WORDS,
                 slang_hints: Iterable[str] = lex.SLANG_HINTS) -> dict[str, Column]:
    """Per-row counts and flags of one text column and its token array."""
    stop, hints = list(stop_words), list(slang_hints)
    punct = count_matching(text, f"[{PUNCT}]")
    solid = F.length(F.regexp_replace(text, f"{WS}+", ""))
    edges = r"\A[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+\z"
    return {
        "n_chars": F.length(text),
        "n_upper": count_matching(text, r"[\p{IsUppercase}]"),
        "n_punct": punct,
        "n_digit": count_matching(
            text, within(r"0-9\u00b2-\x{10ffff}", DIGIT_LIKE)),
        "n_non_ascii": count_matching(text, r"[\u0080-\x{10ffff}]"),
        "n_solid": solid,
        "n_tokens": F.size(toks),
        "n_stop": F.size(F.filter(toks, lambda t: in_words(F.lower(t), stop))),
        "messy_whitespace": text.rlike(f"{WS}{{2,}}|\n|\t"),
        "url_like": text.rlike(r"(?iu)https?://|www\."),
        "mention": text.rlike(f"@{W}"),
        "angle_tag": text.rlike("<[^>]{1,2000}>"),
        "elongation": text.rlike(r"([^\n])\1{2,}"),
        "quote_fence": text.rlike(QUOTE_FENCE),
        "repeated_punctuation": text.rlike(f"[^{WORD}{SPACE}]{{3}}"),
        "slang_hint": F.exists(
            toks, lambda t: in_words(F.regexp_replace(F.lower(t), edges, ""), hints)),
    }


def measure_rows(df: DataFrame, text_col: str, **lists) -> DataFrame:
    """Add the per-row measures, three of them built on others."""
    split_once = df.withColumn("_text", as_text(F.col(text_col))).withColumn(
        "_tokens", tokens(F.col("_text")))
    measured = split_once.withColumns(
        row_measures(F.col("_text"), F.col("_tokens"), **lists)).drop("_text", "_tokens")
    solid, punct = F.col("n_solid"), F.col("n_punct")
    return measured.withColumns({
        "punctuation_only": (solid > 0) & (punct == solid),
        "heavy_punctuation": (solid >= 4) & (punct >= 4)
        & (punct / F.greatest(solid, F.lit(1)) >= 0.30),
        "stop_share": F.when(F.col("n_tokens") > 0,
                             F.col("n_stop") / F.greatest(F.col("n_tokens"), F.lit(1))),
    })


def text_statistics(df: DataFrame, text_col: str, **lists) -> DataFrame:
    """One row of unrounded statistics plus the row count. No rows: all ratios are 0."""
    m = measure_rows(df.select(text_col), text_col, **lists)
    chars = F.greatest(F.coalesce(F.sum("n_chars"), F.lit(0)), F.lit(1))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [(F.coalesce(F.sum(src), F.lit(0)) / chars).alias(name)
             for name, src in CHAR_SHARES.items()]
    aggs.append(F.coalesce(F.avg("stop_share"), F.lit(0.0)).alias("avg_stopword_ratio"))
    aggs += [ratio(F.count_if(flag), F.count(F.lit(1))).alias(name)
             for name, flag in ROW_FLAGS.items()]
    return m.agg(*aggs)


def decisions() -> dict[str, Column]:
    """Suggested steps from the unrounded statistics; the limits are fixed values."""
    c = F.col
    rules = {
        "lowercase": c("uppercase_ratio") > 0.08,
        "remove_punctuation": (c("punctuation_ratio") > 0.05)
        | (c("rows_with_punctuation_only") >= 0.005)
        | (c("rows_with_heavy_punctuation") >= 0.02)
        | (c("rows_with_repeated_punctuation") >= 0.02),
        "remove_stopwords": c("avg_stopword_ratio") > 0.35,
        "remove_numbers": c("digit_ratio") > 0.03,
        "normalize_whitespace": c("messy_whitespace_ratio") > 0.20,
        "normalize_unicode": c("non_ascii_ratio") > 0.015,
        "remove_noise": (c("rows_with_url_like") > 0.02) | (c("rows_with_mentions") > 0.03)
        | (c("rows_with_html_angle_tags") > 0.02) | (c("rows_with_multi_quote_fences") > 0.015),
        "reduce_elongations": c("rows_with_char_elongations") > 0.06,
        "map_slang": c("rows_with_slang_hint_tokens") > 0.12,
        "expand_contractions": c("rows_with_slang_hint_tokens") > 0.08,
    }
    return {name: rule & (c("n_rows") > 0) for name, rule in rules.items()}


def suggest_cleaning(df: DataFrame, text_col: str, **lists) -> DataFrame:
    """One row: ten suggested switches and the statistics rounded for display."""
    stats = text_statistics(df, text_col, **lists)
    return stats.select("n_rows", *[rule.alias(name) for name, rule in decisions().items()],
                        *[round_digits(F.col(s)).alias(s) for s in STATISTICS])


def suggested_config(suggestion: DataFrame) -> CleanConfig:
    """Read the one suggestion row into a config."""
    row: Row = suggestion.first()
    return CleanConfig(**{name: row[name] for name in CleanConfig.names()})
