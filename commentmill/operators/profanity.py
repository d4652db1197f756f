"""Lexicon scan, masking and replacement of profanity."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentmill.functions import lexicons as lex
from commentmill.functions.numbers import ratio
from commentmill.functions.text import (
    BOUNDARY, W, as_text, bind, is_blank, regex_quote, replacement_quote, text_map,
)


def normalize_terms(terms: Iterable[str] | None = None) -> list[str]:
    """Trimmed, lower-cased, distinct and sorted lexicon."""
    source = lex.PROFANITY_TERMS if terms is None else terms
    return sorted({t.strip().lower() for t in source if t and t.strip()})


def _edge(ch: str, before: bool) -> str:
    """The boundary next to a known character, cheaper than the general test."""
    wordy = ch.isalnum() or ch == "_"
    if before:
        return f"(?<!{W})" if wordy else f"(?<={W})"
    return f"(?!{W})" if wordy else f"(?={W})"


def direct_pattern(terms: list[str]) -> str:
    """Word-bounded term with an optional suffix; group 1 is the base term."""
    suffixes = "(?:" + "|".join(lex.PROFANITY_SUFFIXES) + ")?"
    plain = all((t[0] + t[-1]).replace("_", "a").isalnum() for t in terms)
    left, right = (_edge("a", True), _edge("a", False)) if plain else (BOUNDARY, BOUNDARY)
    return f"(?iu){left}(" + "|".join(map(regex_quote, terms)) + f"){suffixes}{right}"


def obfuscated_pattern(term: str) -> str:
    """The letters of a term with anything but letters and digits between them."""
    gap = r"[^\p{L}\p{N}]*"
    return (_edge(term[0], True) + gap.join(map(regex_quote, term)) + _edge(term[-1], False))


#: Other characters that a pattern without regard to case takes for an ASCII letter.
CASE_TWINS = "\u017f\u212a\u0130\u0131"


#: Up to so many terms are looked for one by one before their pattern runs.
FEW_TERMS = 64


def _has_twin(col: Column) -> Column:
    return reduce(or_, [F.contains(col, F.lit(c)) for c in CASE_TWINS])


def letters_only(col: Column) -> Column:
    """Lower-cased letters and figures of a text; null where a character is an ASCII letter's twin."""
    return F.when(~_has_twin(col), F.lower(F.regexp_replace(col, r"[^\p{L}\p{N}]+", "")))


def may_hold(bare: Column, term: str) -> Column:
    """False only where no separated form of the term can be in the text."""
    letters = "".join(filter(str.isalnum, term))
    return F.coalesce(F.contains(bare, F.lit(letters)), F.lit(True)) if term.isascii() else F.lit(True)


def undisguise(col: Column) -> Column:
    """Lower-cased text with look-alike characters mapped and the rest blanked."""
    return _words_only(_plain(F.lower(col)))


def _plain(low: Column) -> Column:
    for look, letter in zip(lex.LOOKALIKE_FROM, lex.LOOKALIKE_TO, strict=True):
        low = F.replace(low, F.lit(look), F.lit(letter))  # no letter is itself a look-alike
    return low


def _words_only(plain: Column) -> Column:
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def _hits(col: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)), F.lower)


def _nothing() -> Column:
    return F.array().cast("array<string>")


def found_terms(col: Column, terms: Iterable[str] | None = None) -> Column:
    """Distinct base terms in order of first hit, raw text first, then undisguised text."""
    lexicon = normalize_terms(terms)
    if not lexicon:
        return _nothing()
    pattern = direct_pattern(lexicon)
    if len(lexicon) > FEW_TERMS or not all(re.fullmatch("[a-z0-9]+", t) for t in lexicon):
        return F.array_distinct(F.concat(_hits(col, pattern), _hits(undisguise(col), pattern)))

    def holds(text: Column) -> Column:
        return reduce(or_, [F.contains(text, F.lit(t)) for t in lexicon])

    def both(t: Column, low: Column) -> Column:
        """The patterns only run over texts that hold the letters of a term."""
        raw = F.when(_has_twin(t) | holds(low), _hits(t, pattern)).otherwise(_nothing())
        more = bind(_plain(low), lambda p: F.when(holds(p), _hits(_words_only(p), pattern)).otherwise(_nothing()))
        return F.array_distinct(F.concat(raw, more))

    return bind(col, lambda t: bind(F.lower(t), lambda low: both(t, low)))


def scan(df: DataFrame, text_col: str, terms: Iterable[str] | None = None) -> DataFrame:
    """Add ``has_profanity``, ``profanity_count`` (distinct terms), ``profanity_matches``."""
    found = df.withColumn("profanity_matches", found_terms(as_text(F.col(text_col)), terms))
    return found.withColumns({
        "has_profanity": F.size("profanity_matches") > 0,
        "profanity_count": F.size("profanity_matches"),
    })


def flagged_share(scanned: DataFrame, *by: str) -> DataFrame:
    """Flagged rows, all rows and percent, overall or per group."""
    n = F.count(F.lit(1))
    return scanned.groupBy(*by).agg(
        F.count_if("has_profanity").alias("flagged"), n.alias("total"),
        (ratio(F.count_if("has_profanity"), n) * 100.0).alias("percent"))


def _replace_direct(text: Column, pattern: str, found: Column, phrases: Mapping[str, str],
                    mask: str) -> Column:
    """Replace every direct hit in one left-to-right pass (new text is not rescanned): cut
    the text at the hits, and put each hit's phrase back between the pieces."""
    if not phrases:
        return F.regexp_replace(text, pattern, replacement_quote(mask))
    put = F.transform(found, lambda t: F.coalesce(F.try_element_at(text_map(dict(phrases)), t),
                                                  F.lit(mask)))
    pieces = F.zip_with(F.split(text, pattern, -1), put,
                        lambda gap, word: F.concat(gap, F.coalesce(word, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)


def sanitize_expr(text: Column, terms: Iterable[str] | None = None, *, mode: str = "mask",
                  mask_token: str = lex.MASK_TOKEN,
                  replacement_map: Mapping[str, str] | None = None) -> Column:
    """struct(clean_text, replacements) of one text column.

    Direct hits go first. Then each term, in sorted order, is looked for with separators
    between its letters unless it was already replaced; later terms see earlier output. That
    pattern is slow, so it is only tried where the letters and figures of the text, with
    nothing between them, hold the term's (see ``letters_only``).
    """
    mode = (mode or "mask").strip().lower()
    if mode not in ("mask", "replace"):
        raise ValueError("mode must be 'mask' or 'replace'")
    lexicon = normalize_terms(terms)
    given = {k.lower(): v for k, v in (replacement_map or {}).items()} if mode == "replace" else {}
    phrases = {t: given[t] for t in lexicon if t in given}
    if not lexicon:
        return F.struct(text.alias("clean_text"), _nothing().alias("replacements"))

    pattern = direct_pattern(lexicon)

    def state(out: Column, found: Column) -> Column:
        return F.struct(out.alias("clean_text"), found.alias("replacements"), letters_only(out).alias("bare"))

    def replace_separated(term: str):
        rx = "(?iu)" + obfuscated_pattern(term)

        def step(s: Column) -> Column:
            out, found = s["clean_text"], s["replacements"]
            todo = ~F.array_contains(found, term) & may_hold(s["bare"], term) & out.rlike(rx)
            new = F.regexp_replace(out, rx, replacement_quote(phrases.get(term, mask_token)))
            return F.when(todo, state(new, F.array_append(found, F.lit(term)))).otherwise(s)

        return step

    def second_stage(s: Column) -> Column:
        chain = s
        for term in lexicon:
            chain = bind(chain, replace_separated(term))
        return F.when(reduce(or_, [may_hold(s["bare"], t) for t in lexicon]), chain).otherwise(s)

    def both_stages(t: Column, found: Column) -> Column:
        direct = F.when(F.size(found) > 0, _replace_direct(t, pattern, found, phrases, mask_token)).otherwise(t)
        return bind(bind(direct, lambda out: state(out, F.array_distinct(found))), lambda s: bind(
            second_stage(s), lambda end: F.struct(end["clean_text"], end["replacements"])))

    return bind(text, lambda t: bind(_hits(t, pattern), lambda found: both_stages(t, found)))


def sanitize(df: DataFrame, text_col: str, terms: Iterable[str] | None = None, *,
             mode: str = "mask", mask_token: str = lex.MASK_TOKEN,
             replacement_map: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``clean_text`` and ``clean_replacements``. Blank text passes through unchanged."""
    mode = (mode or "mask").strip().lower()
    if mode == "replace" and replacement_map is None:
        replacement_map = lex.PROFANITY_REPLACEMENTS
    done = df.withColumn("_text", as_text(F.col(text_col))).withColumn(
        "_done", sanitize_expr(F.col("_text"), terms, mode=mode, mask_token=mask_token,
                               replacement_map=replacement_map))
    blank = is_blank(F.col("_text"))
    return done.withColumns({
        "clean_text": F.when(blank, F.col("_text")).otherwise(F.col("_done.clean_text")),
        "clean_replacements": F.when(blank, _nothing()).otherwise(F.col("_done.replacements")),
    }).drop("_text", "_done")


def changed_rows(sanitized: DataFrame) -> DataFrame:
    """Rows with at least one replacement, and all rows."""
    return sanitized.agg(F.count_if(F.size("clean_replacements") > 0).alias("changed"),
                         F.count(F.lit(1)).alias("total"))
