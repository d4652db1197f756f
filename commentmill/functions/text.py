"""Character classes and small text expressions shared by all operators.

Java's ``\\w``, ``\\s``, ``\\b`` and ``\\d`` are not Unicode-aware by default, so the
explicit classes below are used everywhere instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"  # class body: word characters
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PUNCT = r"\p{P}$+<=>^`|~"  # class body: ASCII punctuation + Unicode category P*
DIGIT_LIKE = (
    r"\p{Nd}\u00b2\u00b3\u00b9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089"
    r"\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff"
    r"\u2776-\u277e\u2780-\u2788\u278a-\u2792"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)

#: The characters of SPACE as a string.
SPACES = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                           0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))

W = f"[{WORD}]"
NOT_W = f"[^{WORD}]"
# Intersecting a class with the range it can lie in rejects most characters on one test.
WS = rf"[\x00-\x20\x85-\u3000&&[{SPACE}]]"
# The complement of WS as ranges, commonest first.
NOT_WS = (
    r"[\x21-\x84\xa1-\u167f\u3001-\x{10ffff}\u2030-\u205e\u2060-\u2fff\x00-\x08\x0e-\x1b"
    r"\x86-\x9f\u1681-\u1fff\u200b-\u2027\u202a-\u202e]"
)


def within(ranges: str, class_body: str) -> str:
    """A class known to lie inside ``ranges``; same matches, faster rejection."""
    return f"[{ranges}&&[{class_body}]]"


BOUNDARY = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"


def as_text(col: Column) -> Column:
    """Null cells become the empty string; everything else is read as text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def is_blank(col: Column) -> Column:
    return ~col.rlike(NOT_WS)


def strip(col: Column) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.btrim(col, F.lit(SPACES))  # looks at the ends only


def tokens(col: Column) -> Column:
    """Whitespace-separated tokens, without empty ones."""
    return F.filter(F.split(col, f"{WS}+"), lambda x: x != "")


def count_matching(col: Column, char_class: str) -> Column:
    """Number of characters of ``col`` inside a bracketed character class."""
    return F.length(col) - F.length(F.regexp_replace(col, f"{char_class}+", ""))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Outer expressions used inside a ``transform``/``filter`` lambda are otherwise
    evaluated again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def regex_quote(literal: str) -> str:
    """Escape a literal for a Java or RE2 pattern."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in literal)


def replacement_quote(literal: str) -> str:
    """Escape a literal for the replacement side of ``regexp_replace``."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def text_map(mapping: dict[str, str]) -> Column:
    """A literal map column."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def in_words(col: Column, words) -> Column:
    """Membership in a word list; long literal lists become one hash-set probe."""
    words = list(words)
    return col.isin(*words) if words else F.lit(False)
