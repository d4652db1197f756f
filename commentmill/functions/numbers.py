"""Rounding and reproducible random draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_digits(col: Column, digits: int = 4) -> Column:
    """Round for display, ties to even."""
    return F.bround(col, digits)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0."""
    return F.when(den > 0, num / F.greatest(den, F.lit(1))).otherwise(F.lit(0.0))


def draw_hex(seed: int, key: Column, op: str, *pos: Column) -> Column:
    """32 hex digits that depend only on seed, row key, operator and position.

    A shared sequential random stream would tie results to row order; hashing the key
    gives the same draw for a row under any partitioning and on any retry.
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(op),
                             *[p.cast("string") for p in pos]))


def draw_int(hex_digits: Column, bound: Column) -> Column:
    """A draw in ``[0, bound)`` from the first eight hex digits."""
    return F.pmod(F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("bigint"), bound.cast("bigint"))


def hex_threshold(share: float) -> str:
    """``draw_hex(...) < hex_threshold(p)`` holds with probability p."""
    if share >= 1.0:
        return "g"  # above every hex string
    return f"{int(max(share, 0.0) * 16**8):08x}"
