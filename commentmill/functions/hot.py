"""Joins on words, some of which may be in a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentmill.functions.cut import materialized

#: A key is hot above one row in this many; so there are always fewer hot keys than this.
HOT_PARTS = 1_000


def join_keys(rows: DataFrame, table: DataFrame, key: str, parts: int = HOT_PARTS) -> DataFrame:
    """Inner join of many rows with a table of one line per key; a task never gets a hot key whole.

    Keys are counted, added up before they move. The lines of hot keys, fewer than ``parts`` whatever
    the size of the input, go to the rows; all other rows meet the table by a shuffle, in which no
    key has more than one row in ``parts``. Hot keys that the table lacks do not move at all.
    ``rows`` is read three times. Null keys meet nothing.
    """
    counts = materialized(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.filter(F.col(key).isNotNull() & (F.col("_n") * parts > total)).select(key)
    often = rows.join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key)
    seldom = rows.join(F.broadcast(hot), key, "left_anti").join(table, key)
    return often.unionByName(seldom)
