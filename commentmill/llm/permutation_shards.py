"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table (an offset and a
skip, both from its name's MD5). Shards take turns claiming the first free slot they prefer, so
each holds an equal number of slots give or take one, and removing a shard moves few slots besides
its own. A row's key is hashed to a slot; the table (``size`` lines, a parameter) is broadcast, so
placing is one look-up without a shuffle.

Defined cases: a null key is placed as the empty text; repeated keys go together; an empty table
gives an empty result. Columns are added under the names asked for, replacing such columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
#: Prime, and over a hundred slots per shard, so that shares differ by less than a hundredth.
TABLE_SIZE = 2039
#: The largest table that is built; it bounds the broadcast.
MAX_TABLE_SIZE = 1_000_003


def _draw(name: str, what: str) -> int:
    return int(hashlib.md5(f"{name}:{what}".encode()).hexdigest()[:8], 16)


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """The index of the owning shard for each slot."""
    if not 0 < len(set(shards)) == len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError("shards must be distinct and at most as many as the slots")
    if any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)) or size < 3:
        raise ValueError("the table's size must be an odd prime")
    at = [_draw(s, "offset") % size for s in shards]
    skip = [_draw(s, "skip") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        s = turn % len(shards)
        while owner[at[s]] >= 0:
            at[s] = (at[s] + skip[s]) % size
        owner[at[s]] = s
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    return spark.createDataFrame([(slot, shards[s]) for slot, s in enumerate(fill_table(shards, size))],
                                 "__slot bigint, __shard string")


def slot_of(key: Column, size: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size))


def assign_shards(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE,
                  slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of each row."""
    table = F.broadcast(lookup_table(df.sparkSession, shards, size))
    placed = df.withColumn("__slot", slot_of(F.col(key), size)).join(table, "__slot")
    kept = [c for c in df.columns if c not in (slot_name, shard_name)]
    return placed.select(*kept, F.col("__slot").alias(slot_name), F.col("__shard").alias(shard_name))
