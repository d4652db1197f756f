"""Helpers shared by the operators: checkpoints, skew-safe look-ups, text digests, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from commentmill.functions.cut import materialized

#: A group with at least this share of all rows counts as hot, so there are at most as many hot
#: groups as its inverse. That bounds what ``attach`` broadcasts, whatever the input's size.
HOT_SHARE = 1 / 1000
#: Edges of a graph per task, and rows of a written table that ``gathered`` reads in one task.
EDGES_PER_TASK, ROWS_PER_TASK = 100_000, 20_000

#: Most bytes of text that a Python function takes at once (or one text).
BATCH_BYTES = 1 << 22

__all__ = ["HOT_SHARE", "ascii_lower", "attach", "components", "empty_if_null", "gathered", "map_texts", "materialized",
           "text_slices"]


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII characters take the faster ``lower``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, upper, upper.lower())))


def attach(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``rows`` with one line of ``facts`` per key, where ``facts[size]`` is
    the number of rows of the key. Hot keys (fewer than ``1 / HOT_SHARE`` of them) are broadcast, so
    their rows stay where they are; only rows of ordinary keys move."""
    facts = facts.select(*[F.col(c).alias(c) for c in facts.columns])  # it may stem from the rows
    limit = max(1, int(total * HOT_SHARE))
    hot = facts.filter(F.col(size) >= limit)
    usual = facts.filter(F.col(size) < limit)
    names = hot.select(F.col(key).alias("__hot"))
    here = rows.join(F.broadcast(names), F.col(key) == F.col("__hot"), "left")
    cold = here.filter(F.col("__hot").isNull()).drop("__hot").join(usual, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def gathered(df: DataFrame) -> DataFrame:
    """The rows, written once (see ``materialized``) and read by no more tasks than they need: what is
    shuffled next then leaves no file per task of an almost empty table."""
    kept = materialized(df)
    return kept.coalesce(max(1, -(-kept.count() // ROWS_PER_TASK)))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a task as stars: every node but the smallest of its component, and that one."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    stars = [(x, r) for x in up if (r := root(x)) != x]
    for at in range(0, len(stars), EDGES_PER_TASK):
        us, vs = zip(*stars[at:at + EDGES_PER_TASK], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the links (a, b): one line (node, root) per linked node, root
    being the smallest node reachable. Every task first connects its own edges, a bounded number; where
    there are several tasks, rounds connect every node's larger neighbours to its smallest one and then
    the smaller ones; minima are combined before the shuffle."""
    spark = links.sparkSession
    edges = materialized(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .filter("u != v").distinct())
    parts = -(-edges.count() // EDGES_PER_TASK)
    if not parts:
        return spark.createDataFrame([], "node bigint, root bigint")
    # edges never become more: few files where there are few
    edges = edges.coalesce(parts).mapInArrow(_forest, "u bigint, v bigint")
    edges = materialized(edges)
    if parts == 1:  # nothing is left to connect
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        return materialized(edges.toDF("node", "root").unionByName(roots).coalesce(parts))

    def star(both: DataFrame, keep: Column) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.withColumn("m", F.least("u", "m"))
        out = both.join(least, "u").filter(keep).coalesce(parts)
        pairs = out.select(F.col("v").alias("x"), "m")
        return pairs.filter("x != m").select(F.greatest("x", "m").alias("u"),
                                             F.least("x", "m").alias("v")).distinct()

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = signature(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialized(star(both, F.col("v") > F.col("u")).coalesce(parts))
        # each node's smaller neighbours, and the node itself, go to the smallest of them
        own = large.unionByName(large.select("u", F.col("u").alias("v")).distinct())
        edges = materialized(star(own, F.lit(True)).coalesce(parts))
        now = signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return materialized(nodes.unionByName(roots.join(nodes, "node", "left_anti")).coalesce(parts))


def text_slices(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES,
                column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in parts with a bounded number of bytes of text (or one row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < len(sizes):
            yield batch.slice(at)


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[str | None], object]],
              name: str, kind: str) -> DataFrame:
    """(id, name): a Python function of every text, of the given type. ``make`` is called once
    per task. Ids pass through as they are, nulls among them."""
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    arrow = to_arrow_type(DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in text_slices(batches):
            values = [one(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, arrow)], ["id", name])

    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, {name} {kind}")
