"""SimHash near duplicates by vantage-point trees over Hamming distance.

A text's words (A-Z lower-cased, split at ASCII white space) give shingles of three, repeats included
(fewer words: the whole sequence is the one shingle). A bit of the fingerprint is 1 if it is set in
more than half of the shingles' XXH64 (seed 42). Fingerprints link at ``RADIUS`` or fewer differing
bits, and linked ones form components.

Distinct fingerprints are the points. A vantage-point tree fitted on a bounded sample halves them by
their distance to a vantage point; its leaves are shards, and a full shard is dealt into parts. By the
triangle inequality a point whose distance is within ``RADIUS`` of a node's boundary may have partners
on the other side, so it also visits the shards there; of two shards only the earlier one's points
visit the later one. Inside a shard a tree of its own points is built, and own points and visitors
stream through it, branches pruned by the same bounds. Answers are exact for any tree.

A shard gives no pairs: partners that are connected already are passed over, so a task gives at most
one link per point it sees, and a crowd of near copies does not become all its pairs. A shard holds at
most ``SHARD`` own points (on average over parts) and its visitors come as a sorted stream.

Defined cases: texts without words have fingerprint zero and link like others; a null id has a
fingerprint and a component but is never the component's smallest id; a component of null ids only
has null as its id; rows of one id are rows of their own; an empty table gives an empty result. Ids
of any ordered type pass through. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentmill.llm.common import attach, components, map_texts, materialized

RADIUS, WIDTH, SEED = 3, 3, 42
#: Fingerprints that the tree of shards is fitted on, at most; points that a shard's part holds, about;
#: points of a leaf inside a shard; queries that meet a tree at once.
SAMPLE, SHARD, LEAF, AT_ONCE = 200_000, 16_384, 128, 8_192
#: Vantage points that are tried per node, the one of the most spread distances is taken.
TRIED, LOOKED_AT = 8, 2_048


def shingle_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    whole, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*[s - 1 for s in starts[WIDTH:]], len(whole)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[s:e], SEED) for s, e in zip(starts, ends, strict=False)), np.uint64, len(ends))


def fingerprint(text: str | None) -> int:
    """64 bits as a signed number."""
    hashes = shingle_hashes(text)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int(bits.view(">i8")[0])


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Tree:
    """Nodes in arrays: vantage point, boundary, children (inside, outside), first leaf row."""

    vantage: list[int]
    bound: list[int]
    inside: list[int]
    outside: list[int]
    leaf: list[int]
    leaves: list[np.ndarray]


def grow(points: np.ndarray, least: int, seed: int = 5) -> Tree:
    """A tree whose leaves hold at most ``least`` of the points, if distances can tell them apart."""
    draw = np.random.Generator(np.random.PCG64(seed))
    tree = Tree([0], [0], [-1], [-1], [-1], [])
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        parts = _halves(points, rows, draw) if len(rows) > least else None
        if parts is None:
            tree.leaf[node] = len(tree.leaves)
            tree.leaves.append(rows)
            continue
        tree.vantage[node], tree.bound[node] = parts[0], parts[1]
        for side, part in ((tree.inside, parts[2]), (tree.outside, parts[3])):
            side[node] = len(tree.vantage)
            for name, value in (("vantage", 0), ("bound", 0), ("inside", -1), ("outside", -1), ("leaf", -1)):
                getattr(tree, name).append(value)
            todo.append((side[node], part))
    return tree


def _halves(points: np.ndarray, rows: np.ndarray, draw) -> tuple | None:
    """(vantage point, boundary, rows up to it, rows beyond) with the boundary at the median."""
    seen = points[draw.choice(rows, min(LOOKED_AT, len(rows)), replace=False)]
    tried = seen[:TRIED]
    best = max(tried, key=lambda v: float(np.var(distance(seen, v))))
    d = distance(points[rows], best)
    bound = int(np.median(d))
    near = d <= bound
    if near.all():  # many at the median: split before it
        bound -= 1
        near = d <= bound
    if near.all() or not near.any():
        return None
    return int(best), bound, rows[near], rows[~near]


def descend(tree: Tree, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, places of the queries that may have partners there). A radius of 0 gives each query's
    own leaf."""
    todo = [(0, np.arange(len(queries)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if tree.leaf[node] >= 0:
            yield tree.leaf[node], at
            continue
        d = distance(queries[at], np.uint64(tree.vantage[node])).astype(np.int16)
        todo.append((tree.inside[node], at[d - radius <= tree.bound[node]]))
        todo.append((tree.outside[node], at[d + radius > tree.bound[node]]))


class Shard:
    """Own points of a shard in a tree, and which of them are connected."""

    def __init__(self, points: np.ndarray, radius: int):
        self.radius, self.tree = radius, grow(points, LEAF)
        order = np.concatenate(self.tree.leaves) if len(points) else np.empty(0, np.int64)
        self.points = points[order]
        ends = np.cumsum([len(x) for x in self.tree.leaves])
        self.spans = [(int(e - len(x)), int(e)) for e, x in zip(ends, self.tree.leaves, strict=True)]
        self.label = np.arange(len(points))

    def join(self, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links (query, own point) that connect what was apart. Without queries, the own points'."""
        links: list[tuple[int, int]] = []
        own, queries = queries is None, self.points if queries is None else queries
        for at in range(0, len(queries), AT_ONCE):
            part = queries[at:at + AT_ONCE]
            # the label that a query is connected with
            mine = self.label[at:at + AT_ONCE].copy() if own else np.full(len(part), -1)
            for leaf, who in descend(self.tree, part, self.radius):
                lo, hi = self.spans[leaf]
                self._meet(part, mine, who, lo, hi, links)
        return links

    def _meet(self, queries: np.ndarray, mine: np.ndarray, who: np.ndarray, lo: int, hi: int, links: list) -> None:
        labels = self.label[lo:hi]
        apart = who[(mine[who] != labels[0]) | (labels != labels[0]).any()]
        if not len(apart):
            return
        near = (distance(queries[apart][:, None], self.points[None, lo:hi]) <= self.radius)
        near &= mine[apart][:, None] != labels[None, :]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            q = apart[i]
            while True:  # one link per label that the query is still apart from
                j = int(np.argmax(still := near[i] & (labels != mine[q])))
                if not still[j]:
                    break
                links.append((int(queries[q]), int(self.points[lo + j])))
                label = labels[j]
                if mine[q] >= 0:
                    self.label[self.label == mine[q]] = label
                    mine[mine == mine[q]] = label
                else:
                    mine[q] = label


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of fingerprints (one column ``fp``, each once) that connect all whose distance is
    at most ``radius``."""
    spark = points.sparkSession
    total = points.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = np.sort(drawn.limit(2 * SAMPLE).toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    wanted = max(1, -(-total // SHARD))
    tree = grow(sample, max(8, -(-len(sample) // wanted)))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            own = np.zeros(len(fps), np.int32)
            for leaf, who in descend(tree, fps, 0):
                own[who] = leaf
            yield pdf.assign(shard=own)

    placed = materialized(points.select("fp").mapInPandas(home, "fp bigint, shard int"))
    held = {s: n for s, n in placed.groupBy("shard").count().collect()}  # one line per leaf of the sample's tree
    parts = np.array([max(1, -(-held.get(s, 0) // SHARD)) for s in range(len(tree.leaves))], np.int64)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Own points (visitor 0) to one part of their shard; visitors to all parts of later shards,
        and to the later parts of their own."""
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            own = pdf["shard"].to_numpy()
            part = (fps * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[own]
            yield pd.DataFrame({"shard": own, "part": part, "visitor": 0, "fp": _signed(fps)})
            for leaf, who in descend(tree, fps, radius):
                for p in range(int(parts[leaf])):
                    go = who[(own[who] < leaf) | ((own[who] == leaf) & (part[who] < p))]
                    if len(go):
                        yield pd.DataFrame({"shard": leaf, "part": p, "visitor": 1, "fp": _signed(fps[go])})

    key = ["shard", "part"]
    tasks = max(1, min(int(parts.sum()), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = (placed.mapInPandas(dealt, "shard int, part int, visitor int, fp bigint").repartition(tasks, *key)
           .sortWithinPartitions(*key, "visitor"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, shard, own = None, None, []
        for pdf in batches:
            for name, group in pdf.groupby(key, sort=True):
                fps, visits = group["fp"].to_numpy(np.int64).view(np.uint64), group["visitor"].to_numpy() == 1
                if name != now:
                    if own:
                        yield _frame(_opened(own, radius)[1])
                    now, shard, own = name, None, []
                if not visits.all():
                    own.append(fps[~visits])
                if visits.any():
                    if shard is None:
                        shard, found = _opened(own, radius)
                        own = []
                        yield _frame(found)
                    yield _frame(shard.join(fps[visits]))
        if own:
            yield _frame(_opened(own, radius)[1])

    return met.mapInPandas(joined, "a bigint, b bigint")


def _opened(own: list[np.ndarray], radius: int) -> tuple[Shard, list]:
    points = np.concatenate(own) if own else np.empty(0, np.uint64)
    shard = Shard(points, radius)
    return shard, shard.join()


def _frame(found: list[tuple[int, int]]) -> pd.DataFrame:
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, the fingerprint as a signed number."""
    make: Callable = lambda: fingerprint
    return map_texts(df, id_col, text_col, make, "fp", "bigint")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``df``: id, fingerprint, component_id (smallest id reachable)."""
    rows = materialized(fingerprints(df, id_col, text_col))
    groups = materialized(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(groups.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    linked = materialized(groups.join(roots, "fp"))
    sized = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    known = attach(linked.select("fp", "root"), materialized(sized), "root", "members", linked.count())
    facts = groups.join(known.select("fp", "component_id"), "fp", "left").select(
        "fp", "copies", F.coalesce("component_id", "least").alias("component_id"))
    return attach(rows, materialized(facts), "fp", "copies", rows.count()).select(
        F.col("id").alias(id_col), as_hex(F.col("fp")).alias("fingerprint"), "component_id")
