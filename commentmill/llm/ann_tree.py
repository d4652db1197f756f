"""Nearest neighbours by inner product in a hierarchical k-means tree.

The tree is fitted on at most ``SAMPLE`` distinct vectors (drawn by a hash of their id) and then
every distinct vector is put into a leaf. A query goes through the tree best bin first: a priority
queue of nodes by the inner product with their centroids. How many leaves each query visits is
widened until, on calibration queries answered by brute force over all vectors, the recall reaches
``target``; queries whose leaves hold too few vectors go on further. Neighbouring leaves form
blocks of bounded size; a query meets a block once, for all the leaves it visits there, and only its
best entries leave the task. Scores are sums in double precision, in the order of the components.
Where vectors have no clusters, a tree must visit most of its leaves, and the work grows with
queries times vectors.

Equal vectors are one entry with its smallest ids, so a group of copies costs one comparison.

Defined cases: vectors that are null, zero or of another length than most, or that hold null or
non-finite components, take no part; rows of one id are one candidate if equal; with fewer
candidates than ``k``, all are returned; an empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commentmill.llm.common import attach, materialized

SAMPLE = 50_000
BRANCH = 8
LEAF_ROWS = 200
CALIBRATION = 128
#: Most vectors of a block and queries that meet it in one call, and queries scored at a time.
BLOCK, QUERY_BLOCK, AT_ONCE = 16_384, 8_192, 128


class Tree:
    """Nodes in arrays: centroid, children (first, count; 0 for a leaf) and leaf number."""

    def __init__(self, points: np.ndarray, leaves: int, seed: int = 11):
        self.centroids, self.first, self.count, self.leaf = [points.mean(axis=0)], [0], [0], [-1]
        self.leaves = 0
        draw = np.random.Generator(np.random.PCG64(seed))
        size = max(4, len(points) // max(1, leaves))
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            parts = _split(points, rows, draw) if len(rows) > size else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            self.first[node], self.count[node] = len(self.leaf), len(parts)
            for part in parts:
                self.centroids.append(points[part].mean(axis=0))
                self.first.append(0)
                self.count.append(0)
                self.leaf.append(-1)
                todo.append((len(self.leaf) - 1, part))
        self.centroids = np.array(self.centroids)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: down the tree to the nearest centroid."""
        node = np.zeros(len(points), np.int64)
        first, count, leaf = map(np.array, (self.first, self.count, self.leaf))
        while (inner := count[node] > 0).any():
            for n in np.unique(node[inner]):
                rows = np.nonzero(node == n)[0]
                kids = self.centroids[first[n]:first[n] + count[n]]
                node[rows] = first[n] + np.argmin((kids * kids).sum(1) - 2 * points[rows] @ kids.T, axis=1)
        return leaf[node]

    def visits(self, query: np.ndarray, most: int, held: np.ndarray, least: int) -> list[int]:
        """Leaves, best bin first: ``most`` of them, and on until they hold ``least`` entries."""
        queue, out, seen = [(0.0, 0)], [], 0
        while queue and (len(out) < most or seen < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                seen += held[self.leaf[node]]
                continue
            at, n = self.first[node], self.count[node]
            for i, s in enumerate(self.centroids[at:at + n] @ query):
                heapq.heappush(queue, (-s, at + i))
        return out


def _split(points: np.ndarray, rows: np.ndarray, draw) -> list[np.ndarray]:
    x = points[rows]
    centers = x[draw.choice(len(rows), min(BRANCH, len(rows)), replace=False)]
    for _ in range(8):
        near = np.argmin((centers * centers).sum(1) - 2 * x @ centers.T, axis=1)
        centers = np.array([x[near == c].mean(axis=0) if (near == c).any() else centers[c]
                            for c in range(len(centers))])
    near = np.argmin((centers * centers).sum(1) - 2 * x @ centers.T, axis=1)
    return [rows[near == c] for c in range(len(centers)) if (near == c).any()]


def _top(queries: np.ndarray, q_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int,
         allowed=None) -> pd.DataFrame:
    """The k best points of each query, ties to smaller ids. ``allowed(a, b)`` tells, for queries
    a to b, which points they may have. Fast products choose, exact ones rank."""
    order = np.argsort(ids, kind="stable")  # equal scores then stand by id
    points, ids = points[order], ids[order]
    # what a fast product and an exact sum may differ by, with room
    apart = 8 * points.shape[1] * np.finfo(float).eps * np.abs(points).max(initial=0.0)
    out_q, out_r, out_s = [], [], []
    for at in range(0, len(queries), AT_ONCE):
        asks = queries[at:at + AT_ONCE]
        scores = asks @ points.T
        if allowed is not None:
            scores[~allowed(at, at + len(asks))[:, order]] = -np.inf
        edge = np.partition(scores, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
        # every entry that may be among the k best, however many are equal at the edge
        floor = edge - apart * np.abs(asks).sum(axis=1)
        rows, cols = np.nonzero((scores >= floor[:, None]) & ~np.isneginf(scores))
        exact = np.zeros(len(rows))
        for d in range(asks.shape[1]):
            exact += asks[rows, d] * points[cols, d]
        rank = np.lexsort((cols, -exact, rows))
        rows, cols, exact = rows[rank], cols[rank], exact[rank]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        out_q.append(q_ids[at:at + AT_ONCE][rows[best]])
        out_r.append(ids[cols[best]])
        out_s.append(exact[best])
    return pd.DataFrame({"q": np.concatenate(out_q), "rep": np.concatenate(out_r), "score": np.concatenate(out_s)})


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    fine = (F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vec, lambda x: x != 0.0))
    return (df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), vec.alias("vec"))
            .filter(fine)
            .withColumns({"h1": F.xxhash64("vec"), "h2": F.hash("vec"), "dim": F.size("vec")}))


def search(df: DataFrame, is_query: Column, k: int = 20, target: float = 0.97, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """For each row of ``df`` with ``is_query`` (over vec_id): query_id, rank, vec_id, score."""
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    spark = df.sparkSession
    rows = materialized(_valid(df, id_col, vec_col))
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.col("dim") == common["dim"])
    # equal vectors: one entry with its k+1 smallest ids; no group is gathered
    ranked = rows.dropDuplicates(["vec_id", "h1", "h2"]).withColumn(
        "r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    entries = materialized(ranked.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"),
        F.first("vec").alias("vec")))
    total = entries.count()

    share = min(1.0, SAMPLE / total)
    drawn = entries.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = drawn.select("rep", "vec").orderBy("rep").limit(SAMPLE).toPandas()
    points = np.array(sample["vec"].tolist() or [entries.select("vec").first()["vec"]])
    tree = Tree(points, leaves=min(-(-total // LEAF_ROWS), max(1, len(points) // 10)))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=tree.place(np.array(pdf["vec"].tolist())))

    index = materialized(entries.select("h1", "h2", "rep", "vec").mapInPandas(
        placed, "h1 bigint, h2 int, rep bigint, vec array<double>, leaf int"))
    held = np.zeros(tree.leaves, np.int64)
    for leaf, n in index.groupBy("leaf").count().collect():  # one line per leaf
        held[leaf] = n
    asking = rows.filter(is_query).select("vec_id", "h1", "h2").distinct()
    sizes = asking.groupBy("h1", "h2").agg(F.count("*").alias("size"))
    queries = materialized(index.join(sizes, ["h1", "h2"], "left_semi").select(F.col("rep").alias("q"), "vec"))
    most = _widened(queries, index, tree, held, k, target)

    # leaves are numbered as they lie in the tree, so those of a block are neighbours; a leaf
    # larger than a block has several of its own
    parts = np.maximum(1, -(-held // BLOCK)).astype(int)
    first, block, filled = [], 0, 0
    for n, p in zip(held, parts, strict=True):
        if filled and (p > 1 or filled + n > BLOCK):
            block, filled = block + 1, 0
        first.append(block)
        filled += int(n)
        if p > 1:
            block, filled = block + int(p), 0
    where = spark.createDataFrame([(i, f, int(p)) for i, (f, p) in enumerate(zip(first, parts, strict=True))],
                                  "leaf int, first int, parts int")  # one line per leaf

    def visiting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            trips = []
            for v in pdf["vec"]:
                met: dict[int, list[int]] = {}
                for leaf in tree.visits(np.asarray(v), most, held, k + 1):
                    for b in range(first[leaf], first[leaf] + int(parts[leaf])):
                        met.setdefault(b, []).append(leaf)
                trips.append([{"block": b, "leaves": ls} for b, ls in met.items()])
            yield pdf.assign(trips=trips)

    trips = queries.mapInPandas(
        visiting, "q bigint, vec array<double>, trips array<struct<block:int,leaves:array<int>>>")
    deals = max(1, -(-queries.count() // QUERY_BLOCK))
    left = trips.select("q", "vec", F.inline("trips")).withColumn(
        "y", F.pmod(F.xxhash64("q"), F.lit(deals)).cast("int"))
    right = (index.join(F.broadcast(where), "leaf")
             .withColumn("block", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int"))
             .select("block", "leaf", "rep", "vec", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("y")))

    def scored(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"q": [], "rep": [], "score": []})
        leaf = cs["leaf"].to_numpy()
        sets = qs["leaves"].tolist()

        def allowed(a: int, b: int) -> np.ndarray:
            seen = np.zeros((len(sets[a:b]), tree.leaves), bool)
            for i, ls in enumerate(sets[a:b]):
                seen[i, ls] = True
            return seen[:, leaf]

        return _top(np.array(qs["vec"].tolist()), qs["q"].to_numpy(), np.array(cs["vec"].tolist()),
                    cs["rep"].to_numpy(), k + 1, allowed)

    key = ["block", "y"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(scored, "q bigint, rep bigint, score double")
    order = W.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    hits = best.join(entries.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    answers = hits.groupBy("q").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("s"), "vec_id", "score"))).alias("near"))
    facts = materialized(entries.select("h1", "h2", "rep").join(answers, F.col("rep") == F.col("q"))
                         .join(sizes, ["h1", "h2"]).select(F.struct("h1", "h2").alias("key"), "near", "size"))
    asked_rows = asking.select("vec_id", F.struct("h1", "h2").alias("key"))
    given = attach(asked_rows, facts, "key", "size", asking.count())
    own = F.filter("near", lambda x: x["vec_id"] != F.col("vec_id"))
    return given.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("i", "hit")).select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _widened(queries: DataFrame, index: DataFrame, tree: Tree, held: np.ndarray, k: int, target: float) -> int:
    """Leaves to visit for the target recall of the calibration queries (a bounded set, compared
    with all vectors)."""
    few = queries.orderBy(F.xxhash64("q")).limit(CALIBRATION).toPandas()
    if not len(few):
        return 1
    asks, names = np.array(few["vec"].tolist()), few["q"].to_numpy()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                ids = pdf["rep"].to_numpy()
                out = _top(asks, names, np.array(pdf["vec"].tolist()), ids, k + 1)
                yield out.assign(leaf=pdf.set_index("rep")["leaf"].reindex(out["rep"]).to_numpy())

    near = index.select("rep", "vec", "leaf").mapInPandas(exact, "q bigint, rep bigint, score double, leaf int")
    top = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "rep")))
    truth = top.filter(F.col("r") <= k + 1).select("q", "leaf").toPandas()
    needed = []
    for q, vec in zip(names, asks, strict=True):
        place = {leaf: i + 1 for i, leaf in enumerate(tree.visits(vec, tree.leaves, held, 0))}
        needed += [place[leaf] for leaf in truth.loc[truth["q"] == q, "leaf"]]
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]
