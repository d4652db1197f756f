"""Duplicates, near duplicates, sharding, mixing, neighbours and the pipeline."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from commentmill.llm import (
    ann_tree, bloom_dedup, common, mix_budget, permutation_shards, queries, tensor_minhash,
)

SF = "/root/testdata/sf0.001"


def plain_near(rows, width, percent=80):
    """doc_id -> (size, smallest id reachable), by comparing all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def family_rows(seed=1):
    """A crowd of near copies of one text with some to many words changed, single copies, odd rows."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [draw.choice(words) for _ in range(120)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 4])):
            t[draw.randrange(len(t))] = draw.choice(words) + str(i)
        rows.append((i, " ".join(t)))
    common_line = " ".join(draw.choice(words) for _ in range(30))
    rows += [(100 + i, common_line + " " + " ".join(draw.choice(words) + str(i) for _ in range(25))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, "one two three"), (205, " \t\n"), (206, "one two")]
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, width):
    rows = family_rows(width)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in tensor_minhash.near_duplicates(df, width=width).collect()}
    assert got == plain_near(rows, width)
    kept = {r.doc_id for r in tensor_minhash.drop_near_duplicates(df, width=width).collect()}
    assert kept == {d for d, (_, c) in got.items() if d == c}


def test_near_duplicates_of_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in tensor_minhash.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True)]
    assert tensor_minhash.near_duplicates(df.limit(0)).count() == 0
    # of the row that stands twice one stays
    assert tensor_minhash.drop_near_duplicates(df).count() == 2


def test_components_of_a_path(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.root for r in common.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert common.components(links.limit(0)).count() == 0


def test_exact_duplicates(spark):
    rows = [(i, "Same Text" if i % 3 == 0 else f"text {i}", "x") for i in range(600)]
    rows += [(1000, None, "y"), (1001, "", "y"), (1002, "ÄB", "z"), (1003, "äb", "z"), (1004, "Äb", "z"), (None, "text 1", "q"),
             (1005, "twice", "t"), (1005, "twice", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[(t or "").translate(lower)].append(d)
    got = bloom_dedup.find_duplicates(df).collect()
    want = Counter((d, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    kept = bloom_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.doc_id for r in got if r.kept})
    assert bloom_dedup.find_duplicates(df.limit(0)).count() == 0
    left = bloom_dedup.drop_listed(df, spark.createDataFrame([(3,), (None,), (5,)], "i bigint"), "doc_id")
    assert left.count() == len(rows) - 2


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(bloom_dedup, "filter_words", lambda rows: 1)
    df = spark.createDataFrame([(i, f"t{i % 150}") for i in range(200)], "doc_id bigint, text string")
    assert bloom_dedup.find_duplicates(df).filter("kept").count() == 150


def test_shard_table_is_even_and_stable():
    names = [f"s{i}" for i in range(16)]
    full = permutation_shards.fill_table(names, 2039)
    assert set(Counter(full).values()) == {127, 128}
    less = permutation_shards.fill_table(names[:-1], 2039)
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 15)
    assert moved < 0.15 * 2039
    with pytest.raises(ValueError):
        permutation_shards.fill_table(names, 2040)


def test_shards_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id bigint, shard string")
    got = permutation_shards.assign_shards(df, "doc_id").collect()
    assert len(got) == 3 and all(r.shard.startswith("shard-") for r in got)
    assert got[0].slot == got[1].slot or {r.slot for r in got if r.doc_id == 1} == {got[0].slot}
    assert permutation_shards.assign_shards(df.limit(0), "doc_id").count() == 0


def plain_shares(amount, weights, caps):
    """Real-valued water filling."""
    given, open_ = {}, {k for k in caps if weights[k] > 0}
    while open_:
        rest, w = amount - sum(given.values()), sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] <= rest * weights[k] / w}
        if not full:
            return given | {k: rest * weights[k] / w for k in open_}
        given |= {k: caps[k] for k in full}
        open_ -= full
    return given


def test_shares_fill_siblings_first(spark):
    draw = random.Random(3)
    for _ in range(6):
        caps = {f"k{i}": draw.randrange(0, 100) for i in range(7)}
        weights = {k: draw.randrange(0, 5) for k in caps}
        amount = min(draw.randrange(0, 400), sum(c for k, c in caps.items() if weights[k]))
        df = spark.createDataFrame([("p", k, caps[k], weights[k], amount) for k in caps], "p string, k string, cap long, weight long, amount long").selectExpr(
                                   "p", "k", "CAST(cap AS DECIMAL(20,0)) cap", "CAST(weight AS DECIMAL(9,0)) weight", "CAST(amount AS DECIMAL(20,0)) amount")
        got = {r.k: int(r.given) for r in mix_budget.share_out(df, ["p"], "k").collect()}
        want = plain_shares(amount, weights, caps)
        assert set(got) == set(want) and sum(got.values()) == amount
        assert all(abs(got[k] - want[k]) <= 1 and got[k] <= caps[k] for k in got)


def test_mixing_odd_rows_and_epochs(spark):
    rows = [(i, "a b c d e", "en", "src0", "x") for i in range(20)] + [(30, "a b", None, None, "x"), (31, None, "en", "src0", "x"),
                                                                     (32, "q r s", "fr", "src1", "x"), (32, "q r s", "fr", "src1", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, tokens string")
    mix = mix_budget.Mix(weights={"lang": {"fr": 100}}, share=50, epochs=3)
    got = mix_budget.mix_sources(df, F.lit("d"), mix).collect()
    taken = Counter((r.doc_id, r["__epoch"]) for r in got)
    assert taken[32, 0] == taken[32, 1] == taken[32, 2] == 2  # the heavy leaf is used up, thrice
    assert sum(r["__tokens"] for r in got) in range(54, 54 + 10)  # half of 108, whole rows
    assert mix_budget.mix_sources(df.limit(0), F.lit("d"), mix).count() == 0
    again = mix_budget.mix_sources(df.repartition(5), F.lit("d"), mix).collect()
    assert Counter((r.doc_id, r["__epoch"]) for r in again) == taken


def test_sources_without_weight_leave_their_share_to_siblings(spark):
    rows = [(i, "a", "en", "src0") for i in range(100)] + [(100 + i, "a", "en", "src1") for i in range(20)]
    rows += [(200 + i, "a", "fr", "src1") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    mix = mix_budget.Mix(weights={"source": {"src0": 0}}, budget=100, epochs=1)
    got = Counter((r.lang, r.source) for r in mix_budget.mix_sources(df, F.lit("d"), mix).collect())
    assert got == {("en", "src1"): 20, ("fr", "src1"): 80}


def plain_near_vectors(rows, k=20):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in ok:
        if q % 20 == 0:
            score = sorted(((-float(np.dot(ok[q], v)), i) for i, v in ok.items() if i != q))[:k]
            out[q] = [i for _, i in score]
    return out


def test_neighbours_against_brute_force(spark):
    draw = np.random.Generator(np.random.PCG64(8))
    rows = [(i, draw.normal(size=16).tolist()) for i in range(2000)]
    rows += [(3000 + i, [1.0] * 16) for i in range(200)]  # a group of copies
    rows += [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in ann_tree.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = plain_near_vectors(rows)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    assert got[3000] == want[3000]  # ties go to smaller ids


def test_neighbours_reach_the_target_recall(spark):
    draw = np.random.Generator(np.random.PCG64(9))
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(6000, 32)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in ann_tree.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    want = plain_near_vectors(rows)
    # the target of 0.97, less three standard errors of 128 calibration queries
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.955


def test_neighbours_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann_tree.search(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann_tree.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_against_plain_versions(spark):
    docs = queries.table(spark, SF, "documents")
    rows = {n: f for n, f in corpus_pipeline.STAGES}
    good = rows["quality"](spark, docs, SF).cache()
    scores = {r.doc_id: r.predicted for r in queries.op4_quality_rff(spark, SF).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, p in scores.items() if p}
    once = rows["exact_dedup"](spark, good, SF).cache()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for r in good.collect():
        key = r.text.translate(lower)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(last.values())
    near = rows["near_dedup"](spark, once, SF).cache()
    groups = plain_near([(r.doc_id, r.text) for r in once.collect()], 5)
    assert {r.doc_id for r in near.collect()} == {d for d, (_, c) in groups.items() if c == d}
    mixed = rows["mix"](spark, near, SF).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    coded = rows["encode"](spark, mixed, SF)
    assert coded.count() == mixed.count() and coded.filter("n_tokens = 0").count() == mixed.filter("text = ''").count()


def test_a_crowded_set_is_one_row_and_a_task_connects_its_own_edges(spark, monkeypatch):
    """A set is given its component once, however many crowded buckets it is in; edges that fit in one
    task need no rounds, and several tasks give the same."""
    sig = [[7] * 20] * 40
    reps = spark.createDataFrame([(i, 30, s) for i, s in enumerate(sig)], "rep bigint, n bigint, sig array<int>")
    pairs, crowd = tensor_minhash._candidates(reps)
    assert crowd.count() == 40 and {len(r.at) for r in crowd.collect()} == {100}
    assert {x for r in pairs.collect() for x in (r.a, r.b)} == set(range(40))
    roots = spark.createDataFrame([(i, 0) for i in range(39)], "node bigint, root bigint")
    assert tensor_minhash._tagged(crowd, roots).select("rep", "root").distinct().count() == 40
    chain = spark.range(200).filter("id % 50 != 49").selectExpr("id AS a", "id + 1 AS b")
    one = {r.node: r.root for r in common.components(chain, rounds=0).collect()}
    monkeypatch.setattr(common, "EDGES_PER_TASK", 40)
    several = {r.node: r.root for r in common.components(chain).collect()}
    assert one == several == {i: i // 50 * 50 for i in range(200)}
