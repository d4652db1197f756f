"""Queries that SQL can express against that SQL, on the smallest tables."""

import os

import pytest

from commentmill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    order = [d[0] for d in want.description]
    cols = sorted(order)
    assert cols == sorted(got.columns)
    a = sorted(tuple(r[c] for c in cols) for r in got.collect())
    assert a == sorted(tuple(r[order.index(c)] for c in cols) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op6_permutation_shards", "op7_bloom_dedup"])
def test_native_plans_hold_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))
