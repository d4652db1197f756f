"""Every catalogue query against its SQL on the smallest tables."""

import math
import os

import pytest

from commentmill.plans import catalog, oracles

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SQL = oracles.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    cols = sorted(d[0] for d in want.description)
    assert cols == sorted(got.columns)
    order = [d[0] for d in want.description]
    a = sorted((tuple(tidy(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(tidy(r[order.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert a == b


def test_every_other_query_is_known():
    assert set(catalog.QUERIES) - set(SQL) == {"model_comparison", "logistic_metrics", "svm_metrics",
                                                "forest_metrics"}


def test_plans(spark):
    """No row-at-a-time Python, no cross join, nothing gathered into one partition."""
    for name in ("clean_configured", "scan_documents", "mask_profanity", "augment_swap",
                 "history_newest_per_user", "split_hashed", "edited_rows"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        for word in ("BatchEvalPython", "CartesianProduct", "SinglePartition"):
            assert word not in plan, (name, word)
    newest = catalog.history_newest_per_user(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in newest  # each map task sends at most the limit per user
