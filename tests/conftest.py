import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package and the test modules by name.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from commentmill.session import local_session

    session = local_session("tests", 8, "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a text expression on a list of texts."""
    from pyspark.sql import functions as F

    def run(expr, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
        out = df.select("i", expr(F.col("t")).alias("o")).collect()
        return [r["o"] for r in sorted(out, key=lambda r: r["i"])]

    return run
