"""op1 learns from every document, however the examples are added up."""

import numpy as np

from commentmill.llm import pii_boost


def test_trees_do_not_depend_on_who_adds_up(spark, monkeypatch):
    rows = [(i, f"call +1 {200 + i % 700} {100 + 7 * i % 900} {1000 + 37 * i % 9000} or write a{i}@host{i % 9}.org at {i}.{i % 250}.7.1")
            for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(pii_boost, "TREES", 3)
    model = pii_boost.train(docs, "text")
    assert model.thresholds.keys() == set(pii_boost.SHAPES)
    monkeypatch.setattr(pii_boost, "LINES_PER_TASK", 100)
    tasks = pii_boost.train(docs.unionByName(docs), "text")  # equal texts count once
    for a, b in zip(model.feature + model.cut + model.value, tasks.feature + tasks.cut + tasks.value, strict=True):
        assert np.allclose(a, b, equal_nan=True)
    assert model.thresholds == tasks.thresholds
