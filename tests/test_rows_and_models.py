"""Row operators, profiles, metrics, splits and models."""

import math

import pytest
from pyspark.sql import functions as F

from commentmill.operators import metrics, model, profile, rows
from commentmill.operators.features import tfidf_pipeline
from commentmill.operators.knn import KNNClassifier


@pytest.fixture(scope="module")
def hundred(spark):
    return spark.createDataFrame([(n, f"row {n}") for n in range(1, 101)], "row_id bigint, text string")


def ids(df):
    return [r["row_id"] for r in df.collect()]


def test_sampling(hundred, monkeypatch):
    assert ids(rows.sample_rows(hundred, 500)) == list(range(1, 101))
    some = ids(rows.sample_rows(hundred, 10))
    assert len(some) == 10 and some == sorted(some) and some != list(range(1, 11))
    assert some == ids(rows.sample_rows(hundred.repartition(7), 10))
    with pytest.raises(ValueError):
        rows.sample_rows(hundred, 0)
    assert some == ids(rows.sample_rows(hundred, 10))


def test_row_ids(spark):
    df = spark.range(50, numPartitions=7).select(F.col("id").alias("v"))
    assert sorted((r["v"], r["row_id"]) for r in rows.with_row_id(df).collect()) == [(i, i + 1) for i in range(50)]


def test_edits_leave_labels_and_other_rows(spark, hundred):
    base = hundred.withColumn("label", F.lit("y"))
    edits = spark.createDataFrame([(2, "new", "n"), (150, "x", "n")], "row_id bigint, text string, label string")
    out = {r["row_id"]: (r["text"], r["label"]) for r in rows.apply_edits(
        base, edits, row_id="row_id", text_col="text", label_col="label", edited_page=0, size=3).collect()}
    assert len(out) == 100 and out[1] == ("", "y") and out[2] == ("new", "y") and out[3] == ("", "y")
    assert out[4] == ("row 4", "y")


def test_columns_and_pages(spark, hundred):
    assert rows.preview_columns(["a", "clean_text", "has_profanity", "t", "processed_text"], "t") == [
        "t", "processed_text", "clean_text", "a"]
    df = spark.createDataFrame([(1, "t", "p")], "row_id int, text string, processed_text string")
    assert rows.active_text_column(df, "text") == "processed_text"
    assert rows.drop_stale(df.withColumn("clean_text", F.lit("")), "processed_text").columns == df.columns
    assert ids(rows.page_of(hundred, 1, size=40)) == list(range(41, 81))
    assert tuple(rows.page_count(hundred, 30).first()) == (100, 4)


def test_bands_and_first_per_key(spark):
    df = spark.createDataFrame([(-5,), (34,), (35,), (69,), (70,), (400,)], "o int")
    assert [r[0] for r in df.select(rows.severity_band(F.col("o"))).collect()] == [
        "low", "low", "medium", "medium", "high", "high"]
    twice = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, pos int, v string")
    assert sorted(tuple(r) for r in rows.first_per_key(twice, "k", "pos").collect()) == [(1, 1, "a"), (2, 5, "c")]


def test_profile(spark):
    df = spark.createDataFrame([(i, "word " * (i % 7 + 1), "ab"[i % 2], "x") for i in range(40)],
                               "id int, body string, cls string, one string")
    assert profile.detect_text_column(df) == "body" and profile.detect_label_column(df, "body") == "cls"
    assert profile.detect_text_column(df.select("id")) == "id"
    assert profile.validate_training_pair(df, "body", "cls") == (True, "")
    assert not profile.validate_training_pair(df, "body", "body")[0]
    assert not profile.validate_training_pair(df, "body", "id")[0]
    assert not profile.validate_training_pair(df.limit(0), "body", "cls")[0]
    long = spark.range(300).select(F.lit("t").alias("t"), F.concat(
        F.lit("l" * 90), (F.col("id") % 60).cast("string")).alias("y"))
    assert not profile.validate_training_pair(long, "t", "y")[0]


def test_metrics(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 2 + [("b", "c")]
    df = spark.createDataFrame(pairs, "y string, p string")
    f = {"a": 2 * 5 / (7 + 5), "b": 2 * 2 / (3 + 4), "c": 0.0}
    got = metrics.summary(df, "y", "p").first()
    assert got["accuracy"] == 0.7 and got["f1_macro"] == round(sum(f.values()) / 3, 4)
    assert got["f1_weighted"] == round((7 * f["a"] + 3 * f["b"]) / 10, 4)
    report = {r["name"]: r for r in metrics.report(df, "y", "p").collect()}
    assert report["c"]["support"] == 0 and report["weighted avg"]["support"] == 10
    assert report["a"]["precision"] == 1.0 and report["b"]["recall"] == 0.6667


def test_exact_split(spark):
    df = spark.range(103).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "r").otherwise("c").alias("y"))
    got = [sorted((r["k"], r["is_test"]) for r in model.split_exact(
        df.repartition(n), key="k", label_col="y").collect()) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 103
    test = [k for k, t in got[0] if t]
    assert len(test) == math.ceil(103 * 0.2) and sum(k % 10 == 0 for k in test) == 2
    lonely = df.withColumn("y", F.when(F.col("k") == 5, "x").otherwise("c"))
    assert model.split_exact(lonely, key="k", label_col="y").filter("is_test").count() == 21


TOPICS = {"a": "red apple sweet fruit tree", "b": "fast car engine road wheel", "c": "deep blue sea water fish"}


@pytest.fixture(scope="module")
def labelled(spark):
    lines = []
    for i in range(90):
        y = "abc"[i % 3]
        w = TOPICS[y].split()
        lines.append((i, " ".join([w[i % 5], w[(i + 1) % 5], w[(i * 2) % 5], "common", f"w{i % 11}"]), y))
    lines += [(100 + i, "red apple red apple", "a") for i in range(30)]  # a copy group
    return spark.createDataFrame(lines, "k bigint, text string, y string").cache()


def tfidf(train, texts):
    import re
    grams = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])(re.findall(r"\w\w+", t.lower()))
    n, df = len(train), {}
    for t in train:
        for g in set(grams(t)):
            df[g] = df.get(g, 0) + 1
    out = []
    for t in texts:
        v = {}
        for g in grams(t):
            if g in df:
                v[g] = v.get(g, 0) + math.log((1 + n) / (1 + df[g])) + 1
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        out.append({g: x / norm for g, x in v.items()})
    return out


def test_tfidf_and_knn_match_brute_force(spark, labelled):
    train = labelled.filter("k % 4 <> 0")
    test = labelled.filter("k % 4 = 0").unionByName(
        spark.createDataFrame([(900, "nothing shared", "a"), (901, "", "a")], labelled.schema))
    tr, te = train.orderBy("k").collect(), test.orderBy("k").collect()
    vt = tfidf([r["text"] for r in tr], [r["text"] for r in tr])
    vs = tfidf([r["text"] for r in tr], [r["text"] for r in te])
    pipe = tfidf_pipeline(train, "text", key="k")
    vocab = pipe.stages[4].vocabulary
    for r, want in zip(pipe.transform(test).orderBy("k").collect(), vs):
        f = r["features"]
        got = {vocab[i]: x for i, x in zip(f.indices, f.values)}
        assert set(got) == set(want) and all(abs(got[g] - want[g]) < 1e-9 for g in got)

    fitted = KNNClassifier(k=7).fit(train, text_col="text", label_col="y", key="k")
    got = {r["k"]: r["prediction_label"] for r in fitted.predict(test).collect()}
    assert len(got) == len(te)
    for r, v in zip(te, vs):
        sims = sorted((-round(sum(x * w.get(g, 0) for g, x in v.items()), 9), t["k"], t["y"]) for t, w in zip(tr, vt))[:7]
        votes = {}
        for _, _, y in sims:
            votes[y] = votes.get(y, 0) + 1
        assert got[r["k"]] == min(votes, key=lambda y: (-votes[y], y)), r


def test_models(spark, labelled, tmp_path):
    table = {"Naive Bayes": model.MODELS["Naive Bayes"], "KNN": model.MODELS["KNN"]}
    result = model.investigate(labelled, text_col="text", label_col="y", key="k", models=table).collect()
    assert {r["Model"] for r in result} == set(table) and result[0]["F1_Macro"] >= result[1]["F1_Macro"] > 0.9
    fitted, scores, report = model.train_selected(labelled, "Naive Bayes", text_col="text", label_col="y", key="k")
    row = scores.first()
    assert (row["samples_train"], row["samples_test"]) == (96, 24) and report.count() == 6
    fitted.save(str(tmp_path / "m"))
    again = model.Trained.load(str(tmp_path / "m"), "Naive Bayes", "text")
    text = spark.createDataFrame([(1, "a fast engine")], "k int, text string")
    assert again.predict(text).first()["prediction_label"] == "b"
    with pytest.raises(ValueError):
        model.train_selected(labelled, "Oracle", text_col="text", label_col="y", key="k")
    with pytest.raises(ValueError):
        model.investigate(labelled.limit(5), text_col="text", label_col="y", key="k")


def test_neighbours_take_the_features_that_are_fitted(spark, labelled, monkeypatch):
    from commentmill.operators import knn
    only = {"KNN": model.MODELS["KNN"]}
    want = model.investigate(labelled, text_col="text", label_col="y", key="k", models=only).collect()
    monkeypatch.setattr(knn, "vocabulary", None)  # not counted again
    assert model.investigate(labelled, text_col="text", label_col="y", key="k", models=only).collect() == want


def test_comparison_runs_the_real_models(spark, labelled, monkeypatch):
    from commentmill.plans import catalog
    asked = {}
    monkeypatch.setattr(catalog, "_labelled", lambda spark, sf_dir: labelled)
    monkeypatch.setattr(catalog.model, "investigate", lambda df, **given: asked.update(given) or df)
    assert catalog.model_comparison(spark, "") is labelled
    assert asked.get("models") in (None, model.MODELS) and asked.get("size") in (None, model.VOCABULARY)


@pytest.mark.parametrize("shape", ["join", "repartition", "dedupe"])
def test_row_ids_survive_adaptive_shuffles(spark, shape):
    from commentmill.operators.rows import with_row_id
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(5000).withColumn("text", F.concat(F.lit("some longer text "), (F.col("id") % 4000).cast("string")))
        if shape == "join":
            df = df.join(spark.range(0, 5000, 2), "id")
        elif shape == "repartition":
            df = df.repartition("text")
        else:
            df = df.dropDuplicates(["text"])
        n = df.count()
        got = sorted(r["row_id"] for r in with_row_id(df).select("row_id").collect())
        assert got == list(range(1, n + 1))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_samples_of_repeated_keys_have_the_asked_size(spark):
    from commentmill.operators.rows import sample_rows
    df = spark.createDataFrame([(i % 7, f"t{i % 20}") for i in range(140)], "k int, t string")
    for n in (1, 50, 139, 140, 500):
        got = sample_rows(df, n, key="k")
        assert got.count() == min(n, 140)
    assert sorted(sample_rows(df, 50, key="k").collect()) == sorted(sample_rows(df.repartition(5), 50, key="k").collect())


def test_missing_labels_are_a_class(spark):
    from commentmill.operators import metrics, model
    df = spark.createDataFrame([(i, f"word{i % 5} text", None if i % 4 == 0 else f"y{i % 2}") for i in range(100)],
                               "id int, text string, y string")
    split = model.split_exact(df, key="id", label_col="y")
    assert split.filter("is_test").count() == 20 and split.filter("is_test AND y IS NULL").count() == 5
    assert {r["label"] for r in metrics.class_counts(df, "y").collect()} == {"", "y0", "y1"}
    fitted, scores, _ = model.train_selected(df, "Naive Bayes", text_col="text", label_col="y", key="id")
    assert scores.first()["samples_test"] == 20
    named = df.withColumn("y", F.when(F.col("y") == "y0", "").otherwise(F.col("y"))).filter("y IS NOT NULL")
    parts = model.split_exact(named, key="id", label_col="y").filter("is_test").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in parts} == {"": 5, "y1": 10}


def test_vocabulary_moves_no_line_per_document_and_term(spark):
    from commentmill.operators import features

    own = spark.createDataFrame([(1, "aa bb aa"), (2, "bb aa"), (3, None), (None, "cc")], "k int, t string")
    shared = spark.createDataFrame([(2, "aa cc"), (None, "cc dd")], "k int, t string")
    alone, both = features.vocabulary(own, "t", "k"), features.vocabulary(own.unionByName(shared), "t", "k")
    assert "hashpartitioning(k" not in alone._jdf.queryExecution().executedPlan().toString()
    assert {r["term"]: (r["total"], r["df"]) for r in alone.collect()} == {
        "aa": (3, 2), "bb": (2, 2), "cc": (1, 1), "aa bb": (1, 1), "bb aa": (2, 2)}
    assert {r["term"]: (r["total"], r["df"]) for r in both.collect()} == {
        "aa": (4, 2), "bb": (2, 2), "cc": (3, 2), "dd": (1, 1), "aa bb": (1, 1), "bb aa": (2, 2),
        "aa cc": (1, 1), "cc dd": (1, 1)}
