"""Scoring jobs, files and run history."""

import json

import pytest
from pyspark.sql import functions as F

from commentmill.operators.clean import CleanConfig
from commentmill.plans import scoring
from commentmill.plans.lexicon_scorer import lexicon_scorer
from commentmill.plans.workbench import Workbench
from commentmill.sources import datasets, history

TEXTS = [f"text {i} " + ("damn shit" if i % 5 == 0 else "fine") for i in range(1, 61)] + ["  ", None, "!!!"]


@pytest.fixture(scope="module")
def items(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS, 1)), "row_id bigint, text string")
    return df, scoring.prepared(df, "text", CleanConfig(remove_punctuation=True)).cache()


def python_scorer():
    """Answers like a model: skips row 7 in company, row 9 always has a bad score."""

    def score(prompt):
        ids = [int(x.split(":")[0]) for x in prompt.splitlines()]
        if len(ids) > 1 and 20 in ids:
            raise RuntimeError("out of memory")
        out = [{"row_id": i, "overall_score": 200 if i == 9 else i, "scores": [i, 0, 0, 0, 0, 0],
                "category": [], "toxicity_level": "low", "toxicity_type": []}
               for i in ids if i != 7 or len(ids) == 1]
        return json.dumps(out + [{"row_id": 9999}])

    return score


@pytest.mark.parametrize("max_rows", [1, 4])
def test_scores_do_not_depend_on_batching(items, max_rows):
    source, ready = items
    s = scoring.score_dataset(ready, python_scorer, max_rows=max_rows, budget=200)
    assert sorted((r["row_id"], r["overall_score"]) for r in s.results.collect()) == [
        (i, i) for i in range(1, 61) if i != 9]
    assert [r["row_id"] for r in s.failed.collect()] == [9]
    row = scoring.summarize(source, "text", s).first()
    assert (row["rows"], row["analyzed"], row["skipped"], row["emptied"], row["errors"]) == (63, 59, 2, 1, 1)
    assert (row["toxic"], row["non_toxic"]) == (41, 18)
    assert row["avg_overall_score"] == round((sum(range(1, 61)) - 9) / 59)
    top = scoring.top_examples(scoring.row_results(s)).collect()
    assert [r["row_number"] for r in top] == [60, 59, 58, 57, 56]
    assert scoring.error_report(s.failed).first()["n_more"] == 0


def test_the_scorers_message_is_reported(items):
    source, ready = items

    def failing():
        def score(prompt):
            raise OSError("disk gone")
        return score

    s = scoring.score_dataset(ready.filter("row_id <= 3"), failing, max_rows=2)
    assert {r["error"] for r in s.failed.collect()} == {"OSError: disk gone"}
    text = scoring.full_report(source, "text", s, shown=2).first()["report"]
    assert "row 1: OSError: disk gone" in text and "and 1 more" in text


def test_full_report_shows_the_highest_rows(items):
    source, ready = items
    s = scoring.score_dataset(ready, python_scorer, max_rows=4, budget=200)
    text = scoring.full_report(source, "text", s).first()["report"]
    assert "row 60 at 60%" in text and "row 56 at 56%" in text and "row 55 " not in text and "row 9:" in text


def test_packing_is_greedy(items):
    _, ready = items
    got = {r["row_id"]: r["batch_id"] for r in scoring.pack(ready, max_rows=3, budget=60).collect()}
    batch, n, used = 0, 0, 0
    for i in range(1, 61):
        if (i - 1) % 48 == 0:
            batch, n, used = 0, 0, 0
        cost = len(TEXTS[i - 1].split()) + 16
        if n and (used + cost > 60 or n >= 3):
            batch, n, used = batch + 1, 0, 0
        n, used = n + 1, used + cost
        assert got[i] == f"{(i - 1) // 48}.{batch}"
    assert len(got) == 60
    with pytest.raises(ValueError):
        scoring.pack(ready, max_rows=25)
    assert scoring.input_budget(4096) == 943 and scoring.input_budget(100) == 512


def test_single_text(spark):
    r = scoring.single_text(spark, "you damn fool", lexicon_scorer()).first()
    assert (r["overall_score"], r["toxicity"], r["level"], r["types"]) == (35, 30, "Medium", "Insult")
    with pytest.raises(ValueError):
        scoring.single_text(spark, "  ", lexicon_scorer())
    run = history.single_run(scoring.single_text(spark, "damn", lexicon_scorer()), user_id=1, text="damn\nx").first()
    assert run["toxic_count"] == 1 and run["summary"].startswith("Overall: 35% | Toxicity: 30%")


def test_nothing_to_analyze(spark, items):
    source = items[0].limit(0)
    s = scoring.score_dataset(scoring.prepared(source, "text", CleanConfig()), lexicon_scorer())
    with pytest.raises(ValueError):
        scoring.require_analyzed(scoring.summarize(source, "text", s))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"a ""b""\nc"\n2,\n')
    assert [tuple(r) for r in datasets.load_dataset(spark, str(tmp_path / "a.csv"), multiline=True).collect()] == [(1, 'a "b"\nc'), (2, None)]
    (tmp_path / "a.json").write_text(json.dumps([{"text": "x"}, {"text": "y"}]))
    assert datasets.load_dataset(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "a.txt").write_bytes("one\r\n\ntwo three\x0bfour\xe9".encode() + b"\xff\n")
    assert [r[0] for r in datasets.load_dataset(spark, str(tmp_path / "a.txt")).collect()] == [
        "one", "", "two", "three", "four\xe9�"]
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, "a.bin")


def test_workbench_and_export(spark, tmp_path):
    df = spark.createDataFrame([(i, f"This is DAMN text {i}!!!", i % 2) for i in range(30)], "n int, body string, y int")
    bench = Workbench.of(df)
    assert (bench.text_col, bench.label_col) == ("body", "y") and "row_id" in bench.df.columns
    done = bench.clean().scan().sanitize()
    assert done.active == "clean_text" and done.df.filter("has_profanity").count() == 30
    done.export(str(tmp_path / "out"))
    back = datasets.read_csv(spark, str(tmp_path / "out"))
    assert back.count() == 30 and back.filter(F.col("clean_replacements") == "damn").count() == 30


def test_history(spark, tmp_path):
    log = history.RunHistory(spark, str(tmp_path / "runs"))
    assert log.read().count() == 0 and history.totals(log.read()).first()["comments_analyzed"] == 0
    cols = ("user_id int, run_type string, source_filename string, row_count int, toxic_count int, "
            "non_toxic_count int, summary string")
    new = [(1, "single", None, 1, 1, 0, "Overall: 5%\nbody"), (2, "dataset", "f", 9, 2, 7, "x")]
    assert log.append(spark.createDataFrame(new, cols)) == 1
    assert log.append(spark.createDataFrame(new[:1], cols)) == 3
    assert [r["id"] for r in history.runs_of_user(log.read(), 1).collect()] == [3, 1]
    assert history.run_of_owner(log.read(), 2, 1).count() == 0
    log.update_results_path(spark.createDataFrame([(2, "/r")], "id bigint, results_path string"))
    assert {r["id"]: r["results_path"] for r in log.read().collect()} == {1: None, 2: "/r", 3: None}
    assert history.totals(log.read()).first()["toxic_percent"] == 36.4
    assert history.timeline(log.read()).collect()[0]["comments"] == 11
    assert log.clear_user(1) == 2 and log.clear_user(1) == 0 and log.read().count() == 1


def test_raw_answers_can_be_kept(items):
    _, ready = items
    s = scoring.score_dataset(ready.filter("row_id <= 4"), python_scorer, max_rows=2, keep_raw=True)
    assert all(f'"row_id": {r["row_id"]}' in r["raw"] for r in s.results.collect())
