"""Joins on hot words, and phrases from a table."""

import pytest
from pyspark.sql import functions as F

from commentmill.functions.hot import join_keys
from commentmill.operators import clean


def test_a_hot_key_is_spread(spark):
    n = 30_000
    rows = spark.range(0, n, 1, 8).select(F.col("id"), F.when(F.col("id") % 3 == 0, "the").when(
        F.col("id") % 3 == 1, F.concat(F.lit("w"), (F.col("id") % 5000).cast("string"))).alias("word"))
    table = spark.createDataFrame([("the", 0), *((f"w{i}", i) for i in range(0, 5000, 2))], "word string, v int")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(kept, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        got = join_keys(rows, table, "word")
        tasks = [r["count"] for r in got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
        assert max(tasks) <= 2 * sorted(tasks)[len(tasks) // 2]
        plain = rows.join(table, "word")
        assert sorted(got.collect()) == sorted(plain.collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 3, 1000])
def test_small_joins(spark, parts):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c"), (5, "c")], "id int, k string")
    table = spark.createDataFrame([("a", 1), ("c", 2), ("d", 3)], "k string, v int")
    assert sorted(map(tuple, join_keys(rows, table, "k", parts).collect())) == [
        ("a", 1, 1), ("a", 2, 1), ("c", 5, 2), ("c", 5, 2)]
    assert join_keys(rows.limit(0), table, "k", parts).count() == 0
    assert join_keys(rows, table.limit(0), "k", parts).count() == 0


TEXTS = ["We CAN'T, (won't) stop", "thx, U r gr8 u u", "", None, " u  \t r\n", "no hits here", "no hits here",
         "u.r x-u 'u' u' “u” u’re", "u " * 3000]


def test_phrase_table_equals_the_map(spark):
    phrases = {"u": "you", "r": "are", "can't": "can not", "won't": "will not", "thx": "thanks $1 \\ x", "b/c": "because"}
    df = spark.createDataFrame([(t, "clash") for t in TEXTS], "text string, _token string")
    table = spark.createDataFrame([*phrases.items(), ("U", "zzz"), (None, "n"), ("no", None)], "token string, phrase string")
    got = clean.map_tokens_table(df, "text", table)
    assert got.columns == ["text", "_token", "processed_text"]
    want = df.withColumn("processed_text", clean.map_tokens(F.coalesce("text", F.lit("")), phrases))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert clean.map_tokens_table(df, "text", table.limit(0)).filter("coalesce(text, '') = processed_text").count() == len(TEXTS)
    assert clean.map_tokens_table(df.limit(0), "text", table).count() == 0


def test_many_phrases(spark):
    df = spark.range(300).select("id", F.concat_ws(" ", *[((F.col("id") * 7 + i * 991) % 60_000).cast("string") for i in range(20)]).alias("text"))
    table = spark.range(50_000).select(F.col("id").cast("string").alias("token"), F.concat(F.lit("n"), "id").alias("phrase"))
    got = clean.map_tokens_table(df, "text", table)
    for r in got.collect():
        assert r["processed_text"] == " ".join(f"n{t}" if int(t) < 50_000 else t for t in r["text"].split(" "))


@pytest.mark.parametrize("sent", [0, 2, 1_000_000])
def test_phrases_meet_the_rows_whether_sent_or_joined_and_no_row_is_written(spark, monkeypatch, sent):
    phrases = {"u": "you", "r": "", "can't": "can not", "thx": "thanks $1 \\ x", "ıd": "long " * 300, **{f"w{i}": f"<{i}>" for i in range(90)}}
    texts = [*TEXTS, "W7 w7, ıD w8 x-w9", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(200)), "w3 " * 500]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, processed_text int").repartition(3)
    table = spark.createDataFrame([*phrases.items(), ("u", "zzz")], "token string, phrase string")
    written, kept = [], clean.materialized

    def counted(rows):
        out = kept(rows)
        written.append(out.count())
        return out

    monkeypatch.setattr(clean, "materialized", counted)
    monkeypatch.setattr(clean, "SENT_LINES", sent)
    monkeypatch.setattr(clean, "OFTEN", 2)
    monkeypatch.setattr(clean, "PIECES_AT_ONCE", 50)
    got = clean.map_tokens_table(df, "text", table, "out")
    want = df.withColumn("out", clean.map_tokens(F.coalesce("text", F.lit("")), phrases))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert max(written) < 250  # distinct tokens, not rows, pieces or words: the texts have more than 4,000
    again = clean.map_tokens_table(df, "text", table)
    assert again.columns == ["text", "processed_text"]
