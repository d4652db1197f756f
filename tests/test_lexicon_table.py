"""Lexicons as tables: what the list forms give, and cases by hand."""

import pytest
from pyspark.sql import functions as F

from commentmill.functions.cut import materialized, spread
from commentmill.operators import lexicon_table, profanity
from test_profanity import FOUND, MASKED, TERMS

TEXTS = [*FOUND, *MASKED, None, "trash's TRASH'S trash'sx trashes's 's s's", "tr_ash _trash trash_ t_r_a_s_h", "id iot's",
         "t r a s h t-r-a-s-h s t u p i d", "ＴＲＡＳＨ trásh ÉTRASH", "tr trash ash", "a " * 500 + "m o r o n",
         "t r a s h", "t r a s h"]


def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(3)


def by_id(df, *cols):
    return {r["i"]: tuple(r[c] for c in cols) for r in df.collect()}


def lines(spark, terms):
    return spark.createDataFrame([(t,) for t in terms], "term string")


@pytest.fixture(params=[lexicon_table.BROADCAST_BYTES, 0], ids=["broadcast", "shuffled"])
def either_join(request, monkeypatch):
    monkeypatch.setattr(lexicon_table, "BROADCAST_BYTES", request.param)


@pytest.mark.parametrize("terms", [TERMS, ["s", "trash", "trashes", "tra", "id", "shstup"]], ids=["plain", "nested"])
def test_like_the_list_forms(spark, either_join, terms):
    cols = ["profanity_matches", "has_profanity", "profanity_count"]
    assert by_id(lexicon_table.scan_table(rows(spark), "t", lines(spark, terms)), *cols) == by_id(
        profanity.scan(rows(spark), "t", terms), *cols)
    for mask in ("#", "[censored]"):  # a mask without letters lets its neighbours meet
        got = lexicon_table.sanitize_table(rows(spark), "t", lines(spark, terms), mask_token=mask)
        assert by_id(got, "clean_text", "clean_replacements") == by_id(
            profanity.sanitize(rows(spark), "t", terms, mask_token=mask), "clean_text", "clean_replacements")
    assert got.columns == ["i", "t", "clean_text", "clean_replacements"]


def test_by_hand(spark):
    df = spark.createDataFrame([(t,) for t in MASKED], "t string")
    for r in lexicon_table.sanitize_table(df, "t", lines(spark, TERMS), mask_token="#").collect():
        assert (r["clean_text"], r["clean_replacements"]) == MASKED[r["t"]], r["t"]


def test_what_is_put_in_may_spell_terms(spark):
    df = spark.createDataFrame([(1, "trash and idiot, scum"), (2, "s c u m"), (3, "b i.g")], "i int, t string")
    table = spark.createDataFrame([("trash", "$1 mo-ron"), ("idiot", "s.tupid"), ("scum", None), ("moron", None),
                                   ("stupid", None), ("big", "s m all"), ("small", "\\tiny")], "term string, phrase string")
    got = by_id(lexicon_table.sanitize_table(df, "t", table, mask_token="[x\\$]"), "clean_text", "clean_replacements")
    assert got == {1: ("$1 [x\\$] and [x\\$], [x\\$]", ["trash", "idiot", "scum", "moron", "stupid"]),
                   2: ("[x\\$]", ["scum"]), 3: ("\\tiny", ["big", "small"])}


def test_empty_lexicon_table_and_odd_terms(spark):
    df = spark.createDataFrame([(1, "trash"), (2, None)], "i int, t string")
    none = lines(spark, [" ", None])
    assert by_id(lexicon_table.sanitize_table(df, "t", none), "clean_text", "clean_replacements") == {
        1: ("trash", []), 2: ("", [])}
    assert by_id(lexicon_table.scan_table(df, "t", none), "profanity_count") == {1: (0,), 2: (0,)}
    assert lexicon_table.sanitize_table(df.limit(0), "t", lines(spark, TERMS)).count() == 0
    with pytest.raises(ValueError, match="two words"):
        lexicon_table.scan_table(df, "t", lines(spark, ["two words"]))


def test_case_is_compared_by_lower(spark):
    df = spark.createDataFrame([(1, "\u0131diot"), (2, "IDIOT")], "i int, t string")  # dotless i: no upper case of i
    assert by_id(lexicon_table.scan_table(df, "t", lines(spark, ["idiot"])), "profanity_count") == {1: (0,), 2: (1,)}


def test_plan_does_not_grow_with_the_lexicon(spark):
    df = spark.createDataFrame([(1, "w77 w 7 8 x")], "i int, t string")
    sizes = []
    for n in (10, 30_000):
        table = spark.range(n).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"))
        out = lexicon_table.sanitize_table(df, "t", table)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    assert out.first()["clean_text"] == "[censored] [censored] 8 x"  # w7 comes before w78
    assert max(sizes) < 2 * min(sizes)


def test_neither_words_nor_forms_are_written(spark, monkeypatch):
    written = []

    def counted(df):
        out = materialized(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(lexicon_table, "materialized", counted)
    df = spark.createDataFrame([(i, "w7s and a w 8, " * 500) for i in range(4)], "i int, t string")
    table = spark.range(1_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"))
    assert by_id(lexicon_table.scan_table(df, "t", table), "profanity_matches") == {i: (["w7"],) for i in range(4)}
    out = by_id(lexicon_table.sanitize_table(df, "t", table, mask_token="#"), "clean_text", "clean_replacements")
    assert out == {i: ("# and a #, " * 500, ["w7", "w8"]) for i in range(4)}
    assert max(written) == 1_000  # the lexicon itself, once per call


def test_spelt_terms_are_masked_where_rows_stand(spark):
    df = spark.createDataFrame([(1, "t r a s h and i.d-iot"), (2, "none")], "i int, t string")
    out = lexicon_table.sanitize_table(df, "t", lines(spark, ["trash", "idiot"]), mask_token="[x]")
    assert by_id(out, "clean_text", "clean_replacements") == {1: ("[x] and [x]", ["idiot", "trash"]), 2: ("none", [])}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "regexp_replace" not in plan.lower()


def test_masking_in_one_go_is_what_the_patterns_do(spark, monkeypatch):
    import random
    draw = random.Random(7)
    texts = ["".join(draw.choices("aAbBcé _.-'’1ΣıſKß", [6, 2, 6, 2, 4, 1, 12, 2, 2, 1, 1, 1, 1, .1, .1, .1, .1, .2], k=draw.randrange(60)))
             for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    terms = lines(spark, ["a", "ab", "aab", "bca", "cab", "aaaa", "é1b", "bb", "s", "ßa", "acabb", "kb", "bs"])
    monkeypatch.setattr(lexicon_table, "RUNS_AT_ONCE", 500)
    for mask in ("[xx]", "zz", "*q "):
        got = by_id(lexicon_table.sanitize_table(df, "t", terms, mask_token=mask), "clean_text", "clean_replacements")
        with monkeypatch.context() as m:
            m.setattr(lexicon_table, "_masked", lambda *_: None)
            assert got == by_id(lexicon_table.sanitize_table(df, "t", terms, mask_token=mask), "clean_text", "clean_replacements")
    assert len({c for c, _ in got.values()}) > 300


def test_rows_of_one_partition_are_dealt_to_all_cores(spark):
    one = spark.range(0, 3_000, 1, 1).select("id", F.lit("a t.r.a.s.h text").alias("t"))
    out = lexicon_table.scan_table(one, "t", lines(spark, ["text"]))
    held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) >= 8 and max(held) < 1_000 and sum(held) == 3_000
    even = one.repartition(8)
    assert spread(even) is even and spread(one.limit(10)).count() == 10


@pytest.mark.parametrize("at_once", [3, 500_000])
def test_direct_hits_of_few_rows_at_a_time(spark, monkeypatch, at_once):
    """Also where a hit is the s of the hit before it; the terms of raw and undisguised texts."""
    monkeypatch.setattr(lexicon_table, "RUNS_AT_ONCE", at_once)
    terms = ["trash", "s", "idiot", "scum"]
    df = spark.createDataFrame(list(enumerate([*TEXTS, "trash's 's s's's s'x", "$cum 1d10t", "scums' scum's"])), "i int, t string")
    cols = ["profanity_matches", "profanity_count"]
    assert by_id(lexicon_table.scan_table(df, "t", lines(spark, terms)), *cols) == by_id(
        profanity.scan(df, "t", terms), *cols)
    got = by_id(lexicon_table.sanitize_table(df, "t", lines(spark, terms)), "clean_text", "clean_replacements")
    assert got == by_id(profanity.sanitize(df, "t", terms), "clean_text", "clean_replacements")
