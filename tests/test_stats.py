"""Suggested cleaning steps."""

from commentmill.operators import stats


def suggestion(spark, texts):
    return stats.suggest_cleaning(spark.createDataFrame([(t,) for t in texts], "text string"), "text").first()


def test_usual_marks_do_not_trigger(spark):
    row = suggestion(spark, ["We met at noon in the small park", "Did the last bus come late again?", "Nobody of us minded; we walked home."] * 7)
    assert not row["remove_punctuation"]
    assert row["rows_with_punctuation_only"] == row["rows_with_repeated_punctuation"] == 0.0


def test_share_of_rows_of_marks_only(spark):
    plain = ["a walk along the river"] * 397
    assert suggestion(spark, plain + ["- / -", "(:)", " ;"])["rows_with_punctuation_only"] == 0.0075
    assert suggestion(spark, plain + ["- / -", "(:)", " ;"])["remove_punctuation"]
    assert not suggestion(spark, plain * 2 + ["- / -", "x", "y"])["remove_punctuation"]


def test_share_of_rows_with_runs_of_marks(spark):
    plain = ["a walk along the river"] * 77
    row = suggestion(spark, plain + ["wait ---- what", "so ;;; what", "***done"])
    assert row["remove_punctuation"] and row["rows_with_repeated_punctuation"] == 0.0375


def test_empty_input_suggests_nothing(spark):
    cfg = stats.suggested_config(stats.suggest_cleaning(spark.createDataFrame([], "text string"), "text"))
    assert not any(vars(cfg).values())


def test_display_rounding_is_half_even(spark):
    from pyspark.sql import functions as F

    from commentmill.functions.numbers import round_digits
    values = [0.03125, 0.09375, 1 / 3, 0.12341, 1234.56789]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(round_digits(F.col("x"))).collect()] == [round(v, 4) for v in values]


def test_measures_match_plain_python(spark):
    import re
    import string
    import unicodedata
    texts = ["AB c1 ² É !!!", "", "  x  y", "Ⅰǅ $$$$", "www.A @b <i> aaa u.", "...."]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in stats.measure_rows(df, "text").collect():
        t = row["text"]
        punct = sum(c in string.punctuation or unicodedata.category(c).startswith("P") for c in t)
        assert (row["n_upper"], row["n_digit"], row["n_punct"], row["n_non_ascii"]) == (
            sum(c.isupper() for c in t), sum(c.isdigit() for c in t), punct, sum(ord(c) > 127 for c in t))
        assert row["elongation"] == bool(re.search(r"(.)\1{2,}", t))
        assert row["repeated_punctuation"] == bool(re.search(r"[^\w\s]{3,}", t))
        assert row["messy_whitespace"] == bool(re.search(r"\s{2,}|\n|\t", t))
