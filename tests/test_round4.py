"""Cases of the fourth round: steps that had to do the same with less."""

from pyspark.sql import functions as F

from commentmill.operators import augment, knn, parse, profanity
from commentmill.operators.knn import KNNClassifier


def test_neighbours_do_not_depend_on_blocks(spark, monkeypatch):
    words = "red green blue cat dog bird sun moon star sea".split()
    rows = [(i, " ".join(words[(i * j) % 10] for j in range(1, 6)), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, text string, y string")
    train, test = df.filter("k % 3 <> 0"), df.filter("k % 3 = 0")

    def found():
        fitted = KNNClassifier(k=4).fit(train, text_col="text", label_col="y", key="k")
        return sorted(tuple(r) for r in fitted.neighbours(test).collect())

    whole = found()
    monkeypatch.setattr(knn, "TRAIN_BLOCK", 3)
    monkeypatch.setattr(knn, "TEST_BLOCK", 2)
    assert found() == whole and len(whole) % 4 == 0


def test_guards_see_letters_that_patterns_take_for_others(spark):
    """Terms spelled with a long s, a dotless i or a Kelvin sign, and objects that a backslash stands before."""
    rows = [(1, "ſtupıd"), (2, "s.tıu-p i_d"), (3, "STUPİD träsh"), (4, "Klown c l-o_w n"), (5, "nothing")]
    df = spark.createDataFrame(rows, "k int, text string")
    found = profanity.scan(df, "text", ["stupid", "klown", "clown"]).orderBy("k").collect()
    assert [r["profanity_matches"] for r in found[3:]] == [["klown"], []]
    assert [r["profanity_count"] for r in found] == [1, 0, 1, 1, 0]
    clean = profanity.sanitize(df, "text", ["stupid", "clown"]).orderBy("k").collect()
    assert [len(r["clean_replacements"]) for r in clean] == [1, 0, 1, 1, 0]


def test_pieces_of_answers_are_few(spark):
    text = r'x {"row_id": 1, "a": "}\"{", "b": {"c": 2}} \{"row_id": 2, "a": "\\"} {"row_id": 3, "a": "'
    got = spark.createDataFrame([(text,)], "t string").select(
        parse.objects_starting(F.col("t"), parse.ROW_START).alias("o")).first()["o"]
    assert got == [r'{"row_id": 1, "a": "}\"{", "b": {"c": 2}}', r'{"row_id": 2, "a": "\\"}']


def test_steps_skip_what_cannot_match(spark):
    """The pattern of separated terms is not the only thing that every row meets."""
    plan = spark.range(1).select(profanity.found_terms(F.col("id").cast("string"), ["stupid"]).alias("f"))
    assert "contains" in plan._jdf.queryExecution().toString().lower()


def test_noise_and_deletion_are_plain_edits(spark):
    """A million characters are edited in place; spaces stay, and no text means no text."""
    long = "ab c\u3000d😀" * 120_000
    df = spark.createDataFrame([(1, long), (2, ""), (3, None), (None, "one two three four")], "k long, t string")
    noisy = augment.noise_injection(F.col("t"), F.col("k"), 7, 0.1)
    fewer = augment.random_deletion(F.col("t"), F.col("k"), 7, 0.3)
    got = df.select("k", noisy.alias("n"), fewer.alias("f")).collect()
    assert len(got[0]["n"]) == len(long)
    assert [c for c in got[0]["n"] if c.isspace()] == [c for c in long if c.isspace()] and got[0]["n"] != long
    assert (got[1]["n"], got[1]["f"], got[2]["n"], got[2]["f"]) == ("", "", None, None)
    assert set(got[3]["f"].split()) <= {"one", "two", "three", "four"} and augment.noisy_text("abc", "1", 7, 0.08) != ""


def test_python_scorer_searches_only_where_a_word_stands(monkeypatch):
    """Texts without a word are not searched; look-alikes and letters that a pattern folds still count."""
    import json
    import re

    from commentmill.plans import lexicon_scorer

    texts = ["nothing here", "STUPID idiots", "stup1d $cum", "\u017ftupid", "\u0130diot", "stupidity", "s.t.u.p.i.d", ""]
    prompt = "\n".join(f"{i * 10}: {t}" for i, t in enumerate(texts))
    patterns = []
    real = re.sub
    monkeypatch.setattr(lexicon_scorer.re, "sub", lambda *a: patterns.append(a) or real(*a))
    rows = json.loads(lexicon_scorer.python_scorer(["stupid", "idiot", "scum"])()(prompt))
    assert [r["scores"]["toxicity"] for r in rows] == [0, 60, 60, 30, 30, 0, 0, 0]
    assert len(patterns) < len(texts) - 2
