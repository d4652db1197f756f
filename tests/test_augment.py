"""Augmentations: reproducible under any partitioning, and their rules."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from commentmill.operators import augment

SYN = {"cat": ["feline", "house_cat", "cat"], "runs": ["sprints"], "empty": ["empty"]}
random.seed(7)
WORDS = ["cat", "Runs,", "fast.", "émile", "over!", "the", "hill?"]
TEXTS = ["", "  ", "one", "one two", "a b c", "a b c d"] + [
    " ".join(random.choices(WORDS, k=n)) for n in (5, 11, 40, 300)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k bigint, text string").cache()


def run(df, **on):
    out = augment.augment(df, "text", augment.AugmentConfig(**on), key="k", synonyms=SYN)
    return [r["augmented_text"] for r in out.orderBy("k").collect()]


FLAGS = [n for n in augment.AugmentConfig.__dataclass_fields__ if n != "strength"]


@pytest.mark.parametrize("flag", [*FLAGS, "all"])
def test_same_rows_for_any_partitioning(df, flag):
    on = dict.fromkeys(FLAGS if flag == "all" else [flag], True)
    got = [run(df.repartition(n), **on) for n in (1, 3, 8)]
    assert got[0] == got[1] == got[2]
    assert got[0][:2] == TEXTS[:2]


def test_chain_is_the_steps_in_order(df):
    on = dict(random_swap=True, random_deletion=True, sentence_cropping=True)
    once = df
    for name in on:
        step = augment.augment(once, "text", augment.AugmentConfig(**{name: True}), key="k")
        once = step.select("k", F.col("augmented_text").alias("text"))
    assert run(df, **on) == [r["text"] for r in once.orderBy("k").collect()]


def test_counts(df):
    for before, swap, grow, crop, noise in zip(TEXTS, run(df, random_swap=True), run(df, random_insertion=True),
                                               run(df, sentence_cropping=True), run(df, noise_injection=True)):
        n = len(before.split())
        assert Counter(swap.split()) == Counter(before.split())
        assert len(grow.replace("house cat", "house_cat").split()) == n + (max(1, int(n * .1)) if n else 0)
        assert len(crop.split()) == (n - max(1, int(n * .1)) if n > 4 else n)
        if before.strip():
            changed = sum(a != b for a, b in zip(before, noise))
            assert len(noise) == len(before) and changed <= max(1, int(len(before) * .08))
            assert [c.isspace() for c in noise] == [c.isspace() for c in before]


def test_fixed_rules(df):
    for before, back, keep, syn in zip(TEXTS, run(df, back_translation=True), run(df, random_deletion=True),
                                       run(df, synonym_replacement=True, strength=0.5)):
        t = before.split()
        if len(t) > 3:
            assert back.split() == [t[0], *t[-2:0:-1], t[-1]]
        it = iter(t)
        assert not t or (keep.split() and all(x in it for x in keep.split()))
        assert len(syn.replace("house cat", "house_cat").split()) == len(t)


def test_sentences_are_only_reordered(df):
    import re
    for before, after in zip(TEXTS, run(df, sentence_shuffling=True)):
        assert sorted(before.split()) == sorted(after.split())
        if before.strip():
            assert all(x in after for x in re.split(r"(?<=[.!?])\s+", before.strip()))


def test_synonym_table_equals_literal_list(spark, df):
    pairs = spark.createDataFrame([(w, s) for w, ss in SYN.items() for s in ss], "word string, synonym string")
    a = augment.synonyms_from_table(df, "text", pairs, key="k", share=0.4).orderBy("k").collect()
    b = df.select("k", augment.synonym_replacement(F.col("text"), F.col("k"), 42, 0.4, SYN).alias("o")).orderBy("k").collect()
    assert [r["augmented_text"] for r in a] == [r["o"] for r in b]


def test_source_and_stale_columns(spark):
    df = spark.createDataFrame([(1, "a", "b c d e f g", "x")], "k int, text string, processed_text string, clean_text string")
    out = augment.augment(df, "text", augment.AugmentConfig(back_translation=True), key="k")
    assert out.columns == ["k", "text", "processed_text", "augmented_text"]
    assert out.first()["augmented_text"] == "b f e d c g"
    assert augment.clamp_strength(3) == 0.5 and augment.clamp_strength(0) == 0.01


def test_table_of_many_synonyms_equals_the_list(spark):
    from commentmill.operators import augment
    few = {"red": ["crimson", "scarlet"], "big": ["large_one", "huge"], "crimson": ["red"]}
    table = spark.createDataFrame([(w, s) for w, o in few.items() for s in o], "word string, synonym string")
    many = table.unionByName(spark.range(50_000).selectExpr("concat('w', id) AS word", "concat('v', id) AS synonym"))
    df = spark.createDataFrame([(i, "the red car is Big, and the red bus is bigger. " * 3) for i in range(20)] + [(50, " "), (51, None)],
                               "id int, text string")
    cfg = augment.AugmentConfig(synonym_replacement=True, random_insertion=True, paraphrasing=True)
    a = augment.augment(df, "text", cfg, key="id", synonyms=few).select("id", "augmented_text").collect()
    b = augment.augment(df, "text", cfg, key="id", synonyms=many).select("id", "augmented_text").collect()
    assert sorted(a) == sorted(b) and any("crimson" in r[1] for r in a)


def test_edits_hold_one_slice_of_a_batch():
    """Of a large batch only a slice at a time is Python objects; order and nulls stay."""
    import pyarrow as pa

    held = []

    class Column:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            held.append(min(n, len(self.values) - at))
            return self.values.slice(at, n)

    texts = pa.array([str(i) for i in range(1_000)])
    got = augment._in_slices(lambda t, k: f"{t}{k or ''}", Column(texts), Column(pa.nulls(1_000, pa.string())))
    assert got.to_pylist() == texts.to_pylist() and max(held) <= augment.SLICE_ROWS
    assert len(augment._in_slices(str, texts.slice(0, 0))) == 0


def test_few_words_of_a_table_go_to_the_rows(spark, df, monkeypatch):
    """Sent or joined, a table gives the same; rows without a key meet no word; rows may repeat."""
    pairs = spark.createDataFrame([(w, s) for w, ss in SYN.items() for s in ss], "word string, synonym string")
    rows = df.select(F.col("k").cast("string").alias("k"), "text").unionByName(
        spark.createDataFrame([(None, next(t for t in TEXTS if len(t.split()) > 5))], "k string, text string"))
    cfg = augment.AugmentConfig(synonym_replacement=True, random_insertion=True, paraphrasing=True, strength=0.4)

    def both():
        a = augment.augment(rows, "text", cfg, key="k", synonyms=pairs)
        b = augment.synonyms_from_table(rows, "text", pairs, key="k", share=0.4)
        plans = [d._jdf.queryExecution().toString() for d in (a, b)]
        return [sorted(map(str, d.select("k", "augmented_text").collect())) for d in (a, b)], plans

    got, plans = both()
    assert not any("Join" in p for p in plans)
    twice = augment.synonyms_from_table(rows.unionAll(rows), "text", pairs, key="k", share=0.4)
    assert sorted(map(str, twice.select("k", "augmented_text").collect())) == sorted(got[1] * 2)
    monkeypatch.setattr(augment, "SENT_WORDS", 0)
    joined, plans = both()
    assert joined == got and all("Join" in p for p in plans)
