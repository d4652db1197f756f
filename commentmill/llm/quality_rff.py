"""Quality scores from random Fourier features of document statistics.

Statistics of the whole text (character classes, word lengths, repetition, lines) are scaled, and a
seeded random Fourier map approximates a Gaussian kernel over them. Every partition sums its part
of the normal equations; the sums give ridge weights. Scores of a fold kept aside are binned and
made monotone (isotonic calibration by pooling neighbours that violate the order).

Defined cases: a null text is empty and gets the score of empty statistics; a label that is null
or belongs to no row is not used; with repeated labels each counts; without usable labels every
score is 0.5; an empty table gives an empty result. Rows are scored by text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentmill.llm.common import map_texts, materialized

#: Number of cosine features, kernel width in units of the square root of the statistics' number,
#: and the ridge term per training row.
FEATURES, WIDTH, RIDGE = 256, 0.7, 1e-3
#: Remainders of crc32(id) mod 5: 0 is held out, 1 calibrates, the rest fits the weights.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
BINS = 500
SYMBOLS = b"#$%&*@^~<>{}[]\\/_=+"

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)


def statistics(text: str | None) -> list[float]:
    """What the score sees of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    upper, lower = int(seen[_UPPER].sum()), int(seen[_LOWER].sum())
    high = int(seen[128:].sum())
    words = data.split()
    w = max(1, len(words))
    counts = Counter(words)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    lines = data.split(b"\n")
    letters = max(1, upper + lower + high)
    return [
        np.log1p(len(words)), np.log1p(n / w), np.log1p(max(map(len, counts), default=0)),
        len(counts) / w, max(counts.values(), default=0) / w, repeated / w,
        upper / letters, high / letters, seen[_DIGIT].sum() / n,
        seen[124] / w, seen[33] / w, (seen[46] + seen[44]) / w, sum(int(seen[c]) for c in SYMBOLS) / w,
        seen[34] / w, np.log1p(len(words) / len(lines)), len(set(lines)) / len(lines),
        (len(words) - seen[46]) / w, float(not words),
    ]


SIZE = len(statistics(""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        draw = np.random.Generator(np.random.PCG64(4))
        turn = draw.normal(size=(SIZE, FEATURES)) / (WIDTH * np.sqrt(SIZE))
        shift = draw.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ turn + shift)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = np.clip(self.raw(x), 0, 1)
        if self.knots is None:
            return raw
        # inside a pooled stretch the raw score still orders, within two hundredths
        return 0.98 * np.interp(raw, *self.knots) + 0.02 * raw


def _sums(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at:at + 2048]
                f = model.features(np.array(part["x"].tolist()))
                y = part["label"].to_numpy(float)
                total += f.T @ np.hstack([f, y[:, None]])
        yield pd.DataFrame({"total": [total.ravel()]})
    return run


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((FEATURES + 1) * (FEATURES + 2))
    for pdf in batches:
        for t in pdf["total"]:
            total += t
    yield pd.DataFrame({"total": [total]})


def pool(values: np.ndarray, good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Isotonic means: neighbours that fall are pooled. Ordered by ``values``."""
    blocks: list[list[float]] = []
    for g, m in zip(good, n, strict=True):
        blocks.append([g, m, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, m2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + m2, blocks[-1][2] + c2]
    return np.concatenate([[g / m] * c for g, m, c in blocks]) if blocks else np.empty(0)


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """From statistics (id, x) and labels (id, label 0 or 1)."""
    known = labels.filter("id IS NOT NULL AND label IS NOT NULL")
    rows = materialized(stats.join(known, "id").filter(fold(F.col("id")) != HELD_OUT))
    moments = rows.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(SIZE)
                                                  for f in (F.avg, F.stddev_pop)]).first()
    if not moments["n"]:
        return Model(np.zeros(SIZE), np.ones(SIZE), None)
    mean = np.array([moments[f"avg{i}"] for i in range(SIZE)])
    scale = np.array([moments[f"stddev_pop{i}"] or 1.0 for i in range(SIZE)])
    model = Model(mean, np.maximum(scale, 1e-6), None)
    fitted = rows.filter(fold(F.col("id")) != CALIBRATION)
    schema = "total array<double>"
    parts = fitted.select("x", "label").mapInPandas(_sums(model), schema)
    tasks = max(1, int(parts.rdd.getNumPartitions() ** 0.5))
    sums = parts.repartition(tasks).mapInPandas(_added, schema).collect()  # a matrix per task of the root
    total = sum(np.array(r["total"]) for r in sums).reshape(FEATURES + 1, FEATURES + 2)
    count = total[-1, -2]
    if not count:
        return model
    ridge = RIDGE * count * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :-1] + ridge, total[:, -1])

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                score = np.clip(model.raw(np.array(pdf["x"].tolist())), 0, 1)
                yield pd.DataFrame({"bin": np.rint(score * BINS).astype(np.int32), "label": pdf["label"]})

    kept = rows.filter(fold(F.col("id")) == CALIBRATION).select("x", F.col("label").cast("int").alias("label"))
    bins = (kept.mapInPandas(raw, "bin int, label int").groupBy("bin")
            .agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("bin").collect())  # at most BINS + 1
    if len(bins) > 1:
        at = np.array([b["bin"] / BINS for b in bins])
        model.knots = (at, pool(at, np.array([float(b["good"]) for b in bins]), np.array([b["n"] for b in bins])))
    return model


def _fitted(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str,
            label_col: str) -> tuple[DataFrame, Model]:
    stats = materialized(map_texts(df, id_col, text_col, lambda: statistics, "x", "array<double>"))
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("double").alias("label"))
    return stats, fit(stats, known)


def keep_good(df: DataFrame, labels: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text",
              label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The rows of ``df`` with a score of ``least`` or more. Texts are scored where they are, so
    that they need not be joined with their scores."""
    _, model = _fitted(df, labels, id_col, text_col, label_id, label_col)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], float).reshape(-1, SIZE)
        return pd.Series(model.score(x))

    return df.filter(score(F.col(text_col).cast("string")) >= least)


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row per row of ``df``: id, score from 0 to 1."""
    stats, model = _fitted(df, labels, id_col, text_col, label_id, label_col)
    kind = dict(stats.dtypes)["id"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], ["id", "score"])

    return stats.mapInArrow(scored, f"id {kind}, score double").withColumnRenamed("id", id_col)
