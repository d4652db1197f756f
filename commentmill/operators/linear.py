"""Linear classifiers over sparse rows: logistic regression and the squared-hinge machine.

Both minimise ``|w|^2 / 2 + c * (sum of losses)``. Every partition sums the loss and the gradient of its
rows, the sums of a few partitions are added in tasks, and the driver takes L-BFGS steps on what is
left: one vector of classes x (terms + 1) numbers, bounded by the vocabulary. Rows are never moved
between passes.

Logistic regression leaves the intercept free; with more than two classes it is multinomial. The
squared-hinge machine counts the intercept as one more weight, and takes each class against the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentmill.functions.cut import materialized

LOGISTIC, SQUARED_HINGE = "logistic", "squared_hinge"
#: Steps that L-BFGS remembers, and halvings of a step before it gives up.
REMEMBERED, HALVINGS = 10, 30
#: Rows that one task takes in a pass, about.
ROWS_PER_TASK = 5_000


def sparse(vectors: DataFrame, vector_col: str = "features"):
    """The columns (indices, values) of a sparse vector column."""
    parts = F.unwrap_udt(F.col(vector_col))
    return parts["indices"].alias("indices"), parts["values"].alias("values")


def flat_cells(indices: list, values: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(indices)), list(map(len, indices)))
    return (rows, np.concatenate([np.empty(0, np.int64), *indices]).astype(np.int64),
            np.concatenate([np.empty(0), *values]))


def margins(weights: np.ndarray, indices: list, values: list) -> np.ndarray:
    """rows x vectors: the score of each row under each weight vector, whose last number is the
    intercept."""
    rows, at, v = flat_cells(indices, values)
    return np.stack([np.bincount(rows, v * w[at], minlength=len(indices)) + w[-1] for w in weights], axis=1)


def losses(kind: str, scores: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum of losses and its slope by score. ``y`` holds class numbers."""
    if kind == LOGISTIC and scores.shape[1] > 1:
        top = scores - scores.max(axis=1, keepdims=True)
        share = np.exp(top)
        share /= share.sum(axis=1, keepdims=True)
        picked = np.arange(len(y))
        loss = -np.log(np.maximum(share[picked, y], 1e-300)).sum()
        share[picked, y] -= 1
        return float(loss), share
    sign = np.where(y[:, None] == (np.arange(scores.shape[1]) if scores.shape[1] > 1 else 1), 1.0, -1.0)
    if kind == LOGISTIC:
        return float(np.logaddexp(0, -sign * scores).sum()), -sign / (1 + np.exp(np.clip(sign * scores, -700, 700)))
    short = np.maximum(0, 1 - sign * scores)
    return float((short * short).sum()), -2 * sign * short


def _partition_sums(kind: str, weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(weights.size + 1)
        for pdf in batches:
            if not len(pdf):
                continue
            indices, values = pdf["indices"].tolist(), pdf["values"].tolist()
            loss, slope = losses(kind, margins(weights, indices, values), pdf["y"].to_numpy())
            rows, at, v = flat_cells(indices, values)
            total[0] += loss
            for k, part in enumerate(total[1:].reshape(weights.shape)):
                part[:-1] += np.bincount(at, v * slope[rows, k], minlength=weights.shape[1] - 1)
                part[-1] += slope[:, k].sum()
        yield pd.DataFrame({"total": [total]})
    return run


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for pdf in batches:
        for t in pdf["total"]:
            total = np.array(t) if total is None else total + t
    if total is not None:
        yield pd.DataFrame({"total": [total]})


def objective(rows: DataFrame, kind: str, c: float, shape: tuple[int, int]) -> Callable:
    """flat weights -> (value, gradient) over rows (y, indices, values)."""
    parts = rows.rdd.getNumPartitions()
    tasks = max(1, int(parts ** 0.5))

    def at(flat: np.ndarray) -> tuple[float, np.ndarray]:
        weights = flat.reshape(shape)
        sums = rows.mapInPandas(_partition_sums(kind, weights), "total array<double>")
        if parts > 8:  # a few sums reach the driver, however many partitions there are
            sums = sums.repartition(tasks).mapInPandas(_added, "total array<double>")
        total = sum(np.array(r["total"]) for r in sums.collect())
        held = weights.copy()
        if kind == LOGISTIC:
            held[:, -1] = 0.0
        return float(c * total[0] + (held * held).sum() / 2), c * total[1:] + held.ravel()

    return at


def minimise(at: Callable, start: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, int]:
    """L-BFGS with halved steps; (weights, passes over the rows)."""
    x = start
    value, slope = at(x)
    passes, past = 1, []
    for _ in range(steps):
        if np.abs(slope).max() <= tolerance:
            break
        down = -slope
        turns = []
        for s, g, rho in reversed(past):
            a = rho * (s @ down)
            turns.append(a)
            down = down - a * g
        if past:
            s, g, _ = past[-1]
            down *= (s @ g) / (g @ g)
        else:
            down /= max(1.0, np.linalg.norm(slope))
        for (s, g, rho), a in zip(past, reversed(turns), strict=True):
            down = down + s * (a - rho * (g @ down))
        length, fall = 1.0, slope @ down
        for _ in range(HALVINGS):
            new, (new_value, new_slope) = x + length * down, at(x + length * down)
            passes += 1
            if new_value <= value + 1e-4 * length * fall:
                break
            length /= 2
        else:
            break  # as far as the numbers go
        s, g = new - x, new_slope - slope
        if s @ g > 1e-12:
            past = [*past[1 - REMEMBERED:], (s, g, 1 / (s @ g))]
        x, value, slope = new, new_value, new_slope
    return x, passes


@dataclass
class LinearClassifier:
    """``tolerance`` bounds the largest slope per row at the end."""

    loss: str = LOGISTIC
    c: float = 1.0
    steps: int = 1500
    tolerance: float = 1e-4

    def fit(self, rows: DataFrame, terms: int, classes: int) -> np.ndarray:
        """Weights (vectors x (terms + 1)) from rows (y, indices, values)."""
        kept = materialized(rows.select("y", "indices", "values"))
        n = kept.count()
        kept = kept.coalesce(max(1, -(-n // ROWS_PER_TASK))).cache()  # a pass is short where rows are few
        try:
            shape = (1 if classes == 2 else classes, terms + 1)
            flat, _ = minimise(objective(kept, self.loss, self.c, shape), np.zeros(shape[0] * shape[1]),
                               self.steps, self.tolerance * max(1, n))
        finally:
            kept.unpersist()
        return flat.reshape(shape)


@dataclass
class LinearModel:
    """A fitted linear classifier: features and weights; text in, ``prediction_label`` out."""

    features: object
    weights: np.ndarray
    labels: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        weights, labels = self.weights, np.array(self.labels, object)

        @F.pandas_udf("string")
        def best(indices: pd.Series, values: pd.Series) -> pd.Series:
            if len(labels) == 1:
                return pd.Series([labels[0]] * len(indices))
            scores = margins(weights, indices.tolist(), values.tolist())
            place = (scores[:, 0] > 0).astype(int) if scores.shape[1] == 1 else scores.argmax(axis=1)
            return pd.Series(labels[place])

        vectors = self.features.transform(df)
        return vectors.withColumn("prediction_label", best(*sparse(vectors))).drop("features")
