"""Linear classifiers against closed and plain solutions."""

import numpy as np
import pytest

from commentmill.operators import linear, model

TEXTS = ["good fine day", "bad awful day", "fine good words", "awful bad words", "good good", "bad", "day", "words day"]


def rows_of(spark, x, y):
    data = [(int(k), np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r, k in zip(x, y, strict=True)]
    return spark.createDataFrame(data, "y int, indices array<int>, values array<double>").repartition(3)


def newton(x, y, kind):
    """Two classes by whole Newton steps."""
    z, sign = np.hstack([x, np.ones((len(x), 1))]), np.where(y == 1, 1.0, -1.0)
    w = np.zeros(z.shape[1])
    hold = np.ones(len(w))
    hold[-1] = 0.0 if kind == linear.LOGISTIC else 1.0
    for _ in range(60):
        m = sign * (z @ w)
        if kind == linear.LOGISTIC:
            p = 1 / (1 + np.exp(m))
            slope, bend = -(z.T @ (sign * p)), (z * (p * (1 - p))[:, None]).T @ z
        else:
            inside = m < 1
            slope, bend = -2 * z.T @ (sign * np.where(inside, 1 - m, 0)), 2 * (z * inside[:, None]).T @ z
        w = w - np.linalg.solve(bend + np.diag(hold), slope + hold * w)
    return w


@pytest.mark.parametrize("kind", [linear.LOGISTIC, linear.SQUARED_HINGE])
def test_two_classes_equal_newton(spark, kind):
    draw = np.random.Generator(np.random.PCG64(1))
    x = draw.normal(size=(60, 5)) * (draw.random((60, 5)) < 0.6)
    y = (x[:, 0] + 0.5 * draw.normal(size=60) > 0).astype(int)
    got = linear.LinearClassifier(kind, tolerance=1e-8).fit(rows_of(spark, x, y), 5, 2)
    assert got.shape == (1, 6) and np.allclose(got[0], newton(x, y, kind), atol=1e-4)


def test_one_point_has_a_closed_solution(spark):
    got = linear.LinearClassifier(linear.SQUARED_HINGE, tolerance=1e-10).fit(
        rows_of(spark, np.array([[2.0]]), np.array([1])), 1, 2)[0]
    # minimum of (w^2 + b^2) / 2 + (1 - 2 w - b)^2: w = 4 / 11, b = 2 / 11
    assert np.allclose(got, [4 / 11, 2 / 11], atol=1e-6)


def test_three_classes(spark):
    draw = np.random.Generator(np.random.PCG64(2))
    x = np.abs(draw.normal(size=(90, 4)))
    y = x[:, :3].argmax(axis=1)
    for kind in (linear.LOGISTIC, linear.SQUARED_HINGE):
        fitted = linear.LinearClassifier(kind, c=100.0, tolerance=1e-6)
        weights = fitted.fit(rows_of(spark, x, y), 4, 3)
        scores = x @ weights[:, :-1].T + weights[:, -1]
        assert weights.shape == (3, 5) and (scores.argmax(axis=1) == y).mean() > 0.9
        at = linear.objective(rows_of(spark, x, y), kind, 100.0, weights.shape)
        value, slope = at(weights.ravel())
        assert np.abs(slope).max() <= 1e-6 * 90
        for i in range(0, 15, 4):  # the slope is the value's
            step = np.zeros(15)
            step[i] = 1e-5
            w0 = np.linspace(-1, 1, 15)
            assert abs((at(w0 + step)[0] - at(w0 - step)[0]) / 2e-5 - at(w0)[1][i]) < 1e-2


@pytest.mark.parametrize("name", ["Logistic Regression", "SVM (LinearSVC)"])
def test_trained_on_texts(spark, name):
    data = [(i, t, "neg" if "bad" in t else "pos") for i, t in enumerate(TEXTS * 6)]
    df = spark.createDataFrame(data, "k int, text string, y string")
    fitted, scores, report = model.train_selected(df, name, text_col="text", label_col="y", key="k")
    assert scores.first()["accuracy"] == 1.0 and report.count() >= 2
    asked = spark.createDataFrame([(1, "a bad one"), (2, None), (3, "good")], "k int, text string")
    got = {r["k"]: r["prediction_label"] for r in fitted.predict(asked).collect()}
    assert (got[1], got[3]) == ("neg", "pos") and got[2] == "pos"
