"""Models of all labels and folds against a fit of each alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.operators import logistic as lg
from spanwise.operators.models import Logistic


def plainly(x, y, w, l2=0.5, steps=4000):
    """The optimum by many steps of plain gradient descent with momentum on standardised features."""
    mean, std = x.mean(0), x.std(0)
    std = np.where(std < 1e-9, 1.0, std)
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    n, up = w.sum(), w[y > 0.5].sum()
    s = np.where(y > 0.5, np.clip((n - up) / up, 1, 12), 1.0) * w
    s *= n / s.sum()
    v, move = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        move = 0.9 * move - 0.2 * (z.T @ (s * (p - y)) / n + np.append(np.full(x.shape[1], l2 / n), 0.0) * v)
        v = v + move
    return mean, std, v


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for k, label in enumerate("abc"):
        for _ in range(150):
            x = rng.normal(size=3) * [1, 5, 0.2] + [0, 30, -1]
            y = float(rng.random() < 1 / (1 + np.exp(-(x[0] * (k - 1) + x[1] / 5 - 7))))
            out.append((label, f"f{rng.integers(4)}", y, float(rng.choice([0.25, 1.0])), [*x.tolist(), 7.0]))
    return [*out, ("a", None, 1.0, 1.0, [0.0, 30.0, -1.0, 7.0]), ("one", "f0", 1.0, 1.0, [0.0, 0.0, 0.0, 0.0]), ("a", "f1", None, 1.0, [0.0] * 4), ("a", "f1", 1.0, 1.0, [None, 0.0, 0.0, 0.0]), (None, "f1", 1.0, 1.0, [0.0] * 4)]


def test_all_folds_at_once(spark, rows):
    df = spark.createDataFrame(rows, "label string, fold string, y double, w double, x array<double>").repartition(5)
    got = {(r.label, r.fold): r for r in lg.fit(df, 4, whole=True).collect()}
    good = [r for r in rows if r[0] and r[2] is not None and None not in r[4]]
    assert set(got) == {(a, f) for a in "abc" for f in ("f0", "f1", "f2", "f3", None)}
    for (label, fold), r in got.items():
        mine = [x for x in good if x[0] == label and (fold is None or x[1] != fold)]
        x, y, w = np.array([m[4] for m in mine]), np.array([m[2] for m in mine]), np.array([m[3] for m in mine])
        mean, std, v = plainly(x, y, w)
        np.testing.assert_allclose(r.mean, mean, rtol=1e-9)
        np.testing.assert_allclose(r.weights, v, atol=2e-4)
        assert (r.n_pos, r.n_neg) == (y.sum(), len(y) - y.sum())
    x, y, w = (np.array([m[k] for m in good if m[0] == "b"]) for k in (4, 2, 3))
    ours = got["b", None]
    p = df.where("label = 'b'").select(lg.probability(F.col("x"), *(F.lit(np.array(c)) for c in (ours.mean, ours.std, ours.weights))).alias("p"), F.col("x")).collect()
    driver = Logistic(list("abcd")).fit(x, y, w)
    z = (np.array([r.x for r in p]) - driver.mean) / driver.std @ np.array(driver.weights[:-1]) + driver.weights[-1]
    np.testing.assert_allclose([r.p for r in p], 1 / (1 + np.exp(-z)), atol=0.01)


def test_separable_and_empty(spark):
    rows = [("a", f"f{k % 2}", float(k > 20), 1.0, [float(k)]) for k in range(41)]
    got = lg.fit(spark.createDataFrame(rows, "label string, fold string, y double, w double, x array<double>"), 1).collect()
    assert len(got) == 2 and all(np.isfinite(r.weights).all() and r.weights[0] > 1 for r in got)
    assert lg.fit(spark.createDataFrame([], "label string, fold string, y double, w double, x array<double>"), 1).collect() == []
