"""Weighted logistic models of many labels and folds at once, fitted where the rows are.

A fold's model leaves the fold's own rows out. Moments are one grouped sum by label and fold, and a model's are the label's less its
fold's. Weights come from Newton steps: in each, tasks add up the gradient and Gram matrix of every model over their rows in numpy, sums of
tasks are added by model in two levels, and the step is solved by model. A step reads all rows once, whatever the number of folds. What is
broadcast is one shard of at most ``MAX_MODELS`` models.

The objective is the weighted log-loss plus l2 / (2 n) |w|^2 without the bias, over features standardised with the deviation of the
model's rows; positives weigh negatives over positives, 1 to MOST_CLASS_WEIGHT times, and weights are scaled to the sum n of the row weights.
A label and fold without both classes has no model. Rows with a null anywhere take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.operators.relational import cut

#: Most weight of a positive, deviation below which a feature is constant.
MOST_CLASS_WEIGHT, CONSTANT = 12.0, 1e-9
#: Models of a shard, parts of a model's sums, Newton steps at most; a move and a gradient that are none.
MAX_MODELS, PARTS, MAX_STEPS, STILL, FLAT = 2000, 64, 100, 3e-8, 1e-9
MODEL = "label string, fold string, mean array<double>, std array<double>, weights array<double>, n_pos long, n_neg long"


def moments(rows: DataFrame, d: int) -> DataFrame:
    """(label, fold, n, w, up, n_pos, s, q): rows, their weight, positives' weight and number, sums of features and of their squares."""
    x = [F.col("x")[i] for i in range(d)]
    up = F.when(F.col("y") > 0.5, F.col("w")).otherwise(0.0)
    return rows.groupBy("label", "fold").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(up).alias("up"), F.sum((F.col("y") > 0.5).cast("long")).alias("n_pos"),
        F.array(*(F.sum(c) for c in x)).alias("s"), F.array(*(F.sum(c * c) for c in x)).alias("q"),
    )


def starts(rows: DataFrame, d: int, whole: bool) -> DataFrame:
    """A row for each label and fold to be fitted, with what its rows add up to: the label's sums less the fold's own; with ``whole`` one for fold null, of all rows."""
    own = cut(moments(rows, d))
    add = lambda c: F.array(*(F.sum(F.col(c)[i]) for i in range(d)))
    every = own.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("n", "w", "up", "n_pos")), add("s").alias("s"), add("q").alias("q"))
    less = own.alias("o").join(every.alias("e"), "label")
    minus = lambda c: F.zip_with(f"e.{c}", f"o.{c}", lambda a, b: a - b)
    out = less.select("label", "o.fold", *((F.col(f"e.{c}") - F.col(f"o.{c}")).alias(c) for c in ("n", "w", "up", "n_pos")), minus("s").alias("s"), minus("q").alias("q"))
    if whole:
        out = out.where("fold is not null").unionByName(every.withColumn("fold", F.lit(None).cast("string")))
    return out.where("n_pos > 0 and n_pos < n and w > 0").orderBy("label", "fold")


class Model:
    """One model on its way: its standardisation, class weight and weights, the last one the bias."""

    def __init__(self, r, l2: float):
        self.label, self.fold, self.n_pos, self.n_neg = r["label"], r["fold"], int(r["n_pos"]), int(r["n"] - r["n_pos"])
        self.mean = np.array(r["s"]) / r["n"]
        std = np.sqrt(np.maximum(np.array(r["q"]) / r["n"] - self.mean**2, 0.0))
        self.std = np.where(std < CONSTANT * np.maximum(1.0, np.abs(self.mean)), 1.0, std)
        self.n = max(r["w"], CONSTANT)
        down = r["w"] - r["up"]
        self.up = min(MOST_CLASS_WEIGHT, max(1.0, down / max(r["up"], CONSTANT)))
        self.scale = self.n / (self.up * r["up"] + down)
        self.l2, self.weights, self.done = l2, np.zeros(len(self.mean) + 1), False

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.std, np.ones(len(x))])

    def sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Gradient and Gram matrix of the loss over rows, in one vector."""
        z = self.standardised(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        s = np.where(y > 0.5, self.up, 1.0) * w * self.scale
        return np.concatenate([z.T @ (s * (p - y)), (z.T @ (z * (s * p * (1 - p))[:, None])).ravel()])

    def step(self, total: np.ndarray) -> None:
        k = len(self.weights)
        shrink = np.append(np.full(k - 1, self.l2 / self.n), 0.0)
        g, h = total[:k] / self.n + shrink * self.weights, total[k:].reshape(k, k) / self.n + np.diag(shrink + 1e-12)
        move = np.linalg.solve(h, g)
        # A step of more than 4 in any weight is too far for the local curvature.
        move *= min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
        self.weights = self.weights - move
        self.done = bool(np.abs(move).max() < STILL or np.abs(g).max() < FLAT)

    def row(self) -> tuple:
        return self.label, self.fold, self.mean.tolist(), self.std.tolist(), self.weights.tolist(), self.n_pos, self.n_neg


def total_sums(rows: DataFrame, models: list[Model]) -> dict[int, np.ndarray]:
    """By model its sums over all rows: partial ones of tasks, added in PARTS parts of each model, then by model."""
    shared = rows.sparkSession.sparkContext.broadcast({label: [(i, m) for i, m in enumerate(models) if m.label == label] for label in {m.label for m in models}})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for label, g in b.groupby("label"):
                x, y, w, fold = np.array(g["x"].tolist()), g["y"].to_numpy(), g["w"].to_numpy(), g["fold"].to_numpy(object)
                for i, m in shared.value.get(label, ()):
                    mine = np.ones(len(g), bool) if m.fold is None else fold != m.fold
                    if mine.any():
                        v = m.sums(x[mine], y[mine], w[mine])
                        sums[i] = sums[i] + v if i in sums else v
        if sums:
            yield pd.DataFrame({"model": list(sums), "v": [v.tolist() for v in sums.values()]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [group["model"].iloc[0]], "part": [0], "v": [np.sum(np.array(group["v"].tolist()), axis=0).tolist()]})

    out = rows.mapInPandas(partial, "model int, v array<double>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    out = out.groupBy("model", "part").applyInPandas(added, "model int, part int, v array<double>")
    return {r.model: np.array(r.v) for r in out.groupBy("model").applyInPandas(added, "model int, part int, v array<double>").collect()}  # a row for each model of the shard


def fit(rows: DataFrame, d: int, whole: bool = False, l2: float = 0.5) -> DataFrame:
    """MODEL rows, for each label and fold of rows (label, fold, y, w, x): the model of the label's rows of other folds; with ``whole`` also the one of all rows, fold null."""
    spark = rows.sparkSession
    good = F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("label").isNotNull() & (F.size("x") == d) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    rows = cut(rows.select(F.col("label").cast("string").alias("label"), F.col("fold").cast("string").alias("fold"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), F.transform("x", lambda v: v.cast("double")).alias("x")).where(good))
    found, shard = None, []

    def solved(models: list[Model]) -> DataFrame:
        for _ in range(MAX_STEPS):
            left = [m for m in models if not m.done]
            if not left:
                break
            for i, v in total_sums(rows, left).items():
                left[i].step(v)
        else:
            raise RuntimeError(f"models did not settle in {MAX_STEPS} steps")
        return spark.createDataFrame([m.row() for m in models], MODEL)

    for r in starts(rows, d, whole).toLocalIterator():
        shard.append(Model(r.asDict(), l2))
        if len(shard) == MAX_MODELS:
            found, shard = solved(shard) if found is None else found.unionByName(solved(shard)), []
    if shard:
        found = solved(shard) if found is None else found.unionByName(solved(shard))
    return spark.createDataFrame([], MODEL) if found is None else found


def probability(x: Column, mean: Column, std: Column, weights: Column) -> Column:
    """A model's probability for a row of features, all array columns; null where there is no model."""
    parts = F.zip_with(F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), std, lambda a, b: a / b), F.slice(weights, 1, F.size(x)), lambda a, b: a * b)
    z = F.aggregate(parts, F.element_at(weights, -1), lambda s, v: s + v)
    return F.when(weights.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
