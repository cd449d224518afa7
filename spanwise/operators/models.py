"""Scores of curves, faces and points for labels: rules, a logistic model per label, and their mean.

Features are wide tables (section_id, name, features...). Scoring is expressions; fitting takes a bounded number of labelled
rows to numpy.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.scalar import sigmoid
from spanwise.operators import logistic
from spanwise.operators.features import CURVE_FEATURES, FACE_FEATURES
from spanwise.operators.relational import source_weights as source_weights_of
from spanwise.operators.topology import part

#: Rule weights by label; "open" stands for 1 - section_closed, a * b for a product, 1-x for a complement.
CURVE_RULES = {
    "internal_web": (-2.0, {"separates_cells": 4.5, "is_horizontal*section_closed": 0.8, "transition_like": -1.0, "dangling": -0.8}),
    "web": (-2.2, {"on_outer*section_closed": 1.4, "1-section_closed": 1.2, "run_len_rank": 2.2, "aligned_long_axis": 1.2, "dangling": -2.5, "transition_like": -2.5, "in_pocket": -1.2, "run_has_tip_endpoint": -1.0}),
    "flange": (-2.2, {"dangling": 3.0, "run_has_tip_endpoint": 2.2, "transition_like": -1.5, "1-run_len_rank": 0.6}),
    "outer_contour": (-2.0, {"on_outer": 4.0, "dangling": -3.5}),
    "cavity": (-1.6, {"1-section_closed": 2.0, "run_len_rank": 1.8, "run_has_tip_endpoint": -2.0, "transition_like": -1.5, "dangling": -1.0}),
    "notch": (-2.2, {"in_pocket": 3.6, "transition_like": 0.6, "dangling": -0.8}),
    "fillet": (-2.5, {"transition_like": 5.0}),
}
NO_RULE = -1.5
DEEP_WAIST = 0.6
MIN_SECTIONS, MIN_POSITIVES, MOST_CLASS_WEIGHT = 2, 2, 12.0


def _term(name: str) -> Column:
    out = F.lit(1.0)
    for f in name.split("*"):
        out = out * ((1 - F.col(f[2:])) if f.startswith("1-") else F.col(f))
    return out


def rule_curve_score(label: str) -> Column:
    bias, terms = CURVE_RULES.get(label, (NO_RULE, {}))
    return sigmoid(sum((w * _term(t) for t, w in terms.items()), F.lit(bias)))


def rule_face_score() -> Column:
    """Large faces first; a cell with a deep waist yields to its sub-cells."""
    deep = (F.col("waist_ratio") < DEEP_WAIST).cast("double")
    return sigmoid(-1.0 + 2.5 * F.col("rel_area_to_max") + 1.8 * F.col("is_subcell") * deep - 2.2 * (1 - F.col("is_subcell")) * deep)


def point_scores(graph: DataFrame, curves: DataFrame) -> DataFrame:
    """(section_id, name, score): greatest angle between curves at a point over 90 degrees, 0.3 more at a transition, 1 at most."""
    first, last = F.col("polyline")[0], F.element_at("polyline", -1)
    span = F.hypot(last["u"] - first["u"], last["v"] - first["v"])
    line = curves.select("section_id", F.col("name").alias("curve"), F.when(span > 1e-9, (last["u"] - first["u"]) / span).alias("du"), F.when(span > 1e-9, (last["v"] - first["v"]) / span).alias("dv"))
    at = part(graph, "topo").select("section_id", F.col("name").alias("curve"), "transition", F.explode("nodes").alias("rep")).join(line, ["section_id", "curve"])
    # The curves of one node are few; both sides carry the node, so pairs stay within it.
    other = at.select("section_id", "rep", F.col("curve").alias("curve2"), F.col("du").alias("du2"), F.col("dv").alias("dv2"))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(F.col("du") * F.col("du2") + F.col("dv") * F.col("dv2")))))
    turn = at.join(other, ["section_id", "rep"]).where("curve < curve2").groupBy("section_id", "rep").agg(F.max(angle).alias("turn"))
    soft = at.groupBy("section_id", "rep").agg(F.max(F.col("transition").cast("int")).alias("soft"))
    node = part(graph, "node").where("degree >= 2").join(soft, ["section_id", "rep"]).join(turn, ["section_id", "rep"], "left")
    return node.select("section_id", "name", F.least(F.lit(1.0), F.coalesce("turn", F.lit(0.0)) / 90.0 + 0.3 * F.col("soft")).alias("score"))


@dataclass
class Logistic:
    """A standardised logistic model; the last weight is the bias."""

    features: list[str]
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    n_pos: int = 0
    n_neg: int = 0

    def fit(self, x: np.ndarray, y: np.ndarray, row_weight: np.ndarray | None = None, l2: float = 0.5, steps: int = 400, rate: float = 0.15) -> Logistic:
        """Adam on the weighted log-loss plus l2 / (2 n) |w|^2 without the bias.

        Positives weigh negatives over positives, 1 to 12 times; all weights are scaled to the sum of the row weights, so a
        section copied into many variants doesn't loosen the regularisation.
        """
        row_weight = np.ones(len(y)) if row_weight is None else row_weight
        mean, std = x.mean(0), x.std(0)
        std[std < 1e-9] = 1.0
        z = np.column_stack([(x - mean) / std, np.ones(len(x))])
        n = max(row_weight.sum(), 1e-9)
        up, down = row_weight[y > 0.5].sum(), row_weight[y <= 0.5].sum()
        s = np.where(y > 0.5, np.clip(down / max(up, 1e-9), 1.0, MOST_CLASS_WEIGHT), 1.0) * row_weight
        s *= n / s.sum()
        w = np.zeros(z.shape[1])
        shrink = np.append(np.full(x.shape[1], l2 / n), 0.0)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for k in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (s * (p - y)) / n + shrink * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        self.mean, self.std, self.weights = mean.tolist(), std.tolist(), w.tolist()
        self.n_pos, self.n_neg = int(y.sum()), int(len(y) - y.sum())
        return self

    def _parts(self) -> list[Column]:
        return [(F.col(f) - m) / s * w for f, m, s, w in zip(self.features, self.mean, self.std, self.weights, strict=False)]

    def score(self) -> Column:
        return sigmoid(sum(self._parts(), F.lit(self.weights[-1])))

    def contributions(self, k: int = 3, least: float = 0.05) -> Column:
        """Names of the k features that add most, if they add more than ``least``."""
        parts = F.array(*(F.struct((-c).alias("less"), F.lit(i).alias("i"), F.lit(f).alias("name")) for i, (c, f) in enumerate(zip(self._parts(), self.features, strict=True))))
        top = F.slice(F.array_sort(parts), 1, k)
        return F.transform(F.filter(top, lambda p: -p["less"] > least), lambda p: p["name"])


@dataclass
class Bank:
    """Models by label's short name, and one for faces; labels without a model fall back to rules."""

    curves: dict[str, Logistic] = field(default_factory=dict)
    face: Logistic | None = None
    mode: str = "logreg"  # rules, logreg or hybrid

    def _mixed(self, rule: Column, model: Logistic | None) -> Column:
        if self.mode == "rules" or model is None:
            return rule
        return model.score() if self.mode == "logreg" else 0.5 * rule + 0.5 * model.score()

    def curve_score(self, label: str) -> Column:
        return self._mixed(rule_curve_score(label), self.curves.get(label))

    def face_score(self) -> Column:
        return self._mixed(rule_face_score(), self.face)

    def scorer(self, label: str, is_face: bool = False) -> str:
        model = self.face if is_face else self.curves.get(label)
        return "rules" if self.mode == "rules" or model is None else self.mode

    def save(self, path: str) -> None:
        """One line of JSON in a folder that Spark writes, so any store will do."""
        body = {"curves": {k: vars(m) for k, m in self.curves.items()}, "face": vars(self.face) if self.face else None}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(body, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str, mode: str = "logreg") -> Bank:
        body = json.loads(SparkSession.active().read.text(path, wholetext=True).first().value)
        return Bank({k: Logistic(**m) for k, m in body["curves"].items()}, Logistic(**body["face"]) if body["face"] else None, mode)


FACE = "face"


def training_rows(curve_features: DataFrame, face_features: DataFrame, samples: DataFrame, weights: DataFrame | None = None, families: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (label, fold, section_id, y, w, x) of curves, by label, and of faces, all under one label: every labelled entity is one.

    Negatives come only from sections that have the label. weights (section_id, weight): a source and its variants share 1. families
    (section_id, family): the folds.
    """
    generic = samples.where("kind = 'generic'").withColumn("label", F.element_at(F.split("label_id", r"\."), -1))
    one = lambda df, at, value, none: df.withColumn(value, none) if at is None else df.join(at, "section_id", "left")

    def rows(kind: str, label: Column, targets: str, features: DataFrame, name: str, names: list[str]) -> DataFrame:
        out = generic.where(F.col("entity_type") == kind).select("section_id", label.alias("label"), targets).join(features, "section_id")
        out = one(out, None if weights is None else weights.select("section_id", F.col("weight").alias("w")), "w", F.lit(1.0)).na.fill(1.0, ["w"])
        out = one(out, None if families is None else families.select("section_id", F.col("family").alias("fold")), "fold", F.lit(None).cast("string"))
        return out.select("label", "fold", "section_id", F.array_contains(targets, F.col(name)).cast("double").alias("y"), "w", F.array(*(F.col(c).cast("double") for c in names)).alias("x"))

    return rows("curve", F.col("label"), "target_curves", curve_features, "name", CURVE_FEATURES), rows("face", F.lit(FACE), "target_faces", face_features, "face_id", FACE_FEATURES)


def fitted(rows: DataFrame, n_features: int, whole: bool) -> DataFrame:
    """logistic.MODEL rows of training rows: for each label of all rows (whole), or of all folds but one for each fold, where the rows hold MIN_SECTIONS sections and MIN_POSITIVES positives."""
    models = logistic.fit(rows, n_features, whole)
    own = rows.groupBy("label", "fold").agg(F.countDistinct("section_id").alias("n"))  # a section has one family
    every = own.groupBy("label").agg(F.sum("n").alias("n_all"))
    out = models.join(every, "label").join(own.select("label", F.col("fold").alias("_f"), "n"), (models["label"] == own["label"]) & models["fold"].eqNullSafe(F.col("_f")) & F.col("fold").isNotNull(), "left")
    return out.where((F.col("n_all") - F.coalesce("n", F.lit(0)) >= MIN_SECTIONS) & (F.col("n_pos") >= MIN_POSITIVES)).select(*(models[c] for c in models.columns))


def train(curve_features: DataFrame, face_features: DataFrame, samples: DataFrame, weights: DataFrame | None = None, mode: str = "logreg") -> Bank:
    """A model for each label with generic samples in two sections and two positives at least, fitted over all labelled entities where they are."""
    lines, faces = training_rows(curve_features, face_features, samples, weights)
    model = lambda names, r: Logistic(list(names), r["mean"], r["std"], r["weights"], r["n_pos"], r["n_neg"])
    curves = {r["label"]: model(CURVE_FEATURES, r) for r in fitted(lines, len(CURVE_FEATURES), True).collect()}  # the registry's labels
    face = fitted(faces, len(FACE_FEATURES), True).collect()
    return Bank(curves, model(FACE_FEATURES, face[0]) if face else None, mode)


def source_weights(variants: DataFrame) -> DataFrame:
    """variants (section_id, source_id, originals with themselves as source): 1 / size of the source's group."""
    return source_weights_of(variants, ["source_id"]).select("section_id", "weight")
