"""Evaluation: set measures per sample, leave-one-family-out folds, invariance under edits, and one summary by grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.scalar import recall_at, set_measures
from spanwise.operators.features import CURVE_FEATURES, FACE_FEATURES
from spanwise.operators.labels import Registry
from spanwise.operators.logistic import probability
from spanwise.operators.mapper import map_queries, whole_faces
from spanwise.operators.models import FACE, fitted, rule_curve_score, rule_face_score, source_weights, training_rows
from spanwise.operators.relational import audit, cut, index_percentile

SCORERS = ("rules", "logreg", "hybrid")


def _typed(kind: str, names: str):
    return F.transform(names, lambda x: F.concat(F.lit(f"{kind}:"), x))


def evaluate(samples: DataFrame, answers: DataFrame, scorer: str, split: str = "orig") -> DataFrame:
    """A row per sample with its measures; samples and answers meet on sample_id = query_id."""
    gold = F.when(F.col("s.entity_type") == "face", _typed("face", "target_faces")).when(F.col("s.entity_type") == "point", F.array_union(_typed("point", "target_points"), _typed("curve", "target_curves"))).otherwise(_typed("curve", "target_curves"))
    pred = F.transform("a.targets", lambda t: F.concat_ws(":", t["kind"], t["name"]))
    ranked = F.transform(F.coalesce("a.candidates", F.array()), lambda c: F.concat(F.when(F.col("s.entity_type") == "face", F.lit("face:")).otherwise(F.lit("curve:")), c["name"]))
    both = samples.alias("s").join(answers.alias("a"), F.col("s.sample_id") == F.col("a.query_id"))
    both = both.select("s.sample_id", "s.section_id", "s.family", "s.label_id", "s.kind", "s.entity_type", "a.decision", "a.confidence", gold.alias("gold"), pred.alias("pred"), ranked.alias("ranked"))
    m = set_measures(F.col("gold"), F.col("pred"))
    same = F.filter("gold", lambda x: x.startswith("face:") | x.startswith("curve:"))
    return both.select(
        F.lit(scorer).alias("scorer"), F.lit(split).alias("split"), "sample_id", "section_id", "family", "label_id", "kind", "entity_type", "decision", "confidence", F.size("gold").alias("n_gold"), F.size("pred").alias("n_pred"),
        *(F.round(m[x], 4).alias(x) for x in ("precision", "recall", "f1", "jaccard")), m["exact"].cast("int").alias("exact"), recall_at(same, F.col("ranked"), 3).alias("cand_recall_at3"), recall_at(same, F.col("ranked"), 20).alias("cand_recall_at20"),
    )


def as_queries(samples: DataFrame) -> DataFrame:
    """Samples as resolved queries: the label is given; specific ones carry their ordinal."""
    none = lambda t: F.lit(None).cast(t)
    return samples.select(F.col("sample_id").alias("query_id"), "section_id", "label_id", F.when(F.col("kind") == "specific", F.col("ordinal")).alias("ordinal"), none("int").alias("count"), none("string").alias("position"), F.lit(1.0).alias("text_score"))


def fold_candidates(registry: Registry, tables: dict[str, DataFrame], families: DataFrame, line_models: DataFrame, face_models: DataFrame) -> DataFrame:
    """``candidates`` of all sections with a column for each scorer: a section is scored by the models that left its family out, and by rules where there is none."""
    short = lambda row: row[0].rsplit(".", 1)[-1]

    def scored(features: DataFrame, kind: str, name: str, names: list[str], models: DataFrame, key, rule) -> DataFrame:
        labels = [F.struct(F.lit(row[0]).alias("label_id"), F.lit(key(row)).alias("label"), rule(row).alias("rules")) for row in registry.labels if row[2] == kind]
        rows = features.join(families.select("section_id", F.col("family").alias("fold")), "section_id")
        rows = rows.select("section_id", F.col(name).alias("name"), "ord", "fold", F.array(*(F.col(c).cast("double") for c in names)).alias("x"), F.explode(F.array(*labels)).alias("l")).select("*", "l.*").drop("l")
        rows = rows.join(models.select("label", "fold", "mean", "std", "weights"), ["label", "fold"], "left")
        p = probability(F.col("x"), F.col("mean"), F.col("std"), F.col("weights"))
        rows = rows.withColumn("p", p)
        return rows.select("label_id", "section_id", F.lit(kind).alias("kind"), "name", "ord", "rules", F.coalesce("p", "rules").alias("logreg"), F.coalesce(0.5 * F.col("rules") + 0.5 * F.col("p"), "rules").alias("hybrid"), F.col("p").isNotNull().alias("has_model"))

    faces = tables["face_features"].join(whole_faces(tables["graph"]), ["section_id", "face_id"])
    by_face = scored(faces, "face", "face_id", FACE_FEATURES, face_models, lambda row: FACE, lambda row: rule_face_score())
    return scored(tables["curve_features"], "curve", "name", CURVE_FEATURES, line_models, short, lambda row: rule_curve_score(short(row))).unionByName(by_face)


def leave_one_family_out(samples: DataFrame, tables: dict[str, DataFrame], families: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Rows of all scorers and folds. tables: sections, points, curves, graph, curve_features, face_features; families (section_id, family, and source_id and ops, the edits' names, if there are variants).

    A fold trains on all families but one, with their variants, and answers the samples of that one. All folds' models are fitted at
    once, and a section's scores come from a join with those of its family's fold, so the plan doesn't grow with the families. Variants
    of the family left out have the split aug. A source and its variants weigh as one section.
    """
    registry = registry or Registry()
    families = families if "source_id" in families.columns else families.withColumn("source_id", F.col("section_id"))
    tables = {k: cut(df) for k, df in tables.items()}
    samples, families = cut(samples), cut(families)
    lines, faces = training_rows(tables["curve_features"], tables["face_features"], samples, source_weights(families), families)
    models = fitted(lines, len(CURVE_FEATURES), False), fitted(faces, len(FACE_FEATURES), False)
    scored = cut(fold_candidates(registry, tables, families, *models))
    out, queries = None, as_queries(samples)
    ops = F.col("ops") if "ops" in families.columns else F.lit("")
    split = families.select("section_id", F.when(F.col("section_id") == F.col("source_id"), "orig").otherwise("aug").alias("split"), ops.alias("ops"))
    for scorer in SCORERS:
        one = scored.select("label_id", "section_id", "kind", "name", "ord", F.col(scorer).alias("score"), F.when(F.col("has_model"), scorer).otherwise("rules").alias("scorer"), F.array().cast("array<string>").alias("contributions"))
        answers = map_queries(queries, registry=registry, top_k=100, scored=one, ready=True, **tables)
        rows = evaluate(samples, answers, scorer).drop("split").join(split, "section_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def summarise(rows: DataFrame) -> DataFrame:
    """Means overall and by label, family, kind, entity type, split and edits, per scorer, in one grouping-sets query. Null recalls are skipped, empty means 0."""
    keys = ["label_id", "family", "kind", "entity_type", "split", "ops"]
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return rows.groupingSets([["scorer"], *(["scorer", k] for k in keys)], "scorer", *keys).agg(F.count("*").alias("n"), *(mean(c).alias(c) for c in ("precision", "recall", "f1", "jaccard")), mean(F.col("exact").cast("double")).alias("exact_acc"), mean("cand_recall_at3").alias("cand_recall_at3"), mean("cand_recall_at20").alias("cand_recall_at20"))


def decisions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scorer", "decision").agg(F.count("*").alias("n"))


def latency(rows: DataFrame) -> DataFrame:
    """rows (scorer, latency_ms): index percentiles."""
    return index_percentile(rows, ["scorer"], "latency_ms")


def invariance(source_scores: DataFrame, variant_scores: DataFrame, lineage: DataFrame) -> DataFrame:
    """1 - mean absolute difference between an entity's score and the mean of its children's, per variant and label.

    scores (section_id, label_id, name, score); lineage (source_id, variant_id, name_map map<string, array<string>>).
    """
    kids = lineage.select("source_id", "variant_id", F.explode("name_map").alias("name", "children")).select("source_id", "variant_id", "name", F.explode("children").alias("child"))
    v = variant_scores.select(F.col("section_id").alias("variant_id"), "label_id", F.col("name").alias("child"), F.col("score").alias("child_score"))
    means = kids.join(v, ["variant_id", "child"]).groupBy("source_id", "variant_id", "label_id", "name").agg(F.avg("child_score").alias("mean"))
    both = means.join(source_scores.withColumnRenamed("section_id", "source_id"), ["source_id", "label_id", "name"])
    return both.groupBy("source_id", "variant_id", "label_id").agg(F.count("*").alias("n_pairs"), F.round(1 - F.avg(F.abs(F.col("score") - F.col("mean"))), 4).alias("consistency"))


def feature_shift(source: DataFrame, variant: DataFrame, tried: DataFrame) -> DataFrame:
    """(feature, mean_abs, unstable): how far a curve's features are from the mean of its pieces', over all source curves and over all features at once.

    source and variant are feature tables (section_id, name, features), tried the accepted variants with their name_map.
    """
    kids = tried.select("section_id", "variant_id", F.explode("name_map").alias("name", "children")).select("section_id", "variant_id", "name", F.explode("children").alias("child"))
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in CURVE_FEATURES))
    tall = lambda df: df.select("section_id", "name", F.explode(pairs).alias("x")).select("section_id", "name", "x.*")
    after = tall(variant).select(F.col("section_id").alias("variant_id"), F.col("name").alias("child"), "feature", "value")
    means = kids.join(after, ["variant_id", "child"]).groupBy("section_id", "variant_id", "name", "feature").agg(F.avg("value").alias("after"))
    both = means.join(tall(source), ["section_id", "name", "feature"])
    return audit(both, ["feature"], "value", "after")
