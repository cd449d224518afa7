"""Verification of written data: every check counts what breaks it, as joins and aggregates over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions.scalar import canonical_json, is_subset
from spanwise.operators.variants import accepted


def check(df: DataFrame, name: str) -> DataFrame:
    """(check_name, n): how many rows there are, which should be none."""
    return df.agg(F.lit(name).alias("check_name"), F.count("*").alias("n"))


#: What a manifest's hash is taken of.
MANIFEST = T.ArrayType(T.StructType([T.StructField("file", T.StringType()), T.StructField("sha256", T.StringType())]))


def manifest(files: DataFrame) -> DataFrame:
    """(section_id, files, manifest_sha256) from the hashes of source files (section_id, file, sha256): the hash of their canonical JSON in the order of files."""
    per = files.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("files"))
    return per.withColumn("manifest_sha256", F.sha2(canonical_json(F.col("files"), MANIFEST), 256))


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(section_id, file, sha256) of all files below a folder, by name, but those without a byte; a file's section is its folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("section_id"), F.element_at(parts, -1).alias("file"), F.sha2("content", 256).alias("sha256"))


#: The gates in their order, by the start of the reason that a failing one leaves, with the figure that they look at.
GATES = {"cells": "gate1", "non_empty": "gate2", "label_pairs": "gate3", "affine": "gate4", "fingerprint": "gate5", "clearance": "gate6"}
REPORT = "struct<passed: boolean, gates: array<struct<gate: string, passed: boolean, value: double>>, failures: array<string>>"


def reported(tried: DataFrame, files: DataFrame) -> DataFrame:
    """tried with ``validation`` (REPORT) and the hashes of the source that each was made of: ``source_manifest`` and ``source_sha256``.

    A gate before the one that failed was passed; one after it has null, as it was not asked. An edit that couldn't be applied has no gate at all.
    """
    names, starts = list(GATES), list(GATES.values())
    failed = F.coalesce(*(F.when(F.col("reason").startswith(g), F.lit(k)) for k, g in enumerate(starts)), F.when(F.col("reason") == "ok", F.lit(len(starts))))
    value = {"affine": F.col("agreement") if "agreement" in tried.columns else F.lit(None), "clearance": F.col("clearance")}
    gates = F.array(*(F.struct(F.lit(n).alias("gate"), F.when(failed > k, True).when(failed == k, False).alias("passed"), value.get(n, F.lit(None)).cast("double").alias("value")) for k, n in enumerate(names)))
    ok = F.col("reason") == "ok"
    report = F.struct(ok.alias("passed"), gates.alias("gates"), F.when(ok, F.array().cast("array<string>")).otherwise(F.array("reason")).alias("failures")).cast(REPORT)
    of = manifest(files).select("section_id", F.col("files").alias("source_manifest"), F.col("manifest_sha256").alias("source_sha256"))
    return tried.withColumn("validation", report).join(of, "section_id", "left")


def reports(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Checks of rows that ``reported`` made and someone may have changed: verdicts against gates and reasons, manifests against their hash, and hashes against the files of today."""
    gates = F.transform("validation.gates", lambda g: g["passed"])
    all_passed = F.forall(gates, lambda g: g.eqNullSafe(F.lit(True)))
    ok = F.col("reason") == "ok"
    own = F.sha2(canonical_json(F.col("source_manifest"), MANIFEST), 256)
    now = manifest(files).select("section_id", F.col("manifest_sha256").alias("_now"))
    checks = [
        check(rows.where(~F.col("validation.passed").eqNullSafe(all_passed)), "verdict_against_gates"), check(rows.where(~F.col("validation.passed").eqNullSafe(ok)), "verdict_against_reason"),
        check(rows.where((F.size("validation.failures") > 0).eqNullSafe(F.col("validation.passed"))), "verdict_against_failures"), check(rows.where(F.transform("validation.gates", lambda g: g["gate"]) != F.array(*map(F.lit, GATES))), "unknown_gate"),
        check(rows.where(~own.eqNullSafe(F.col("source_sha256"))), "manifest_hash_mismatch"),
        check(rows.join(now, "section_id", "left").where(~F.col("_now").eqNullSafe(F.col("source_sha256"))), "source_changed"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def sources(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Checks of source files: those whose hash isn't the recorded one, and those that are missing or new. Both (section_id, file, sha256)."""
    both = now.alias("a").join(recorded.alias("b"), ["section_id", "file"], "full_outer")
    a, b = F.col("a.sha256"), F.col("b.sha256")
    parts = [check(both.where(a.isNotNull() & b.isNotNull() & (a != b)), "source_hash_mismatch"), check(both.where(a.isNull()), "source_missing"), check(both.where(b.isNull()), "source_unknown")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def records(tried: DataFrame, targets: DataFrame) -> DataFrame:
    """Checks of written variants and their targets (section_id: the variant's): unique ids and names, known ends, children and labelled curves, accepted rows alone, each with a target."""
    ok = accepted(tried)
    names = F.transform("curves", lambda c: c["name"])
    points = F.transform("points", lambda p: p["name"])
    ends = F.flatten(F.transform("curves", lambda c: F.array(c["start"], c["end"])))
    twice = lambda key: tried.groupBy(key).agg(F.count("*").alias("k")).where(F.col(key).isNotNull() & (F.col("k") > 1))
    has = targets.where(~F.array_contains("flags", "synthetic")).select(F.col("section_id").alias("variant_id")).distinct()
    of = ok.select(F.col("variant_id").alias("section_id"), names.alias("_names"))
    checks = [
        check(twice("variant_id"), "duplicate_variant"), check(twice("fingerprint"), "duplicate_fingerprint"), check(tried.where("reason <> 'ok'"), "failed_gate"),
        check(ok.where(F.size(F.array_distinct(names)) < F.size(names)), "duplicate_curve_name"), check(ok.where(~is_subset(ends, points)), "missing_curve_end"),
        check(ok.where(~is_subset(F.flatten(F.map_values("name_map")), names)), "unknown_child"), check(ok.join(has, "variant_id", "left_anti"), "variant_without_target"),
        check(targets.join(of, "section_id", "left_anti"), "target_without_variant"), check(targets.join(of, "section_id").where(~is_subset(F.col("curve_names"), F.col("_names"))), "unknown_target_curve"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def release(tried: DataFrame, n_records: int, n_sources: int) -> DataFrame:
    """Checks of a release's counts: records and sources that differ from what it states."""
    n = accepted(tried).agg(F.count("*").alias("r"), F.countDistinct("section_id").alias("s"))
    return n.select(F.explode(F.array(F.struct(F.lit("record_count").alias("check_name"), F.abs(F.col("r") - n_records).alias("n")), F.struct(F.lit("source_count").alias("check_name"), F.abs(F.col("s") - n_sources).alias("n")))).alias("x")).select("x.*")


def edit_counts(tried: DataFrame) -> DataFrame:
    """How often accepted variants have each edit."""
    return accepted(tried).select(F.explode("edits").alias("edit")).groupBy("edit").agg(F.count("*").alias("n"))


def replayed(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that one of two runs lacks, counted as often as they are missing, both ways."""
    a, b = (df.select(*columns) for df in (expected, actual))
    return check(a.exceptAll(b), "lost_in_replay").unionByName(check(b.exceptAll(a), "new_in_replay"))
