"""The corpus job and a command line: build, train, evaluate, map, export, augment, audit, extract, verify."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.operators import augment, evaluate, features, labels, mapper, models, silver, topology, variants, verify
from spanwise.operators.relational import cut
from spanwise.plans import reports
from spanwise.sources import edges, files, sections


def build(spark: SparkSession, path: str, registry: labels.Registry | None = None) -> dict[str, DataFrame]:
    """All tables of the sections below a folder.

    Tables that many later ones read are checkpointed, not only cached: a plan that holds its readers' whole lineage several times
    over takes longer to analyse than its job to run.
    """
    meta, regions = (cut(df) for df in files.read_annotations(spark, path))
    named = meta.select("section_id").distinct()  # a folder without annotations, or with some that can't be read, is no section
    s, p, c = (cut(df) for df in sections.localised(*(cut(df.join(named, "section_id", "left_semi")) for df in sections.read_sections(spark, path))))
    graph = cut(topology.graph(s, p, c))
    targets = cut(silver.silver(s, p, c, graph, regions, registry))
    t = {"sections": s, "points": p, "curves": c, "graph": graph, "curve_features": cut(features.curve_features(s, p, c, graph)), "face_features": cut(features.face_features(s, p, graph))}
    return {**t, "meta": meta, "regions": regions, "targets": targets, "samples": cut(silver.samples(targets, meta, registry))}


def tables_of(corpus: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {k: corpus[k] for k in ("sections", "points", "curves", "graph", "curve_features", "face_features")}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanwise")
    parser.add_argument("command", choices=["build", "train", "eval", "map", "export", "augment", "audit-features", "extract", "verify", "all"])
    parser.add_argument("path")
    parser.add_argument("--out", default="out")
    parser.add_argument("--section")
    parser.add_argument("--query")
    parser.add_argument("--model")
    parser.add_argument("--scorer", default="hybrid", choices=evaluate.SCORERS)
    parser.add_argument("--per-section", type=int, default=20)
    parser.add_argument("--seed", type=int, default=1)
    parser.add_argument("--quota", type=int, default=0)
    parser.add_argument("--variants", help="folder of variants written by augment")
    parser.add_argument("--labels", help="registry file of labels, position and ordinal words")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("spanwise").getOrCreate()
    if args.command == "extract":
        edges.write(spark, args.path, args.out)
        return 0
    registry = labels.Registry.read(spark, args.labels) if args.labels else None
    corpus = build(spark, args.path, registry)
    if args.command == "map":
        return answer(spark, corpus, args.section, args.query, args.model, args.scorer, registry)
    steps = {
        "build": built, "train": lambda c, a: trained(c).save(f"{a.out}/model.json"), "eval": evaluated, "augment": augmented, "audit-features": audited,
        "export": lambda c, a: reports.write_lines(reports.bundle(*(c[k] for k in ("sections", "points", "curves", "graph")), c["targets"]), f"{a.out}/bundle"),
    }
    Path(args.out).mkdir(parents=True, exist_ok=True)
    if args.command == "verify":
        found = verified(corpus, args)
        reports.write_lines(found, f"{args.out}/checks")
        return int(bool(found.where("n > 0").count()))
    for name in steps if args.command == "all" else [args.command]:
        steps[name](corpus, args)
    return 0


def trained(corpus: dict[str, DataFrame], mode: str = "logreg") -> models.Bank:
    return models.train(corpus["curve_features"], corpus["face_features"], corpus["samples"], mode=mode)


def answer(spark: SparkSession, corpus: dict[str, DataFrame], section: str, query: str, model: str | None, scorer: str, registry: labels.Registry | None = None) -> int:
    """Print the answer to one query."""
    bank = models.Bank.load(model, scorer) if model else trained(corpus, scorer)
    asked = spark.createDataFrame([("q", section, query)], "query_id string, section_id string, text string")
    for r in mapper.map_queries(asked, bank=bank, registry=registry, **tables_of(corpus)).toJSON().collect():
        print(r)
    return 0


def built(corpus: dict[str, DataFrame], args: argparse.Namespace) -> None:
    reports.write_lines(corpus["samples"], f"{args.out}/samples")
    silver_report = silver.report(corpus["targets"])
    reports.write_lines(silver_report, f"{args.out}/silver_report")
    reports.write_report({"Weak labels": silver_report.orderBy("function")}, f"{args.out}/silver_markdown")


def evaluated(corpus: dict[str, DataFrame], args: argparse.Namespace) -> None:
    """Fold rows, summary and decisions; with --variants, accepted variants train and answer as well, and their consistency is reported."""
    t, samples, families = tables_of(corpus), corpus["samples"], corpus["meta"].select("section_id", "family").withColumn("source_id", F.col("section_id"))
    parts = {}
    if args.variants:
        tried = variants.read_variants(samples.sparkSession, args.variants)
        both, new = with_variants(corpus, tried)
        families = variants.families(corpus["meta"], tried)
        samples = samples.unionByName(silver.samples(new, families.select("section_id", "family")))
        bank = trained(corpus, args.scorer)
        scores = lambda c: mapper.candidates(labels.Registry(), bank, c["curve_features"], c["face_features"], c["graph"]).where("kind = 'curve'").select("section_id", "label_id", "name", "score")
        lineage = variants.accepted(tried).select(F.col("section_id").alias("source_id"), "variant_id", "name_map")
        consistent = evaluate.invariance(scores(t), scores(both), lineage).groupBy("label_id").agg(F.count("*").alias("n"), F.avg("consistency").alias("consistency"))
        parts["Consistency under edits"] = consistent.orderBy("label_id")
        t = both
    rows = evaluate.leave_one_family_out(samples, t, families).persist()
    parts = {"Summary": evaluate.summarise(rows), "Decisions": evaluate.decisions(rows), **parts}
    reports.write_lines(rows, f"{args.out}/rows")
    reports.write_lines(parts["Summary"], f"{args.out}/summary")
    reports.write_lines(parts["Decisions"], f"{args.out}/decisions")
    reports.write_report(parts, f"{args.out}/evaluation")


def with_variants(corpus: dict[str, DataFrame], tried: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The corpus' tables with those of accepted variants, and the variants' targets."""
    more = {k: cut(df) for k, df in variants.tables(tried).items()}
    new = cut(variants.renumbered(variants.propagated(corpus["targets"], tried, corpus["graph"], more), more))
    more |= {"curve_features": cut(features.curve_features(*(more[k] for k in ("sections", "points", "curves", "graph")))), "face_features": cut(features.face_features(more["sections"], more["points"], more["graph"]))}
    return variants.union_tables(corpus, more, list(tables_of(corpus))), new


def augmented(corpus: dict[str, DataFrame], args: argparse.Namespace) -> None:
    tried, new, status = variants.generate(corpus, corpus["regions"], args.per_section, args.seed, args.quota)
    files_now = verify.source_files(tried.sparkSession, args.path)
    reports.write_lines(verify.reported(variants.accepted(tried), files_now).orderBy("variant_id"), f"{args.out}/variants")
    reports.write_lines(verify.manifest(files_now).drop("files"), f"{args.out}/manifest")
    reports.write_lines(files_now, f"{args.out}/sources")
    reports.write_lines(new, f"{args.out}/variant_targets")
    reports.write_report({"Rejections": augment.accounting(tried), "Quota": status, "Agreement": augment.agreement_figures(tried), "Clearance": augment.clearance_figures(tried), "Labels of variants": new.groupBy("label_id").agg(F.count("*").alias("n"), F.countDistinct("section_id").alias("n_variants")).orderBy("label_id"), "Edits": verify.edit_counts(tried)}, f"{args.out}/augmentation")


def audited(corpus: dict[str, DataFrame], args: argparse.Namespace) -> None:
    """Per feature, how far splits alone move it: curves against the mean of their pieces, over one split of each section."""
    tried = cut(augment.attempts(variants.drawn(corpus), 1, args.seed, edits=["split"]))
    more, _ = with_variants(corpus, tried)
    reports.write_lines(evaluate.feature_shift(corpus["curve_features"], more["curve_features"], variants.accepted(tried)), f"{args.out}/feature_audit")


def verified(corpus: dict[str, DataFrame], args: argparse.Namespace) -> DataFrame:
    """All checks of a folder that augment wrote (--variants: its variants; beside them the hashes of its sources): records, counts, reports, sources, and their replay with the same seed."""
    spark = corpus["samples"].sparkSession
    written = cut(variants.read_variants(spark, args.variants, reports=True))
    tried = cut(written.drop("validation", "source_manifest", "source_sha256"))
    _, new = with_variants(corpus, tried)
    again, _, _ = variants.generate(corpus, corpus["regions"], args.per_section, args.seed, args.quota)
    now, recorded = verify.source_files(spark, args.path), spark.read.schema("section_id string, file string, sha256 string").json(f"{str(args.variants).rstrip('/')}/../sources")
    n = variants.accepted(again).agg(F.count("*").alias("n"), F.countDistinct("section_id").alias("s")).first()
    parts = [verify.records(tried, new), verify.release(tried, n["n"], n["s"]), verify.reports(written, now), verify.sources(now, recorded), verify.replayed(tried, variants.accepted(again), ["variant_id", "fingerprint", "ops"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


if __name__ == "__main__":
    raise SystemExit(main())
