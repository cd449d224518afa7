"""Verification finds what was broken, and nothing where all is whole."""

from pyspark.sql import functions as F

from spanwise.operators import augment as A
from spanwise.operators import topology, variants, verify
from spanwise.operators.relational import cut
from tests.test_augment import corpus_of


def counts(df):
    return {r.check_name: r.n for r in df.collect()}


def test_release(spark, tmp_path):
    corpus = corpus_of(spark, tmp_path)
    rows = topology.section_rows(corpus["sections"], corpus["points"], corpus["curves"]).withColumn("control", F.lit(None).cast(f"array<{topology.UV}>"))
    ok = cut(variants.accepted(A.attempts(rows, 2, seed=3, edits=["scale"])))
    new = cut(variants.propagated(corpus["targets"], ok, corpus["graph"], {k: cut(df) for k, df in variants.tables(ok).items()}))
    assert ok.count() == 2 and set(counts(verify.records(ok, new)).values()) == {0}
    assert set(counts(verify.release(ok, ok.count(), 1)).values()) == {0} and counts(verify.release(ok, ok.count() + 2, 1))["record_count"] == 2
    assert {r.edit: r.n for r in verify.edit_counts(ok).collect()} == {"scale": 2}
    again = A.attempts(rows.repartition(3), 2, seed=3, edits=["scale"])
    columns = ["variant_id", "fingerprint", "ops", "reason"]
    assert set(counts(verify.replayed(ok, variants.accepted(again), columns)).values()) == {0}
    assert counts(verify.replayed(ok, ok.limit(ok.count() - 1), columns)) == {"lost_in_replay": 1, "new_in_replay": 0}
    broken = ok.withColumn("points", F.slice("points", 1, 2))
    assert counts(verify.records(broken, new))["missing_curve_end"] == ok.count()
    assert counts(verify.records(ok.unionByName(ok), new))["duplicate_variant"] == ok.count()
    lost = new.withColumn("curve_names", F.array(F.lit("nowhere")))
    assert counts(verify.records(ok, lost))["unknown_target_curve"] == new.count()


def test_sources(spark):
    cols = "section_id string, file string, sha256 string"
    a = spark.createDataFrame([("s", "s.py", "1"), ("s", "s.yaml", "2"), ("t", "t.py", "3")], cols)
    b = spark.createDataFrame([("s", "s.py", "1"), ("s", "s.yaml", "9"), ("u", "u.py", "4")], cols)
    assert counts(verify.sources(a, b)) == {"source_hash_mismatch": 1, "source_missing": 1, "source_unknown": 1}
    import hashlib
    import json

    m = {r.section_id: r.manifest_sha256 for r in verify.manifest(a).collect()}
    text = json.dumps([{"file": "s.py", "sha256": "1"}, {"file": "s.yaml", "sha256": "2"}], sort_keys=True, separators=(",", ":"))
    assert m["s"] == hashlib.sha256(text.encode()).hexdigest()


def test_reports(spark):
    """Reports and hashes survive writing and reading; every damage is found by its own check."""
    cols = "section_id string, variant_id string, reason string, clearance double, agreement double"
    rows = [("s", "s@1", "ok", 2.5, 0.99), ("s", "s@2", "gate4_affine", 3.0, 0.5), ("t", "t@1", "gate1_cells", 1.0, None), ("t", None, "move_not_applicable", None, None)]
    files = spark.createDataFrame([("s", "s.py", "1"), ("s", "s.yaml", "2"), ("t", "t.py", "3")], "section_id string, file string, sha256 string")
    made = verify.reported(spark.createDataFrame(rows, cols), files)
    got = {r.variant_id: r for r in made.collect()}
    assert [g.passed for g in got["s@1"].validation.gates] == [True] * 6 and got["s@1"].validation.failures == [] and got["s@1"].validation.gates[3].value == 0.99
    assert [g.passed for g in got["s@2"].validation.gates] == [True, True, True, False, None, None] and got["s@2"].validation.failures == ["gate4_affine"]
    assert [g.passed for g in got[None].validation.gates] == [None] * 6 and not got[None].validation.passed
    assert [(f.file, f.sha256) for f in got["s@1"].source_manifest] == [("s.py", "1"), ("s.yaml", "2")]
    schema = f"{cols}, {variants.REPORTED}"
    back = cut(made.select(F.to_json(F.struct("*")).alias("j")).select(F.from_json("j", schema).alias("r")).select("r.*"))
    assert set(counts(verify.reports(back, files)).values()) == {0}
    v = F.col("validation")
    first = F.col("variant_id") == "s@1"
    damaged = {
        "verdict_against_reason": back.withColumn("reason", F.when(first, "gate6_clearance").otherwise(F.col("reason"))),
        "verdict_against_failures": back.withColumn("validation", F.when(first, v.withField("failures", F.array(F.lit("x")))).otherwise(v)),
        "verdict_against_gates": back.withColumn("validation", F.when(first, v.withField("gates", F.transform(v["gates"], lambda g: g.withField("passed", F.lit(False))))).otherwise(v)),
        "manifest_hash_mismatch": back.withColumn("source_manifest", F.when(first, F.slice("source_manifest", 1, 1)).otherwise(F.col("source_manifest"))),
    }
    for name, df in damaged.items():
        assert counts(verify.reports(df, files))[name] == 1, name
    changed = files.withColumn("sha256", F.when(F.col("file") == "t.py", "9").otherwise(F.col("sha256")))
    assert counts(verify.reports(back, changed)) | {"source_changed": 2} == counts(verify.reports(back, changed))


def test_source_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a.py").write_bytes(b"x = 1\n")
    (tmp_path / "a" / "a.yaml").write_bytes(b"\n")
    got = {(r.section_id, r.file): r.sha256 for r in verify.source_files(spark, str(tmp_path)).collect()}
    assert got == {("a", "a.py"): hashlib.sha256(b"x = 1\n").hexdigest(), ("a", "a.yaml"): hashlib.sha256(b"\n").hexdigest()}


def test_canonical_json(spark):
    """As Python's own, with sorted keys and no blanks, on what needs escaping and any nesting."""
    import json

    import pytest
    from pyspark.sql import types as T

    from spanwise.functions.scalar import canonical_json

    schema = T._parse_datatype_string("z string, a struct<y: int, b: array<string>>, m map<string, array<struct<q: boolean, c: bigint>>>, n array<array<int>>")
    odd = ['plain', '', 'q"uo\\te', 'tab\tnew\nline\r\b\f', 'é ñ 日本 \U0001f600', '\x00\x1f\x7f\x80', 'ends\n', "'</script>"]
    rows = [(x, (k, [x, None, "b"]), {x: [(True, 1 << 60)], "k": [], "a": None}, [[1], None, []]) for k, x in enumerate(odd)] + [(None, None, None, None)]
    got = [r.j for r in spark.createDataFrame(rows, schema).coalesce(1).select(canonical_json(F.struct("*"), schema).alias("j")).collect()]
    dump = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"))
    for (z, a, m, n), j in zip(rows, got, strict=True):
        want = {"z": z, "a": a and {"y": a[0], "b": a[1]}, "m": m and {k: v and [{"q": q, "c": c} for q, c in v] if v else v for k, v in m.items()}, "n": n}
        assert j == dump(want)
    with pytest.raises(TypeError, match="double"):
        canonical_json(F.lit(0.5), T.DoubleType())


def test_verify_command(spark, tmp_path):
    """What augment wrote verifies, replay included; a source that changed afterwards is found."""
    import argparse

    from spanwise.plans import corpus
    from tests.fixtures import FIXTURES, macro
    from tests.test_sources import YAML

    folder = tmp_path / "in" / "ladder"
    folder.mkdir(parents=True)
    (folder / "ladder.py").write_text(macro("ladder", *FIXTURES["ladder"]))
    (folder / "ladder.yaml").write_text(YAML.format("ladder", 0))
    built = corpus.build(spark, str(tmp_path / "in"))
    args = argparse.Namespace(path=str(tmp_path / "in"), out=str(tmp_path / "out"), per_section=2, seed=1, quota=0, variants=str(tmp_path / "out" / "variants"))
    corpus.augmented(built, args)
    (folder / "ladder.yaml").write_text(YAML.format("ladder", 0) + "# seen\n")
    got = counts(corpus.verified(built, args))
    n = variants.read_variants(spark, args.variants).count()
    assert n > 0 and {k: v for k, v in got.items() if v} == {"source_hash_mismatch": 1, "source_changed": n}
