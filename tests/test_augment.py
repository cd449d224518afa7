"""Edits keep what they should: lengths under split, areas under rigid moves, lineage, gates, targets, reruns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.operators import augment as A
from spanwise.operators import topology, variants
from spanwise.operators.relational import cut
from tests.fixtures import FIXTURES, macro

SECTION = "section_id string, kind string, name string, ord int, u double, v double, start string, end string, control array<struct<u: double, v: double>>, plane string"


def sketch(name, k=1.0, bent=None):
    points, curves = FIXTURES[name]
    return A.drawing({n: (float(u) * k, float(v) * k) for n, (u, v) in points.items()}, {c: (a, b, (bent or {}).get(c)) for c, a, b in curves})


def rows_of(spark, **sizes):
    rows = []
    for name, k in sizes.items():
        points, curves = FIXTURES[name]
        rows += [(name, "point", n, i, k * u, k * v, None, None, None, "YZ") for i, (n, (u, v)) in enumerate(points.items())]
        rows += [(name, "curve", c, i, None, None, a, b, None, "YZ") for i, (c, a, b) in enumerate(curves)]
    return spark.createDataFrame(rows, SECTION)


@pytest.mark.parametrize("seed", range(5))
def test_split_keeps_the_drawing(seed):
    d = sketch("ladder", bent={"R1": ((13.0, 41.0), (27.0, 39.0))})
    before = d.graph()
    out, _ = A.split(d, before, np.random.default_rng(seed))
    after = out.graph()
    assert [round(f.area, 1) for f in after.faces] == [round(f.area, 1) for f in before.faces]
    kids = out.lineage(d.curves)
    for c, v in kids.items():
        assert sum(after.arcs[k].length for k in v) == pytest.approx(before.arcs[c].length, rel=2e-3)
    assert {k for v in kids.values() for k in v} == set(out.curves)


def test_cuts_keep_their_distance():
    """Cuts lie in [0.2, 0.8] and 0.15 apart or more, however many there are."""
    d, many = sketch("square", 10.0), 0
    for seed in range(150):
        out, _ = A.split(d, d.graph(), np.random.default_rng(seed))
        for c, kids in out.lineage(d.curves).items():
            if len(kids) > 1:
                a = np.array([np.linalg.norm(p[-1] - p[0]) for k, p in zip(out.curves, out.polylines(), strict=True) if k in kids]) / 100
                at = np.cumsum(a)[:-1]
                assert at[0] >= 0.2 - 1e-9 and at[-1] <= 0.8 + 1e-9 and (np.diff(at) >= 0.15 - 1e-9).all(), c
                many += len(at) == 3
    assert many > 20


@pytest.mark.parametrize("kind", A.KINDS)
def test_rigid_keeps_areas(kind):
    d = A.transformed(sketch("ladder"), np.array(A.MATRIX[kind], float))
    assert sorted(round(f.area, 6) for f in d.graph().faces) == [1600.0] * 3
    p = np.array([7.0, 11.0])
    assert np.allclose(d.frame[:, :2] @ p + d.frame[:, 2], A.transformed(sketch("ladder"), np.array(A.MATRIX[kind], float)).frame @ [7, 11, 1]) and (d.xy.min(0) == 0).all()


def test_plane_changes_and_axes_stay():
    d = sketch("ladder")
    got = {A.rigid(d, d.graph(), np.random.default_rng(k))[1]["plane"] for k in range(60)}
    assert got == set(A.PLANES)


def test_scale_keeps_the_long_axis():
    d = sketch("ladder")
    for seed in range(50):
        out, how = A.scale(d, d.graph(), np.random.default_rng(seed))
        assert out.size[1] >= 1.2 * out.size[0] - 1e-6 and 0.6 <= min(how["su"], how["sv"]) and max(how["su"], how["sv"]) <= 1.6001


def test_move_stretches_along_and_keeps_tips():
    d = sketch("t_rung")
    tip = {d.points[p]: d.curves[k] for p, k, _ in A.tips(d)}
    assert tip == {"E": "L4", "F": "L2", "G": "L4", "H": "L2"}
    for seed in range(20):
        out, how = A.move(d, d.graph(), np.random.default_rng(seed))
        assert abs(how["delta"]) >= 1 and len(out.graph().faces) == 3 and len(A.tips(out)) == 4
        assert out.size.sum() == pytest.approx(d.size.sum() + how["delta"], abs=1e-3)
    turned = A.transformed(sketch("square"), np.array([[0.8, -0.6], [0.6, 0.8]]))
    assert A.move(turned, turned.graph(), np.random.default_rng(0)) is None


def test_ribs():
    d = sketch("square", 4.0)
    out, how = A.rib(d, d.graph(), np.random.default_rng(2), mode="add")
    assert how["cells"] == 1 and len(out.graph().faces) == 2 and out.source[-1] == ""
    d = sketch("ladder")
    out, how = A.rib(d, d.graph(), np.random.default_rng(2), mode="delete")
    assert how["cells"] == -1 and len(out.graph().faces) == 2 and set(out.points) == {p for e in out.ends for p in np.array(out.points)[e]}
    # A line through a cell needs two hosts, and room to both nodes and parallel sides.
    assert all(3 <= min(abs(p[1] - y) for p in ends for y in (0, 40, 80, 120)) for _, ends in A.rib_places(d, d.graph(), 0.5))
    assert A.rib(sketch("chain"), sketch("chain").graph(), np.random.default_rng(2)) is None


def test_fingerprint_and_clearance():
    assert A.fingerprint(sketch("ladder")) == A.fingerprint(sketch("ladder")) != A.fingerprint(sketch("square"))
    assert A.clearance(sketch("ladder").graph()) == 40.0


def test_plans(spark):
    """Kinds come by weight, without repeats and in the order of application; reruns agree."""
    ids = spark.createDataFrame([(f"s{k}",) for k in range(40)], "section_id string")
    got = A.plans(ids, 50, seed=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, A.plans(ids.repartition(7), 50, seed=3).collect()))
    one = [r.edits[0] for r in got if len(r.edits) == 1]
    assert 0.55 < len(one) / len(got) < 0.65 and 0.3 < one.count("split") / len(one) < 0.45 and 0.03 < one.count("rib") / len(one) < 0.1
    assert all(len(set(r.edits)) == len(r.edits) and r.edits == sorted(r.edits, key=A.ORDER.index) for r in got)


def test_generation(spark, tmp_path):
    df = rows_of(spark, square=6.0, ladder=1.0)
    tried = A.settled(A.attempts(df, per_section=6), A.source_fingerprints(df)).cache()
    again = A.settled(A.attempts(df.repartition(3), per_section=6), A.source_fingerprints(df))
    assert sorted(map(str, tried.collect())) == sorted(map(str, again.collect()))
    ok = [r for r in tried.collect() if r.reason == "ok"]
    assert 6 <= len(ok) <= 12 and len({r.fingerprint for r in ok}) == len(ok)
    assert A.fingerprint(sketch("square", 6.0)) not in {r.fingerprint for r in ok}
    assert {r.n for r in A.clearance_figures(tried).collect()} == {len(ok)}
    t = variants.tables(tried)
    assert t["sections"].count() == len(ok) and t["curves"].count() == sum(len(r.curves) for r in ok)
    tried.withColumn("agreement", F.lit(None).cast("double")).write.json(f"{tmp_path}/v")
    back = variants.read_variants(spark, f"{tmp_path}/v").drop("agreement")
    assert sorted(map(str, back.collect())) == sorted(map(str, tried.collect()))


def test_pilot(spark):
    s = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b"), ("c2", "c"), ("c1", "c")], "section_id string, family string")
    assert [r.section_id for r in A.pilot(s, ["a2"], 3).collect()] == ["a2", "b1", "c1"]


CORPUS: dict = {}


def corpus_of(spark, tmp_path):
    """The corpus of one ladder, built once for all tests."""
    from spanwise.plans.corpus import build

    if CORPUS:
        return CORPUS
    points, curves = FIXTURES["ladder"]
    folder = tmp_path / "ladder-1"
    folder.mkdir()
    (folder / "ladder-1.py").write_text(macro("ladder-1", points, curves))
    regions = "".join(f'  - {{name: chamber_{k}, function: enclosed, bbox: {{x: 0, y: {40 * (3 - k)}, width: 40, height: 40}}}}\n' for k in (1, 2, 3))
    regions += "  - {name: web_1, function: stiffener, bbox: {x: 0, y: 79, width: 40, height: 2}}\n  - {name: web_2, function: stiffener, bbox: {x: 0, y: 39, width: 40, height: 2}}\n"
    (folder / "ladder-1.yaml").write_text(f"id: ladder-1\nshape: {{primary: ladder}}\nregions:\n{regions}")
    CORPUS.update({k: cut(df) for k, df in build(spark, str(tmp_path)).items()})
    return CORPUS


def test_targets_follow(spark, tmp_path):
    """Faces, curves, gates, numbers and boxes of variants of a ladder."""
    corpus = corpus_of(spark, tmp_path)
    assert {r.region_name: len(r.face_ids) for r in corpus["targets"].collect() if r.entity_type == "face"} == {f"chamber_{k}": 1 for k in (1, 2, 3)}
    tried, new, status = variants.generate(corpus, corpus["regions"], per_section=3)
    ok = {r.variant_id: r for r in tried.collect() if r.reason == "ok"}
    got: dict = {}
    for r in new.collect():
        got.setdefault(r.section_id, []).append(r)
    assert ok.keys() == got.keys() and ok
    for v, rows in got.items():
        chambers = sorted((r for r in rows if r.label_id == variants.CHAMBER), key=lambda r: r.ordinal or 0)
        assert all(len(r.face_ids) == 1 for r in chambers) and len({r.face_ids[0] for r in chambers}) == len(chambers)
        assert [r.ordinal for r in chambers] == list(range(1, len(chambers) + 1)) or len(chambers) < 2
        if "rib" not in ok[v].edits:
            assert len(chambers) == 3
        names = {c.name for c in ok[v].curves}
        assert all(set(r.curve_names) <= names for r in rows)
        assert sum("synthetic" in r.flags for r in rows) == 1
    assert all(r.agreement == pytest.approx(1.0) for r in ok.values() if set(r.edits) <= {"scale", "rigid"} and r.agreement is not None)
    assert {r.label for r in status.collect()} == {"chamber", "internal_web"}


def test_gates_on_targets(spark, tmp_path):
    """A lost target, labels that meet anew and boxes that match other curves reject a variant."""
    corpus = corpus_of(spark, tmp_path)
    rows = topology.section_rows(corpus["sections"], corpus["points"], corpus["curves"])
    control = rows.withColumn("control", F.lit(None).cast("array<struct<u: double, v: double>>"))
    tried = cut(A.attempts(control, 4, seed=2, edits=["scale"]).where("reason = 'ok'"))
    names = [r.variant_id for r in tried.orderBy("counter").collect()]
    assert len(names) == 4
    t = {k: cut(df) for k, df in variants.tables(tried).items()}
    new = cut(variants.propagated(corpus["targets"], tried, corpus["graph"], t))
    web, of = F.col("region_name") == "web_1", lambda k: F.col("section_id") == names[k]
    changed = new.withColumns({c: F.when(web & of(1), variants._none()).otherwise(F.col(c)) for c in ("curve_names", "point_names")})
    changed = changed.unionByName(new.where(web & of(2)).withColumns({"label_id": F.lit("dfc.x.notch"), "ord": F.lit(77)}))
    changed = changed.withColumn("curve_names", F.when(web & of(3), F.array(F.lit("none"))).otherwise(F.col("curve_names")))
    got = {r.variant_id: r.reason for r in variants.judged(tried, corpus["targets"], changed, corpus["regions"], t).collect()}
    assert [got[n] for n in names] == ["ok", "gate2_empty", "gate3_cooccurrence", "gate4_affine"]


def test_copies_of_sources_fail(spark):
    """A mirror of a symmetric section is its source, not a new variant."""
    df = rows_of(spark, square=6.0)
    mirrored = A.fingerprint(A.transformed(sketch("square", 6.0), np.array(A.MATRIX["mirror_u"], float)))
    tried = spark.createDataFrame([("square", 0, "square@aug000", "ok", mirrored)], "section_id string, counter int, variant_id string, reason string, fingerprint string")
    got = A.settled(tried, A.source_fingerprints(df))
    assert got.columns == tried.columns and [r.reason for r in got.collect()] == ["gate5_duplicate"]
    assert [r.reason for r in A.settled(tried).collect()] == ["ok"]

