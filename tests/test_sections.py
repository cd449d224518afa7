"""From macro text to answers, on drawings that can be worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from spanwise.functions import geometry as G
from spanwise.operators import evaluate, features, labels, mapper, models, silver, topology
from spanwise.sources import sections as src
from tests.fixtures import FIXTURES, macro, square


@pytest.fixture(scope="module")
def tables(spark):
    texts = spark.createDataFrame([(n, macro(n, *f)) for n, f in FIXTURES.items()], "section_id string, text string")
    sections, points, curves = src.localised(*src.macro_tables(texts))
    graph = topology.graph(sections, points, curves).persist()
    t = {"sections": sections.persist(), "points": points.persist(), "curves": curves.persist(), "graph": graph}
    t["curve_features"] = features.curve_features(**t).persist()
    t["face_features"] = features.face_features(sections, points, graph).persist()
    return t


def test_frames_and_planes(spark):
    texts = spark.createDataFrame([(p, macro("s", *square(), plane=p)) for p in ("YZ", "XZ", "XY")], "section_id string, text string")
    sections, points, _ = src.localised(*src.macro_tables(texts))
    assert {(r.section_id, r.plane, r.width, r.height) for r in sections.collect()} == {(p, p, 10.0, 10.0) for p in ("YZ", "XZ", "XY")}
    at = {(r.section_id, r.name): (r.u, r.v) for r in points.collect()}
    assert all(at[p, "P2"] == (10.0, 0.0) and at[p, "P3"] == (10.0, 10.0) for p in ("YZ", "XZ", "XY"))


def test_duplicate_variable_origin_and_unknown_ends(spark):
    text = macro("s", *square()) + 'P2 = theModel.createSecNode( x = 0, y = 12, z = 0, theSect = S_1)\nO = theModel.createSecNode( x = 0, y = 0, z = 0, theSect = S_1)\nBAD = theModel.createSecCurve( start = P1, end = NONE, theSect = S_1)\n'
    sections, points, curves = src.localised(*src.macro_tables(spark.createDataFrame([("s", text)], "section_id string, text string")))
    assert sections.first().width == 12.0
    assert {r.name for r in points.collect()} == {"P1", "P2", "P3", "P4"} and curves.count() == 4


def test_xml(spark):
    def p(i, name, u, v, kind="2"):
        return f"<Point><ID>{i}</ID><Name>{name}</Name><Type>{kind}</Type><sectionName>S</sectionName><gCoord><item>0</item><item>{u}</item><item>{v}</item></gCoord></Point>"

    def c(name, a, b, extra=""):
        return f"<Curve><Name>{name}</Name><sectionName>S</sectionName><startPointName>{a}</startPointName><endPointName>{b}</endPointName>{extra}</Curve>"

    bend = "".join(f"<controlPoint_{k}_gCoord><X>0</X><Y>{u}</Y><Z>{v}</Z></controlPoint_{k}_gCoord>" for k, u, v in ((1, 10, 5.5), (2, 5.5, 10)))
    text = "<r>" + p(1, "A", 0, 0) + p(2, "B", 10, 0) + p(3, "C", 0, 10) + p(4, "S", 0, 0) + p(5, "O", 0, 0, "3") + c("L1", "A", "B") + c("L2", "B", "C", bend) + c("L3", "C", "A") + "</r>"
    _, points, curves = src.localised(*src.xml_tables(spark.createDataFrame([("s", text)], "section_id string, text string")))
    assert {r.name for r in points.collect()} == {"A", "B", "C"}
    arc = curves.where("name = 'L2'").first()
    assert len(arc.polyline) == 9 and 14.2 < arc.length < 10 * math.pi / 2 + 0.1


def test_expressions(spark):
    sq = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    df = spark.createDataFrame([([{"u": u, "v": v} for u, v in sq],)], "p array<struct<u: double, v: double>>")
    r = df.select(G.signed_area("p").alias("a"), G.centroid("p").alias("c"), G.polyline_length("p").alias("l"), G.in_polygon(F.lit(5.0), F.lit(5.0), "p").alias("i"), G.in_polygon(F.lit(15.0), F.lit(5.0), "p").alias("o"), G.distance_to_boundary(F.lit(5.0), F.lit(4.0), "p").alias("d"), F.size(G.resampled("p", F.lit(30.0))).alias("n")).first()
    assert (r.a, r.c.u, r.c.v, r.l, r.i, r.o, r.d, r.n) == (100.0, 5.0, 5.0, 30.0, True, False, 4.0, 33)


def test_endpoint_topology(tables):
    got = {r.section_id: r for r in topology.endpoint_topology(tables["curves"].withColumn("valid", F.lit(True))).collect()}
    assert {k: v["class"] for k, v in got.items()} == {"square": "closed", "ladder": "branched", "t_rung": "open", "gap_rung": "branched", "flange": "branched", "chain": "open", "branch": "branched"}
    assert got["square"].signature == "closed:d2-d2:c1" and got["t_rung"].n_components == 3


def test_features(tables):
    got = {(r.section_id, r.name): r for r in tables["curve_features"].collect()}
    rung = got["ladder", "R1"]
    assert (rung.separates_cells, rung.on_outer, rung.is_horizontal, rung.section_closed, rung.run_len_over_longdim) == (1.0, 0.0, 1.0, 1.0, 40 / 120)
    assert got["flange", "FL"].dangling == 1.0 and got["flange", "FL"].run_has_tip_endpoint == 1.0
    assert len(tables["curve_features"].columns) == 3 + 33 and len(tables["face_features"].columns) == 3 + 13
    ranks = sorted(r.v_rank for r in tables["face_features"].where("section_id = 'ladder'").collect())
    assert ranks == [0.0, 0.5, 1.0]


def test_resolve(spark):
    cases = {
        "dfc.substructure.notch": ("dfc.substructure.notch", "exact_label_id", None, None, None), "chamber_2": ("dfc.substructure.chamber", "region_name", 2, None, None), "stiffener_a": ("dfc.substructure.internal_web", "region_name", 1, None, None),
        "中间两道加强筋": ("dfc.substructure.internal_web", "exact_alias", None, 2, "center"), "第二个腔": ("dfc.substructure.chamber", "exact_alias", 2, None, None), "flanges": ("dfc.substructure.flange", "region_name", None, None, None),
        "outlin": ("dfc.substructure.outer_contour", "fuzzy_alias", None, None, None), "xyz": (None, None, None, None, None), "chamber_2腔": ("dfc.substructure.chamber", "region_name", None, None, None),
    }
    got = {r.text: r for r in labels.resolve(spark.createDataFrame([(t,) for t in cases], "text string")).collect()}
    for text, want in cases.items():
        r = got[text]
        assert (r.label_id, r.evidence, r.ordinal, r["count"], r.position) == want, text
    assert labels.resolve(spark.createDataFrame([("第二个腔",)], "text string"), compat=True).first()["count"] == 2


def test_answers(spark, tables):
    asked = [("q1", "ladder", "加强筋"), ("q2", "ladder", "chamber_2"), ("q3", "ladder", "chamber_9"), ("q4", "nowhere", "腔"), ("q5", "chain", "腔"), ("q6", "ladder", "上面的腔"), ("q7", "ladder", "zzz")]
    q = spark.createDataFrame(asked, "query_id string, section_id string, text string")
    got = {r.query_id: r for r in mapper.map_queries(q, bank=models.Bank(mode="rules"), **tables).collect()}
    assert {t.name for t in got["q1"].targets} == {"R1", "R2"} and got["q1"].decision == "resolved"
    assert [t.name for t in got["q2"].targets] == ["cell_2"]
    assert got["q3"].decision == "not_found" and "ordinal_out_of_range:9>3" in got["q3"].evidence
    assert [got[k].decision for k in ("q4", "q5", "q7")] == ["unsupported"] * 3
    assert [t.name for t in got["q6"].targets] == ["cell_1"]


def test_silver_and_training(spark, tables):
    box = lambda x, y, w, h: {"x": str(x), "y": str(y), "width": str(w), "height": str(h)}
    rows = [(s, 0, "chamber_1", "enclosed", None, box(0, 80, 40, 40)) for s in ("ladder", "t_rung")] + [(s, 1, "chamber_2", "enclosed", None, box(0, 40, 40, 40)) for s in ("ladder", "t_rung")]
    rows += [(s, 2, "stiffener_a", "stiffener", None, box(-1, 79, 42, 2)) for s in ("ladder", "t_rung")] + [("flange", 0, "flange_a", None, None, box(10, 9, 7, 2)), ("square", 0, None, "enclosed", None, {"x": "0"})]
    regions = spark.createDataFrame(rows, "section_id string, ord int, name string, function string, notes string, bbox map<string, string>")
    got = silver.silver(tables["sections"], tables["points"], tables["curves"], tables["graph"], regions).persist()
    by = {(r.section_id, r.region_name): r for r in got.collect()}
    assert by["ladder", "chamber_1"].face_ids == ["cell_1"] and by["ladder", "chamber_2"].face_ids == ["cell_2"]
    assert by["ladder", "stiffener_a"].curve_names == ["R2"] and by["ladder", "stiffener_a"].ordinal == 1
    assert "empty_target" in by["square", "region_0"].flags
    assert by["square", "outer_contour"].curve_names == ["L1", "L2", "L3", "L4"]
    meta = tables["sections"].select("section_id", F.col("section_id").alias("family"))
    made = silver.samples(got, meta).persist()
    assert {r.kind for r in made.where("section_id = 'ladder' and label_id like '%chamber'").collect()} == {"generic", "specific"}
    bank = models.train(tables["curve_features"], tables["face_features"], made)
    assert "internal_web" in bank.curves and bank.face is not None
    score = {(r.section_id, r.name): r.s for r in tables["curve_features"].select("section_id", "name", bank.curve_score("internal_web").alias("s")).collect()}
    assert score["ladder", "R2"] > 0.5 > score["ladder", "L1"]
    folds = evaluate.leave_one_family_out(made, tables, meta.where("section_id in ('ladder', 't_rung', 'square')")).collect()
    assert {r.scorer for r in folds} == set(evaluate.SCORERS) and {r.section_id for r in folds} == {"ladder", "t_rung", "square"}


def test_model_round_trip(spark, tmp_path):
    """Written and read by Spark, so a bank can lie in any store."""
    bank = models.Bank({"notch": models.Logistic(["a"], [1.0], [2.0], [0.5, -1.0], 3, 4)}, None)
    bank.save(str(tmp_path / "model.json"))
    again = models.Bank.load(str(tmp_path / "model.json"), "hybrid")
    assert again.curves == bank.curves and again.face is None and again.mode == "hybrid"


def test_registry_file(spark, tmp_path):
    """Labels, position and ordinal words of a file; what it lacks is the default's."""
    (tmp_path / "labels.yaml").write_text("""
labels:
- {label_id: x.hole, caption_zh: hole, entity_type: face, functions: [enclosed], name_patterns: [hole], aliases: [hole, opening]}
position_words: {left: [port], top: [upper]}
ordinal_words: {2: [second, 2nd], 1: [first]}
""")
    registry = labels.Registry.read(spark, str(tmp_path / "labels.yaml"))
    asked = ["the second opening", "port hole", "upper port hole", "first hole on the left"]
    got = {r.text: r for r in labels.resolve(spark.createDataFrame([(t,) for t in asked], "text string"), registry).collect()}
    assert [(got[t].label_id, got[t].ordinal, got[t].position) for t in asked] == [("x.hole", 2, None), ("x.hole", None, "left"), ("x.hole", None, "top"), ("x.hole", 1, None)]
    plain = labels.Registry.from_yaml("labels: []")
    assert plain.positions == labels.Registry().positions and plain.ordinals == labels.Registry().ordinals
