"""The extractor's view of macros and XML, its diagnostics and sinks."""

import json
import math

import pytest
from pyspark.sql import functions as F

from spanwise.sources import edges as E
from tests.fixtures import FIXTURES, macro, square

TEXTS = "section_id string, text string, path string, sha256 string"


def texts(spark, **files):
    return spark.createDataFrame([(k, v, f"/in/{k}/{k}", "0" * 64) for k, v in files.items()], TEXTS)


def test_macro_records(spark):
    text = macro("s", *square()) + 'theModel.createSecNode(x = 3, y = 1, z = 2, theSect = S_1)\ntheModel.createSecCurve(start = P1, end = NONE, theSect = S_1)\n'
    got = {k: v.collect() for k, v in E.extract(texts(spark, box=text), False).items()}
    assert {r.name: (r.s.x, r.s.y, r.s.z) for r in got["points"]}["point_5"] == (3.0, 1.0, 2.0)
    lines = {r.name: r for r in got["curves"]}
    assert lines["L1"].length == 10 and lines["L1"].length_method == "endpoint_distance" and lines["L1"].bbox_method == "endpoints"
    assert (lines["L2"].orientation.vector, lines["L2"].orientation.angle_deg) == ([0.0, 0.0, 10.0], 90.0)
    assert lines["curve_5"].topology_signature == "missing_endpoint" and lines["curve_5"].length is None and lines["L1"].topology_signature == "closed:d2-d2:c1"
    assert [(r.code, r.what) for r in got["diagnostics"]] == [("missing_or_ambiguous_endpoint", "curve_5")]
    t = got["topology"][0]
    assert (t.valid_curve_count, t.complete, t.component_count, t.classification) == (4, False, 1, "closed")


def point(i, name, y, z, kind="2", section="A", form="item"):
    at = "".join(f"<item>{x}</item>" for x in (0, y, z)) if form == "item" else "".join(f"<{a}>{x}</{a}>" for a, x in zip("XYZ", (0, y, z), strict=True))
    kind = f"<Type>{kind}</Type>" if kind else ""
    section = f"<sectionName>{section}</sectionName>" if section else ""
    return f"<Point><ID>{i}</ID><Name>{name}</Name>{kind}{section}<sCoord>{at}</sCoord></Point>"


def curve(i, name, a, b, extra="", section="A"):
    return f"<Curve><ID>{i}</ID><Name>{name}</Name><sectionName>{section}</sectionName><startPointName>{a}</startPointName><endPointName>{b}</endPointName>{extra}</Curve>"


def test_xml_records(spark):
    bend = "".join(f"<controlPoint_{k}_sCoord><X>0</X><Y>{y}</Y><Z>{z}</Z></controlPoint_{k}_sCoord>" for k, y, z in ((1, 10, 5.5228), (2, 5.5228, 10)))
    xml = (
        "<r><Section><ID>7</ID><Name>A</Name><CoordSysID>c</CoordSysID></Section><Section><Name>B</Name></Section>"
        "<SurfaceGroups><SurfaceGroup><Name>skin</Name><SectionName><item>A</item></SectionName></SurfaceGroup></SurfaceGroups>"
        + point(1, "P", 0, 0) + point(2, "Q", 10, 0, "") + point(3, "R", 0, 10, form="axes") + point(9, "O", 0, 0, "3") + point(4, "D", 1, 1) + point(4, "D", 2, 2)
        + point(5, "B_SP_1", 0, 0, section="") + point(6, "X_SP_1", 5, 5, section="")
        + curve(1, "L1", "P", "Q") + curve(2, "L2", "Q", "R", bend) + curve(2, "L3", "R", "D") + curve(4, "L4", "?", "?").replace("</Curve>", "<startPointID>1</startPointID><endPointID>3</endPointID></Curve>") + "</r>"
    )
    t = E.extract(texts(spark, two=xml), True)
    got = {k: v.collect() for k, v in t.items()}
    assert {(r.id, r.section, tuple(r.surface_groups)) for r in got["sections"]} == {("7", "A", ("skin",)), ("B", "B", ())}
    assert {(r.name, r.section) for r in got["points"]} == {("P", "A"), ("Q", "A"), ("R", "A"), ("D", "A"), ("B_SP_1", "B"), ("X_SP_1", "A")}
    lines = {r.name: r for r in got["curves"]}
    assert lines["L2"].length == pytest.approx(5 * math.pi, rel=1e-3) and lines["L2"].length_method == "bezier_sample_24" and lines["L2"].bbox.max_y == 10
    assert lines["L3"].end is None and (lines["L4"].start.name, lines["L4"].end.name) == ("P", "R")
    assert {(r.code, r.what, r.n) for r in got["diagnostics"]} == {("duplicate_point_id", "4", 2), ("duplicate_point_name", "D", 2), ("duplicate_curve_id", "2", 2), ("missing_or_ambiguous_endpoint", "L3", 1)}
    assert lines["L1"].topology_signature == "closed:d2-d2:c1"


def test_components_are_numbered_in_order(spark):
    two = ({"A": (0, 0), "B": (5, 0), "C": (9, 9), "D": (9, 12)}, [("L1", "C", "D"), ("L2", "A", "B")])
    got = {r.name: r.component_id for r in E.extract(texts(spark, s=macro("s", *two)), False)["curves"].collect()}
    assert got == {"L1": 1, "L2": 2}


def test_candidates_and_files(spark, tmp_path):
    folder = tmp_path / "in" / "lad"
    folder.mkdir(parents=True)
    (folder / "lad.py").write_text(macro("lad", *FIXTURES["ladder"]))
    (folder / "lad.yaml").write_text("id: lad\nregions:\n- {name: top, bbox: {x: 0, y: 90, width: 40, height: 30}}\n- {name: notch, bbox: {x: 0, y: 39, depth: 5, width: 2}}\n- {name: none}\n")
    t = E.write(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {r.region: r.curve_ids for r in t["candidates"].collect()} == {"top": ["L6", "L3", "L4"], "notch": ["L7", "L8", "R1"]}
    record, edge_map, manifest = (json.loads(spark.read.text(f"{tmp_path}/out/{n}s").first().value) for n in ("record", "edge_map", "manifest"))
    assert record["sections"][0]["topology"]["classification"] == "branched" and len(record["sections"][0]["curves"]) == 10
    assert edge_map["edge_map"][0]["regions"][0]["method"] == "bbox_candidates_not_gold"
    assert manifest["sections"] == ["lad"] and len(manifest["source"]["sha256"]) == 64


def test_empty(spark):
    assert all(df.count() == 0 for df in E.extract(texts(spark, a="").limit(0), True).values())
    assert E.extract(texts(spark, a="no calls"), False)["curves"].where(F.lit(True)).count() == 0
