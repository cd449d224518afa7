"""Edge records of sections in three dimensions, with diagnostics: the extractor's view, which mends nothing.

Unlike ``sections``, it keeps every section of a file, takes points of type 2 or of no type, looks axes up before items, keeps
duplicates and reports them, measures Béziers at 24 segments, and boxes the (y, z) plane whatever plane the section lies in.
All tables carry ``file``, the folder of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwise.functions.scalar import number
from spanwise.operators.relational import class_of, cut, degrees, duplicates, graph_components
from spanwise.operators.topology import resolve_ends
from spanwise.sources.sections import argument, elements, read_texts, statements, vector

VERSION, SEGMENTS = "1.0", 24
XYZ = "struct<x: double, y: double, z: double>"
_VEC = "struct<item: array<string>, X: string, Y: string, Z: string>"
_POINT = f"ID string, Name string, Type string, sectionName string, gCoord {_VEC}, sCoord {_VEC}"
_CURVE = (
    "ID string, Name string, Type string, sectionName string, startPointID string, startPointName string, endPointID string, endPointName string, "
    + ", ".join(f"controlPoint_{k}_{f}Coord {_VEC}" for k in (1, 2) for f in "gs")
)
_GROUP = "Name string, SectionName struct<item: array<string>>"


def macro_records(texts: DataFrame) -> dict[str, DataFrame]:
    """sections, points and curves of macro texts. One section a file, named after it; nameless points and curves get their number."""
    calls = statements(texts)
    sections = texts.select(F.col("section_id").alias("file"), F.lit(0).alias("ord"), F.col("section_id").alias("id"), F.col("section_id").alias("section"), F.lit(None).cast("string").alias("coord_sys_id"), F.array().cast("array<string>").alias("surface_groups"))

    def named(call: str, stem: str) -> DataFrame:
        rows = calls.where(F.col("call") == call)
        k = F.row_number().over(Window.partitionBy("section_id").orderBy("ord"))
        return rows.withColumn("name", F.coalesce("var", F.concat(F.lit(stem), k.cast("string"))))

    points = named("createSecNode", "point_").select("section_id", "name", "ord", F.struct(*(number(argument(c)).alias(c) for c in "xyz")).alias("s")).where("s.x is not null and s.y is not null and s.z is not null")
    last = points.groupBy("section_id", "name").agg(F.min("ord").alias("ord"), F.max_by("s", "ord").alias("s"))
    points = last.select(F.col("section_id").alias("file"), F.col("section_id").alias("section"), "ord", F.col("name").alias("id"), "name", F.col("s").alias("g"), "s")
    curves = named("createSecCurve", "curve_").select(
        F.col("section_id").alias("file"), F.col("section_id").alias("section"), "ord", F.col("name").alias("id"), "name", F.lit(None).cast("string").alias("type_raw"), argument("start").alias("start_name"), F.lit(None).cast("string").alias("start_id"),
        argument("end").alias("end_name"), F.lit(None).cast("string").alias("end_id"), F.array().cast(f"array<{XYZ}>").alias("controls"),
    ).where("start_name is not null and end_name is not null")
    return {"sections": sections, "points": points, "curves": curves}


def xml_records(texts: DataFrame) -> dict[str, DataFrame]:
    """sections, points and curves of XML texts. A point or curve without a known section goes to the one its name begins with, else to the first."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    sec = elements(texts, "Section", "ID string, Name string, CoordSysID string").select("section_id", "ord", blank(F.col("e.Name")).alias("name"), blank(F.col("e.ID")).alias("id"), "e.CoordSysID")
    sec = sec.select(F.col("section_id").alias("file"), "ord", F.coalesce("id", "name", F.lit("section")).alias("id"), F.coalesce("name", F.lit("section")).alias("section"), F.col("CoordSysID").alias("coord_sys_id"))
    bare = texts.select(F.col("section_id").alias("file")).join(sec, "file", "left_anti")
    sec = sec.unionByName(bare.select("file", F.lit(0).alias("ord"), F.lit("section-1").alias("id"), F.lit("section-1").alias("section"), F.lit(None).cast("string").alias("coord_sys_id")))
    group = elements(texts, "SurfaceGroup", _GROUP).where("e.Name <> ''").select(F.col("section_id").alias("file"), "ord", F.col("e.Name").alias("g"), F.explode("e.SectionName.item").alias("section"))
    group = group.groupBy("file", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "g"))), lambda x: x["g"]).alias("surface_groups"))
    sections = cut(sec.join(group, ["file", "section"], "left").withColumn("surface_groups", F.coalesce("surface_groups", F.array().cast("array<string>"))))
    first = sections.groupBy("file").agg(F.min_by("section", "ord").alias("first"))
    known = sections.select("file", F.col("section").alias("wanted"), F.lit(True).alias("is_known")).distinct()

    def placed(rows: DataFrame, mark: str) -> DataFrame:
        prefix = F.when(F.contains("name", F.lit(mark)), F.substring_index("name", mark, 1))
        rows = rows.withColumn("wanted", F.coalesce(blank(F.col("sectionName")), prefix)).join(first, "file").join(known, ["file", "wanted"], "left")
        return rows.withColumn("section", F.when(F.col("is_known"), F.col("wanted")).otherwise(F.col("first")))

    p = elements(texts, "Point", _POINT).select(F.col("section_id").alias("file"), "ord", "e.*").withColumn("name", blank(F.col("Name"))).where("name is not null and coalesce(nullif(trim(Type), ''), '2') = '2'")
    points = placed(p, "_SP_").select("file", "section", "ord", F.coalesce(blank(F.col("ID")), "name").alias("id"), "name", vector("gCoord", False).alias("g"), vector("sCoord", False).alias("s"))
    c = elements(texts, "Curve", _CURVE).select(F.col("section_id").alias("file"), "ord", "e.*").withColumn("name", F.coalesce(blank(F.col("Name")), F.lit("curve")))
    control = [F.coalesce(vector(f"controlPoint_{k}_sCoord", False), vector(f"controlPoint_{k}_gCoord", False)) for k in (1, 2)]
    curves = placed(c, "_SL_").select(
        "file", "section", "ord", F.coalesce(blank(F.col("ID")), "name").alias("id"), "name", F.col("Type").alias("type_raw"), blank(F.col("startPointName")).alias("start_name"), blank(F.col("startPointID")).alias("start_id"),
        blank(F.col("endPointName")).alias("end_name"), blank(F.col("endPointID")).alias("end_id"), F.filter(F.array(*control), lambda x: x.isNotNull()).alias("controls"),
    )
    return {"sections": sections, "points": points, "curves": curves}


def resolved(points: DataFrame, curves: DataFrame) -> DataFrame:
    """curves with start and end, the structs (id, name, g, s) of their points; null where a name or id has no or several points in the section."""
    key = ["file", "section"]
    both = lambda df: df.withColumn("section_id", F.concat_ws("\u0001", *key))
    at = both(points).select("section_id", "name", "id", F.struct("id", "name", "g", "s").alias("key"))
    # min over structs needs an order, which they have; several matches give null anyway.
    return resolve_ends(both(curves), at).drop("section_id")


def _box(points: Column) -> Column:
    """min and max of (y, z), width and height of a list of places; null for none."""
    least, most = (lambda c, f=f: f(F.transform(points, lambda p: p[c])) for f in (F.array_min, F.array_max))
    box = F.struct(least("y").alias("min_y"), least("z").alias("min_z"), most("y").alias("max_y"), most("z").alias("max_z"), (most("y") - least("y")).alias("width"), (most("z") - least("z")).alias("height"))
    return F.when(F.size(points) > 0, box)


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((b[c] - a[c]) * (b[c] - a[c]) for c in "xyz"), F.lit(0.0)))


def _bezier_length(p: Column, n: int = SEGMENTS) -> Column:
    """Length of a cubic with control points p, sampled at n segments."""

    def at(i: Column, c: str) -> Column:
        t = i / n
        return (1 - t) * (1 - t) * (1 - t) * p[0][c] + 3 * (1 - t) * (1 - t) * t * p[1][c] + 3 * (1 - t) * t * t * p[2][c] + t * t * t * p[3][c]

    place = lambda i: F.struct(*(at(i, c).alias(c) for c in "xyz"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0.0), lambda s, i: s + _apart(place(i - 1), place(i)))


def measured(curves: DataFrame) -> DataFrame:
    """Resolved curves with type, bbox, length and orientation, each with the way it was found."""
    path = F.filter(F.concat(F.array(F.col("start.s")), "controls", F.array(F.col("end.s"))), lambda p: p.isNotNull())
    ends = F.col("start.s").isNotNull() & F.col("end.s").isNotNull()
    bent = F.size("controls") == 2
    a, b = F.col("start.s"), F.col("end.s")
    vector_ = F.array(*(b[c] - a[c] for c in "xyz"))
    return curves.withColumn("path", path).withColumns({
        "type": F.when(F.size("controls") > 0, "bezier").otherwise("line"),
        "bbox": _box(F.col("path")), "bbox_method": F.when(F.size("controls") > 0, "control_hull").otherwise("endpoints"),
        "length": F.when(ends & bent, _bezier_length(F.col("path"))).when(ends, _apart(a, b)),
        "length_method": F.when(ends & bent, f"bezier_sample_{SEGMENTS}").when(ends, "endpoint_distance"),
        "orientation": F.when(ends, F.struct(vector_.alias("vector"), F.degrees(F.atan2(b["z"] - a["z"], b["y"] - a["y"])).alias("angle_deg"))),
    }).drop("path")


def connected(curves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, curves with valid, component_id, degrees and signature). Components are numbered from 1 in the order in which curves come to them."""
    key = ["file", "section"]
    ends = curves.where("valid").select(*key, "ord", F.col("start.name").alias("a"), F.col("end.name").alias("b"))
    ends = cut(ends)
    degree = degrees(ends, "a", "b", key)
    comp = graph_components(ends, "a", "b", key)
    seen = ends.join(comp.withColumnRenamed("node", "a"), [*key, "a"]).groupBy(*key, "component").agg(F.min("ord").alias("o"))
    number_ = seen.withColumn("component_id", F.row_number().over(Window.partitionBy(*key).orderBy("o"))).select(*key, "component", "component_id")
    nodes = degree.join(comp, [*key, "node"]).join(number_, [*key, "component"]).select(*key, F.col("node").alias("point"), "degree", "role", "component_id")
    count = lambda role: F.sum((F.col("role") == role).cast("long"))
    sums = nodes.groupBy(*key).agg(count("branch").alias("branch_count"), count("endpoint").alias("endpoint_count"), F.max("component_id").cast("long").alias("component_count"))
    sizes = curves.groupBy(*key).agg(F.sum(F.col("valid").cast("long")).alias("valid_curve_count"), F.count("*").alias("n_curves"))
    topo = sizes.join(sums, key, "left").na.fill(0)
    topo = topo.withColumn("classification", class_of(F.col("branch_count"), F.col("endpoint_count"), F.col("valid_curve_count"))).withColumn("complete", F.col("valid_curve_count") == F.col("n_curves"))
    at = lambda n: nodes.select(*key, F.col("point").alias(f"_{n}"), F.col("degree").alias(f"{n}_degree"), *([F.col("component_id")] if n == "start" else []))
    out = curves.withColumns({"_start": F.when(F.col("valid"), F.col("start.name")), "_end": F.when(F.col("valid"), F.col("end.name"))})
    out = out.join(at("start"), [*key, "_start"], "left").join(at("end"), [*key, "_end"], "left").join(topo.select(*key, "classification"), key, "left")
    sign = F.when(F.col("valid"), F.format_string("%s:d%d-d%d:c%d", "classification", "start_degree", "end_degree", "component_id")).otherwise("missing_endpoint")
    return topo, out.withColumn("topology_signature", sign).drop("_start", "_end", "classification")


def diagnostics(points: DataFrame, curves: DataFrame) -> DataFrame:
    """(file, code, what, n): points and curves that share an id or a name, and curves without a clear end."""
    same = lambda df, key, code: duplicates(df, ["file", key], "name").select("file", F.lit(code).alias("code"), F.col(key).alias("what"), F.col("n_rows").alias("n"))
    lost = curves.where("not valid").select("file", F.lit("missing_or_ambiguous_endpoint").alias("code"), F.col("name").alias("what"), F.lit(1).cast("long").alias("n"))
    return same(points, "id", "duplicate_point_id").unionByName(same(points, "name", "duplicate_point_name")).unionByName(same(curves, "id", "duplicate_curve_id")).unionByName(lost)


def candidates(points: DataFrame, curves: DataFrame, regions: DataFrame) -> DataFrame:
    """(file, section, region, curve_ids): curves whose box meets an annotation box, counted from the section's least corner; candidates, not labels. regions (section_id, ord, name, bbox)."""
    num = lambda k: F.trim(F.col("bbox")[k]).try_cast("double")
    notch = num("depth").isNotNull() & num("height").isNull()
    w, h = F.when(notch, num("depth")).otherwise(num("width")), F.when(notch, num("width")).otherwise(num("height"))
    box = regions.select(F.col("section_id").alias("file"), "ord", F.col("name").alias("region"), num("x").alias("x0"), num("y").alias("y0"), (num("x") + w).alias("x1"), (num("y") + h).alias("y1")).where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    origin = points.where("s is not null").groupBy("file", "section").agg(F.min("s.y").alias("oy"), F.min("s.z").alias("oz"))
    line = curves.where("bbox is not null").join(origin, ["file", "section"]).select("file", "section", F.col("ord").alias("c_ord"), "id", *((F.col(f"bbox.{e}_{c}") - F.col(f"o{c}")).alias(f"{e}_{c}") for e in ("min", "max") for c in "yz"))
    meet = (F.col("max_y") >= F.col("x0")) & (F.col("min_y") <= F.col("x1")) & (F.col("max_z") >= F.col("y0")) & (F.col("min_z") <= F.col("y1"))
    all_ = box.join(origin.select("file", "section"), "file")
    hit = all_.join(line, ["file", "section"]).where(meet).groupBy("file", "section", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_ord", "id"))), lambda x: x["id"]).alias("curve_ids"))
    return all_.join(hit, ["file", "section", "ord"], "left").select("file", "section", "ord", "region", F.coalesce("curve_ids", F.array().cast("array<string>")).alias("curve_ids"))


def extract(texts: DataFrame, xml: bool, regions: DataFrame | None = None) -> dict[str, DataFrame]:
    """sections, points, curves, topology, diagnostics and, with regions, candidates of source texts (section_id, text)."""
    got = xml_records(texts) if xml else macro_records(texts)
    points = cut(got["points"])
    topo, curves = connected(cut(measured(resolved(points, got["curves"]))))
    curves = cut(curves)
    out = {"sections": got["sections"], "points": points, "curves": curves, "topology": topo, "diagnostics": diagnostics(points, curves)}
    return out if regions is None else {**out, "candidates": candidates(points, curves, regions)}


def documents(tables: dict[str, DataFrame], texts: DataFrame) -> DataFrame:
    """(file, record, edge_map, manifest): the three JSON texts of each source file."""
    key = ["file", "section"]
    lists = lambda df, name, by, *cols: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*cols).alias("x")))), lambda r: r["x"]).alias(name))
    curve = ["id", "name", "type_raw", "type", "start", "end", "controls", "bbox", "bbox_method", "length", "length_method", "orientation", F.col("valid").alias("endpoint_valid"), F.struct("component_id", "start_degree", "end_degree").alias("connectivity"), "topology_signature"]
    box = tables["points"].where("s is not null").groupBy(*key).agg(_box(F.collect_list("s")).alias("bbox"))
    topo = tables["topology"].select(*key, F.struct("valid_curve_count", "complete", "component_count", "branch_count", "endpoint_count", "classification").alias("topology"))
    per = tables["sections"].join(lists(tables["points"], "points", key, "id", "name", "g", "s"), key, "left").join(lists(tables["curves"], "curves", key, *curve), key, "left").join(box, key, "left").join(topo, key, "left")
    maps = None
    if "candidates" in tables:
        found = lists(tables["candidates"], "regions", key, F.col("region").alias("region_id"), "curve_ids", F.lit("bbox_candidates_not_gold").alias("method"))
        per = per.join(found, key, "left")
        maps = lists(per, "edge_map", ["file"], F.col("id").alias("section_id"), "section", "regions")
    per = per.withColumnRenamed("section", "name").withColumn("section", F.col("name"))
    found = lists(per, "sections", ["file"], *[c for c in per.columns if c not in ("file", "section", "ord")])
    notes = tables["diagnostics"].groupBy("file").agg(F.array_sort(F.collect_list(F.struct("code", "what", "n"))).alias("diagnostics"))
    source = texts.select(F.col("section_id").alias("file"), F.struct(F.col("path").alias("file"), "sha256").alias("source"))
    out = source.join(found, "file").join(notes, "file", "left")
    out = out.join(maps, "file", "left") if maps is not None else out.withColumn("edge_map", F.lit(None).cast("array<string>"))
    names = F.transform("sections", lambda s: s["name"])
    version = F.lit(VERSION).alias("schema_version")
    return out.select("file", F.to_json(F.struct(version, "source", "sections", "edge_map", "diagnostics")).alias("record"), F.to_json(F.struct("edge_map")).alias("edge_map"), F.to_json(F.struct(version, "source", names.alias("sections"), F.lit(False).alias("gold"))).alias("manifest"))


def write(spark: SparkSession, path: str, out: str) -> dict[str, DataFrame]:
    """Extract all sources below a folder, a folder's XML before its macro, and write records, edge maps and manifests as lines of JSON."""
    from spanwise.sources.files import read_annotations

    _, regions = read_annotations(spark, path)
    xml, py = cut(read_texts(spark, path, ".xml")), cut(read_texts(spark, path, ".py"))
    got = [(t, extract(t, is_xml, regions)) for t, is_xml in ((xml, True), (py.join(xml.select("section_id"), "section_id", "left_anti"), False))]
    lines = [documents(tables, texts) for texts, tables in got]
    both = cut(lines[0].unionByName(lines[1]))
    for name in ("record", "edge_map", "manifest"):
        both.select(F.col(name).alias("value")).write.mode("overwrite").text(f"{out}/{name}s")
    return {name: got[0][1][name].unionByName(got[1][1][name], allowMissingColumns=True) for name in got[0][1]}
