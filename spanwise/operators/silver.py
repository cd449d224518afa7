"""Weak labels: annotation boxes to curves, faces and points, and the query samples made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.geometry import inside_fraction, polygon_box_iou, resampled
from spanwise.functions.scalar import ordinal_suffix
from spanwise.operators.labels import Registry
from spanwise.operators.relational import cut
from spanwise.operators.topology import part

#: Shares of a curve that must lie in a box, by function; limits of matches.
STRIPS = {"cavity": 0.6, "structural": 0.8, "structural_shape": 0.8, "stiffener": 0.8, "connection": 0.8}
NOTCH_SHARE, TRANSITION_SHARE, LEAST_IOU = 0.7, 0.6, 0.3
MIRROR_GAIN, FOUND_BONUS = 0.25, 0.7


def normalised(regions: DataFrame) -> DataFrame:
    """regions (section_id, ord, name, function, notes, bbox map) with names and functions filled in and the box in typed columns.

    A box is x, y, width, height, or a notch x, y, depth, width with the depth along u and the width along v.
    """
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("region_"), F.col("ord").cast("string")))
    fn = F.coalesce(F.nullif("function", F.lit("")), F.when(F.lower(name).rlike("^(chamfer|fillet)"), "transition").otherwise("unknown"))
    num = lambda k: F.trim(F.col("bbox")[k]).try_cast("double")
    out = regions.withColumns({"name": name, "function": fn, **{k: num(k) for k in ("x", "y", "width", "height", "depth", "radius")}, "position": F.col("bbox")["position"]})
    du, dv = F.coalesce(F.when(F.col("height").isNotNull(), F.col("width")), F.col("depth")), F.coalesce("height", F.when(F.col("depth").isNotNull(), F.col("width")))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & du.isNotNull() & dv.isNotNull()
    at = lambda e: F.when(ok, e)
    return out.withColumns({"x0": at(F.col("x")), "y0": at(F.col("y")), "x1": at(F.col("x") + du), "y1": at(F.col("y") + dv)})


def silver(sections: DataFrame, points: DataFrame, curves: DataFrame, graph: DataFrame, regions: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Targets of all regions, for the annotation frame, as drawn or mirrored in u, that fits a section better, and the outer contour of closed sections.

    Both frames are computed at once (column mirrored); the sums of match scores decide per section.
    """
    registry = registry or Registry()
    regions = normalised(regions).join(sections.select("section_id", F.col("width").alias("W"), F.hypot("width", "height").alias("diag")), "section_id")
    both = regions.withColumn("mirrored", F.explode(F.array(F.lit(False), F.lit(True))))
    flip = F.col("mirrored")
    both = both.withColumns({"_x0": F.when(flip, F.col("W") - F.col("x1")).otherwise(F.col("x0")), "_x1": F.when(flip, F.col("W") - F.col("x0")).otherwise(F.col("x1"))}).drop("x0", "x1").withColumnsRenamed({"_x0": "x0", "_x1": "x1"})
    both = both.withColumn("tol", F.greatest(F.lit(0.8), F.least(F.lit(1.5), 0.008 * F.col("diag"))))
    key = ["section_id", "ord", "mirrored"]
    topo = part(graph, "topo").select("section_id", "name", "transition", "convex", "on_outer", "dangling")
    line = curves.join(topo, ["section_id", "name"]).select("section_id", F.col("name").alias("curve"), F.col("ord").alias("c_ord"), "start", "end", "length", "transition", "convex", "polyline")
    line = line.withColumn("dots", resampled("polyline", F.col("length"))).withColumn("mid", F.col("polyline")[(F.size("polyline") / 2).cast("int")]).drop("polyline")
    # Six branches read both tables.
    both, line, graph = cut(both), cut(line), cut(graph)

    found = [_faces(both, graph, key), _strips(both, line, key), _notches(both, line, key), *_transitions(both, points, line, key)]
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    label = F.coalesce(registry.of_function(F.col("function")), registry.of_name(F.col("name")))
    none = F.array().cast("array<string>")
    rows = both.join(hits, key, "left").withColumns({
        "label_id": F.coalesce(label, F.concat(F.lit("unmapped."), F.col("function"))),
        "entity_type": F.coalesce("hit_type", registry.entity_type(label), F.lit("curve")),
        **{c: F.coalesce(c, none) for c in ("face_ids", "curve_names", "point_names")},
        "match_score": F.coalesce("match_score", F.lit(0.0)), "ordinal": ordinal_suffix(F.lower("name")),
    })
    empty = (F.size("face_ids") == 0) & (F.size("curve_names") == 0) & (F.size("point_names") == 0)
    flags = F.concat(F.when(label.isNull(), F.array(F.lit("unmapped_function"))).otherwise(none), F.coalesce("hit_flags", none), F.when(empty, F.array(F.lit("empty_target"))).otherwise(none))
    rows = cut(rows.withColumns({"flags": flags, "empty": empty}))
    sums = rows.groupBy("section_id", "mirrored").agg((F.sum("match_score") + FOUND_BONUS * F.sum((~F.col("empty")).cast("double"))).alias("s"))
    better = sums.groupBy("section_id").agg((F.max(F.when(F.col("mirrored"), F.col("s"))) > F.max(F.when(~F.col("mirrored"), F.col("s"))) + MIRROR_GAIN).alias("take"))
    rows = rows.join(better, "section_id").where("mirrored = take").withColumn("flags", F.when(F.col("mirrored"), F.array_append("flags", F.lit("annotation_u_mirrored"))).otherwise(F.col("flags")))
    cols = ["section_id", "ord", F.col("name").alias("region_name"), "function", "label_id", "entity_type", "face_ids", "curve_names", "point_names", "ordinal", "flags", "match_score"]
    return rows.select(*cols).unionByName(_contour(sections, line, graph))



def _gathered(hits: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """Curves of each region in their order, with their ends."""
    rows = hits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("c_ord", "curve", "start", "end"))).alias("_c"), F.sum("length").alias("_len"), *more)
    return rows.withColumns({"curve_names": F.transform("_c", lambda x: x["curve"]), "point_names": F.array_distinct(F.flatten(F.transform("_c", lambda x: F.array(x["start"], x["end"]))))}).drop("_c")


def _inside(regions: DataFrame, line: DataFrame, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """regions x curves of the section with the share of the curve in the box: an equi join on the section."""
    share = inside_fraction("dots", F.col(x0), F.col(y0), F.col(x1), F.col(y1), F.col("tol"))
    return regions.join(line, "section_id").withColumn("share", share)


def _full(df: DataFrame, hit_type: Column | None = None, faces: Column | None = None, flags: Column | None = None, score: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select("section_id", "ord", "mirrored", (hit_type if hit_type is not None else F.lit(None).cast("string")).alias("hit_type"), (faces if faces is not None else none).alias("face_ids"), "curve_names", "point_names", (flags if flags is not None else none).alias("hit_flags"), (score if score is not None else F.lit(1.0)).alias("match_score"))


def _faces(regions: DataFrame, graph: DataFrame, key: list[str]) -> DataFrame:
    """The face with the greatest overlap; cells come before sub-cells among equals. A low overlap is flagged, but kept."""
    boxes = regions.where("function = 'enclosed' and x0 is not null")
    face = part(graph, "face").select("section_id", "face_id", F.col("ord").alias("f_ord"), "polygon", F.col("curves").alias("curve_names"), F.col("points").alias("point_names"))
    pairs = boxes.select(*key, "x0", "y0", "x1", "y1").join(face, "section_id").withColumn("iou", polygon_box_iou(F.col("polygon"), [F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("iou"), "f_ord"))).where("r = 1")
    low = F.when(F.col("iou") < LEAST_IOU, F.array(F.format_string("low_iou:%.2f", "iou"))).otherwise(F.array().cast("array<string>"))
    return _full(best, None, F.array("face_id"), low, F.col("iou"))


def _strips(regions: DataFrame, line: DataFrame, key: list[str]) -> DataFrame:
    least = F.coalesce(*(F.when(F.col("function") == f, F.lit(x)) for f, x in STRIPS.items()))
    inside = _inside(regions.where(F.col("function").isin(*STRIPS) & F.col("x0").isNotNull()), line)
    return _full(_gathered(inside.where(F.col("share") >= least), key))


def _notches(regions: DataFrame, line: DataFrame, key: list[str]) -> DataFrame:
    """Depth along u or, if that frames more length, along v."""
    notch = regions.where("function = 'forming_feature' and depth is not null and width is not null and x is not null and y is not null")
    w = lambda a: F.when(F.col("mirrored"), F.col("W") - a)
    boxes = [(F.lit(0), F.col("depth"), F.col("width")), (F.lit(1), F.col("width"), F.col("depth"))]
    turned = notch.withColumn("t", F.explode(F.array(*(F.struct(k.alias("turn"), F.col("x").alias("a0"), (F.col("x") + du).alias("a1"), (F.col("y") + dv).alias("b1")) for k, du, dv in boxes))))
    turned = turned.withColumns({"turn": F.col("t.turn"), "n0": F.coalesce(w(F.col("t.a1")), F.col("t.a0")), "n1": F.coalesce(w(F.col("t.a0")), F.col("t.a1")), "m1": F.col("t.b1")})
    inside = _inside(turned, line, "n0", "y", "n1", "m1").where(F.col("share") >= NOTCH_SHARE)
    got = _gathered(inside, [*key, "turn"], F.first("depth").alias("depth"), F.first("width").alias("width"))
    part_ = Window.partitionBy(*key)
    best = got.withColumns({"r": F.row_number().over(part_.orderBy(F.desc("_len"), "turn")), "n": F.count("*").over(part_)}).where("r = 1")
    flag = F.when((F.col("turn") == 1) & (F.col("n") > 1), F.array(F.lit("notch_axis_flipped"))).otherwise(F.array().cast("array<string>"))
    return _full(best, None, None, flag, F.least(F.lit(1.0), F.col("_len") / F.greatest(F.col("depth") + F.col("width"), F.lit(1e-6))))


def _transitions(regions: DataFrame, points: DataFrame, line: DataFrame, key: list[str]) -> list[DataFrame]:
    """By centre (nearest transition, else the corner whose distance is closest to the radius), by box, or by outer and inner corners."""
    fillet = regions.where("function = 'transition' or lower(name) like 'fillet%' or lower(name) like 'chamfer%'").withColumn("rad", F.coalesce("radius", F.lit(0.0)))
    short = lambda df: df.where("transition and (rad <= 0 or length <= 3.2 * rad + 0.5)")
    centred = fillet.where("x is not null and y is not null and width is null").withColumn("px", F.when(F.col("mirrored"), F.col("W") - F.col("x")).otherwise(F.col("x")))
    far = F.hypot(F.col("mid.u") - F.col("px"), F.col("mid.v") - F.col("y"))
    near = short(centred.join(line, "section_id")).withColumn("d", far)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("d", "c_ord"))).where("r = 1 and d <= greatest(2.2 * rad, 4.0)")
    by_centre = _full(_gathered(near, key))
    rest = centred.join(near.select(*key), key, "left_anti")
    corner = rest.join(points.select("section_id", F.col("name").alias("point"), F.col("ord").alias("p_ord"), "u", "v"), "section_id").withColumn("d", F.hypot(F.col("u") - F.col("px"), F.col("v") - F.col("y")))
    corner = corner.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.abs(F.col("d") - F.col("rad")), "p_ord"))).where("r = 1 and d between 0.4 * rad and 1.9 * rad")
    corner = corner.withColumns({"curve_names": F.array().cast("array<string>"), "point_names": F.array("point")})
    by_corner = _full(corner, F.lit("point"), None, F.array(F.lit("corner_point_fallback")), F.lit(0.8))
    boxed = fillet.where("x0 is not null")
    inside = _inside(boxed, line).where(F.col("share") >= TRANSITION_SHARE).withColumn("any", F.max(F.col("transition")).over(Window.partitionBy(*key)))
    by_box = _full(_gathered(inside.where("transition or not any"), key))
    loose = fillet.where("x0 is null and not (x is not null and y is not null and width is null)").withColumn("outer", F.coalesce(F.contains("position", F.lit("outer")), F.lit(False)) | F.contains(F.lower("name"), F.lit("outer")))
    by_turn = _full(_gathered(short(loose.join(line, "section_id")).where("convex = outer"), key))
    return [by_centre, by_corner, by_box, by_turn]


def _contour(sections: DataFrame, line: DataFrame, graph: DataFrame) -> DataFrame:
    closed = part(graph, "face").select("section_id").distinct()
    outer = part(graph, "topo").where("on_outer and not dangling").select("section_id", F.col("name").alias("curve"))
    rows = _gathered(line.join(outer, ["section_id", "curve"], "left_semi").join(closed, "section_id", "left_semi"), ["section_id"])
    none, name = F.array().cast("array<string>"), F.lit("outer_contour")
    return rows.select("section_id", F.lit(1_000_000).alias("ord"), name.alias("region_name"), name.alias("function"), F.lit("dfc.substructure.outer_contour").alias("label_id"), F.lit("curve").alias("entity_type"), none.alias("face_ids"), "curve_names", "point_names", F.lit(None).cast("int").alias("ordinal"), F.array(F.lit("synthetic")).alias("flags"), F.lit(1.0).alias("match_score"))


def samples(targets: DataFrame, meta: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Query samples: per section and label a generic one with the union of its targets, and one for each region with an ordinal where there are two.

    The entity type of a generic sample is the most frequent one, ties by first occurrence.
    """
    registry = registry or Registry()
    full = targets.where(~F.array_contains("flags", "empty_target")).join(meta.select("section_id", "family"), "section_id", "left")
    key = ["section_id", "label_id"]
    kinds = full.groupBy(*key, "entity_type").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    kinds = kinds.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "o"))).where("r = 1").select(*key, "entity_type")
    lists = F.array_sort(F.collect_list(F.struct("ord", "curve_names", "face_ids", "point_names", "region_name", "flags")))
    union = lambda f: F.array_distinct(F.flatten(F.transform("_l", lambda x: x[f])))
    real = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: x != "synthetic")))
    generic = full.groupBy(*key).agg(lists.alias("_l"), F.first("family").alias("family")).join(kinds, key)
    generic = generic.select(
        F.concat_ws("::", "section_id", "label_id", F.lit("generic")).alias("sample_id"), "section_id", "family", "label_id", "entity_type", F.lit("generic").alias("kind"), registry.caption(F.col("label_id")).alias("query_text"), F.lit(None).cast("int").alias("ordinal"),
        union("curve_names").alias("target_curves"), union("face_ids").alias("target_faces"), union("point_names").alias("target_points"), F.transform("_l", lambda x: x["region_name"]).alias("source_regions"), real(F.flatten(F.transform("_l", lambda x: x["flags"]))).alias("flags"),
    )
    numbered = full.where("ordinal is not null").withColumn("n", F.count("*").over(Window.partitionBy(*key))).where("n >= 2")
    specific = numbered.select(
        F.concat_ws("::", "section_id", "label_id", "region_name").alias("sample_id"), "section_id", "family", "label_id", "entity_type", F.lit("specific").alias("kind"), F.col("region_name").alias("query_text"), "ordinal",
        F.col("curve_names").alias("target_curves"), F.col("face_ids").alias("target_faces"), F.col("point_names").alias("target_points"), F.array("region_name").alias("source_regions"), real(F.col("flags")).alias("flags"),
    )
    return generic.unionByName(specific)


def report(targets: DataFrame) -> DataFrame:
    """Per function: regions, empty ones, low overlaps, mean match."""
    flag = lambda c: F.sum(F.exists("flags", lambda x: x.startswith(c)).cast("long"))
    return targets.groupBy("function").agg(F.count("*").alias("n_regions"), flag("empty_target").alias("n_empty"), flag("low_iou").alias("n_low"), F.avg("match_score").alias("mean_match"))
