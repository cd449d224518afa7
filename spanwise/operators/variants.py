"""Labels of edited variants: a variant is a section of its own, so its tables come from the same operators as any section's.

Targets follow curves by lineage and faces by a scored join; gates on targets are joins and aggregates over all variants at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.geometry import bezier, bounds, in_polygon, polyline_length, rect_iou
from spanwise.operators import augment, silver
from spanwise.operators.relational import cut
from spanwise.operators.topology import graph, part, section_rows

#: Least score of a face's pair, least agreement of a matched label, least share of the largest cell, name of a number's end.
LEAST_PAIR, LEAST_AGREEMENT, CELL_SHARE = 1.0, 0.95, 0.05
CHAMBER, WEB, CONTOUR = "dfc.substructure.chamber", "dfc.substructure.internal_web", "dfc.substructure.outer_contour"
NUMBER = r"[_\-\s]?(?:\d+|[a-h])$"
HEURISTIC = r"\.(notch|fillet)$"
NONE = "array<string>"
#: What ``verify.reported`` adds.
REPORTED = "validation struct<passed: boolean, gates: array<struct<gate: string, passed: boolean, value: double>>, failures: array<string>>, source_manifest array<struct<file: string, sha256: string>>, source_sha256 string"


def _none() -> Column:
    return F.array().cast(NONE)


def accepted(tried: DataFrame) -> DataFrame:
    return tried.where("reason = 'ok'")


def tables(tried: DataFrame) -> dict[str, DataFrame]:
    """sections, points, curves and graph of accepted variants; section_id is the variant's."""
    ok = accepted(tried).select(F.col("variant_id").alias("section_id"), "plane", "width", "height", "points", "curves")
    sections = ok.select("section_id", "plane", F.col("section_id").alias("section_name"), "width", "height")
    points = ok.select("section_id", F.posexplode("points").alias("ord", "p")).select("section_id", "p.name", "ord", "p.u", "p.v")
    line = ok.select("section_id", F.posexplode("curves").alias("ord", "c")).select("section_id", "ord", "c.*")
    at = points.select("section_id", "name", F.struct("u", "v").alias("uv"))
    line = line.join(at.toDF("section_id", "start", "p0"), ["section_id", "start"]).join(at.toDF("section_id", "end", "p1"), ["section_id", "end"])
    bent = F.col("control").isNotNull()
    line = line.withColumns({"q1": F.get("control", F.lit(0)), "q2": F.get("control", F.lit(1))})
    line = line.withColumn("polyline", F.when(bent, bezier("p0", "q1", "q2", "p1", 8)).otherwise(F.array("p0", "p1")))
    curves = line.select("section_id", "name", "ord", "start", "end", "control", "source", "polyline", polyline_length("polyline").alias("length"), F.hypot(F.col("p1.u") - F.col("p0.u"), F.col("p1.v") - F.col("p0.v")).alias("chord"))
    return {"sections": sections, "points": points, "curves": curves, "graph": graph(sections, points, curves)}


def moved(frame: Column, u: Column, v: Column) -> list[Column]:
    """A place under a variant's frame; unmoved where the edits weren't affine."""
    at = lambda k, old: F.when(frame.isNull(), old).otherwise(frame[k] * u + frame[k + 1] * v + frame[k + 2])
    return [at(0, u), at(3, v)]


def moved_box(frame: Column, u0: Column, v0: Column, u1: Column, v1: Column) -> list[Column]:
    corners = [moved(frame, u, v) for u in (u0, u1) for v in (v0, v1)]
    us, vs = zip(*corners, strict=True)
    return [F.least(*us), F.least(*vs), F.greatest(*us), F.greatest(*vs)]


def face_pairs(tried: DataFrame, source_faces: DataFrame, faces: DataFrame) -> DataFrame:
    """(variant_id, face_id, new_face): the face of a variant that best continues each face of its source, if its score reaches LEAST_PAIR.

    The score is twice the Jaccard similarity of curves, 1 if the old centroid lies in the new face, and the overlap of boxes; the first of equals.
    """
    kids = F.array_distinct(F.flatten(F.transform("curves", lambda c: F.coalesce(F.try_element_at("name_map", c), _none()))))
    old = accepted(tried).where(~F.array_contains("edits", "rib")).select("section_id", "variant_id", "name_map", "frame").join(source_faces.select("section_id", "face_id", "curves", "cu", "cv", "u0", "v0", "u1", "v1"), "section_id")
    box = moved_box(F.col("frame"), *(F.col(c) for c in ("u0", "v0", "u1", "v1")))
    cu, cv = moved(F.col("frame"), F.col("cu"), F.col("cv"))
    old = old.select("variant_id", "face_id", kids.alias("kids"), cu.alias("cu"), cv.alias("cv"), *(b.alias(f"b{k}") for k, b in enumerate(box)))
    new = faces.select(F.col("section_id").alias("variant_id"), F.col("face_id").alias("new_face"), "ord", "polygon", "curves", *(F.col(c).alias(f"n{k}") for k, c in enumerate(("u0", "v0", "u1", "v1"))))
    both = old.join(new, "variant_id")
    shared, whole = F.size(F.array_intersect("kids", "curves")), F.size(F.array_union("kids", "curves"))
    score = F.when(whole > 0, 2.0 * shared / whole).otherwise(0.0) + in_polygon(F.col("cu"), F.col("cv"), "polygon").cast("double") + rect_iou([F.col(f"b{k}") for k in range(4)], [F.col(f"n{k}") for k in range(4)])
    ranked = both.withColumn("score", score).withColumn("r", F.row_number().over(Window.partitionBy("variant_id", "face_id").orderBy(F.desc("score"), "ord")))
    return ranked.where((F.col("r") == 1) & (F.col("score") >= LEAST_PAIR)).select("variant_id", "face_id", "new_face")


TARGET = ("section_id", "ord", "region_name", "function", "label_id", "entity_type", "face_ids", "curve_names", "point_names", "ordinal", "flags", "match_score")


def propagated(targets: DataFrame, tried: DataFrame, source_graph: DataFrame, variant: dict[str, DataFrame]) -> DataFrame:
    """The targets of all accepted variants (columns of ``silver``; section_id is the variant's), before gates and numbers.

    Curves follow lineage and points their curves; faces follow ``face_pairs``; after a rib edit chambers are derived anew, and an
    added rib is an internal web. Empty and synthetic targets of the source don't follow; the outer contour is found anew.
    """
    ok = accepted(tried).select("section_id", "variant_id", "edits", "name_map", F.col("curves").alias("_curves"), F.transform("points", lambda p: p["name"]).alias("_points"))
    real = targets.where(~F.array_contains("flags", "synthetic") & ~F.array_contains("flags", "empty_target"))
    both = ok.join(real, "section_id")
    ends = lambda names: F.array_distinct(F.flatten(F.transform(F.filter("_curves", lambda c: F.array_contains(names, c["name"])), lambda c: F.array(c["start"], c["end"]))))
    line = both.where("entity_type <> 'face'")
    kids = F.array_distinct(F.flatten(F.transform("curve_names", lambda c: F.coalesce(F.try_element_at("name_map", c), _none()))))
    line = line.withColumn("_kids", kids)
    removed = (F.size("_kids") == 0) & (F.size("curve_names") > 0)
    flags = F.concat("flags", F.array(F.lit("augmented")), F.when(removed, F.array(F.lit("aug_removed"))).otherwise(_none()))
    points = F.when(F.col("entity_type") == "point", F.array_intersect("point_names", "_points")).otherwise(ends(F.col("_kids")))
    line = line.withColumns({"flags": flags, "point_names": points}).drop("curve_names").withColumnRenamed("_kids", "curve_names").withColumn("face_ids", _none())

    faces = part(variant["graph"], "face")
    pairs = face_pairs(tried, part(source_graph, "face"), faces)
    place = faces.select(F.col("section_id").alias("variant_id"), F.col("face_id").alias("new_face"), F.col("curves").alias("fc"), F.col("points").alias("fp"))
    face = both.where("entity_type = 'face' and not array_contains(edits, 'rib')").select("variant_id", *(c for c in TARGET if c not in ("section_id", "curve_names", "point_names")))
    hit = face.select("variant_id", "ord", F.posexplode("face_ids").alias("k", "face_id")).join(pairs, ["variant_id", "face_id"]).join(place, ["variant_id", "new_face"])
    hit = hit.groupBy("variant_id", "ord").agg(F.array_sort(F.collect_list(F.struct("k", "new_face", "fc", "fp"))).alias("x"))
    gather = lambda f: F.array_distinct(F.flatten(F.transform("x", lambda y: y[f])))
    hit = hit.select("variant_id", "ord", F.array_distinct(F.transform("x", lambda y: y["new_face"])).alias("_faces"), gather("fc").alias("_fc"), gather("fp").alias("_fp"))
    face = face.join(hit, ["variant_id", "ord"], "left").withColumns({"face_ids": F.coalesce("_faces", _none()), "curve_names": F.coalesce("_fc", _none()), "point_names": F.coalesce("_fp", _none()), "flags": F.array_append("flags", F.lit("augmented"))})

    ribbed = ok.where(F.array_contains("edits", "rib"))
    found = faces.join(ribbed.select(F.col("variant_id").alias("section_id")), "section_id", "left_semi")
    group = Window.partitionBy("section_id")
    largest = F.max(F.when(~F.col("is_sub"), F.col("area"))).over(group)
    parents = F.collect_set("parent").over(group)
    found = found.withColumns({"largest": largest, "parents": parents}).where((F.col("is_sub")) | (~F.array_contains("parents", F.col("face_id")) & (F.col("area") >= CELL_SHARE * F.col("largest"))))
    k = F.row_number().over(group.orderBy(F.desc("cv"), "cu", "ord"))
    chamber = found.withColumn("k", k).select(
        F.col("section_id").alias("variant_id"), (F.col("k") + 2_000_000).alias("ord"), F.concat(F.lit("chamber_"), "k").alias("region_name"), F.lit("enclosed").alias("function"), F.lit(CHAMBER).alias("label_id"), F.lit("face").alias("entity_type"),
        F.array("face_id").alias("face_ids"), F.col("curves").alias("curve_names"), F.col("points").alias("point_names"), F.col("k").alias("ordinal"), F.array(F.lit("augmented"), F.lit("aug_rederived")).alias("flags"), F.lit(1.0).alias("match_score"),
    )
    added = ok.select("variant_id", F.posexplode(F.filter("_curves", lambda c: c["source"] == "")).alias("k", "c")).select(
        "variant_id", (F.col("k") + 3_000_000).alias("ord"), F.concat(F.lit("stiffener_aug"), "k").alias("region_name"), F.lit("stiffener").alias("function"), F.lit(WEB).alias("label_id"), F.lit("curve").alias("entity_type"),
        _none().alias("face_ids"), F.array("c.name").alias("curve_names"), F.array("c.start", "c.end").alias("point_names"), F.lit(None).cast("int").alias("ordinal"), F.array(F.lit("augmented"), F.lit("aug_added")).alias("flags"), F.lit(1.0).alias("match_score"),
    )
    columns = ["variant_id", *TARGET[1:]]
    out = line.select(columns).unionByName(face.select(columns)).unionByName(chamber).unionByName(added).withColumnRenamed("variant_id", "section_id")
    topo = part(variant["graph"], "topo").select("section_id", "name", "transition")
    lines = variant["curves"].join(topo, ["section_id", "name"]).select("section_id", F.col("name").alias("curve"), F.col("ord").alias("c_ord"), "start", "end", "length")
    return out.unionByName(silver._contour(variant["sections"], lines, variant["graph"]).select(*TARGET))


def is_empty() -> Column:
    return (F.size("face_ids") == 0) & (F.size("curve_names") == 0) & (F.size("point_names") == 0)


def flagged(*names: str) -> Column:
    return F.exists("flags", lambda f: f.isin(*names))


def label_pairs(targets: DataFrame) -> DataFrame:
    """(section_id, a, b): labels that name the same curve, by their short names; faces and synthetic targets don't count."""
    rows = targets.where(~flagged("synthetic") & (F.col("entity_type") != "face")).select("section_id", F.substring_index("label_id", ".", -1).alias("label"), F.explode("curve_names").alias("curve")).distinct()
    other = rows.select("section_id", "curve", F.col("label").alias("b"))
    return rows.withColumnRenamed("label", "a").join(other, ["section_id", "curve"]).where("a < b").select("section_id", "a", "b").distinct()


def moved_regions(regions: DataFrame, tried: DataFrame) -> DataFrame:
    """Annotation boxes under the frames of affine variants (section_id is the variant's): the box around moved corners, radii by the root of the area's change."""
    both = regions.join(accepted(tried).where("frame is not null").select("section_id", "variant_id", "frame"), "section_id")
    num = lambda k: F.trim(F.col("bbox")[k]).try_cast("double")
    f = F.col("frame")
    high = num("height").isNotNull()
    w, h = F.when(high, num("width")).otherwise(num("depth")), F.when(high, num("height")).otherwise(num("width"))
    box = moved_box(f, num("x"), num("y"), num("x") + w, num("y") + h)
    boxed = w.isNotNull() & h.isNotNull()
    x, y = moved(f, num("x"), num("y"))
    text = lambda c: c.cast("string")
    new = {
        "x": F.when(boxed, box[0]).otherwise(x), "y": F.when(boxed, box[1]).otherwise(y),
        "width": F.when(boxed & high, box[2] - box[0]).when(boxed, box[3] - box[1]).otherwise(num("width")),
        "height": F.when(boxed & high, box[3] - box[1]).otherwise(num("height")), "depth": F.when(boxed & ~high, box[2] - box[0]).otherwise(num("depth")),
        "radius": num("radius") * F.sqrt(F.abs(f[0] * f[4] - f[1] * f[3])),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), text(v).alias("v")) for k, v in new.items()), F.struct(F.lit("position").alias("k"), F.col("bbox")["position"].alias("v")))
    bbox = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    return both.select(F.col("variant_id").alias("section_id"), "ord", "name", "function", "notes", bbox.alias("bbox"))


def agreement(targets: DataFrame, rematched: DataFrame) -> DataFrame:
    """(section_id, agreement, n): mean Jaccard similarity of propagated targets and targets matched anew, by region name; notches and fillets don't count, as their matching depends on direction and size."""
    took = lambda: F.when(F.col("entity_type") == "face", F.col("face_ids")).when(F.col("entity_type") == "point", F.col("point_names")).otherwise(F.col("curve_names"))
    mine = targets.where(~flagged("synthetic", "aug_added", "aug_rederived") & ~is_empty() & ~F.col("label_id").rlike(HEURISTIC)).select("section_id", "region_name", took().alias("a"))
    other = rematched.where(~flagged("synthetic")).select("section_id", "region_name", took().alias("b"))
    both = mine.join(other, ["section_id", "region_name"])
    whole = F.size(F.array_union("a", "b"))
    return both.groupBy("section_id").agg(F.avg(F.when(whole == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / whole)).alias("agreement"), F.count("*").alias("n"))


def judged(tried: DataFrame, targets: DataFrame, new: DataFrame, regions: DataFrame, variant: dict[str, DataFrame]) -> DataFrame:
    """tried with the reasons of gates 2 (a target lost), 3 (labels that meet anew) and 4 (affine variants whose boxes match other curves), and ``agreement``."""
    lost = new.where(is_empty() & ~flagged("synthetic", "aug_removed", "aug_added")).select(F.col("section_id").alias("variant_id")).distinct().withColumn("_lost", F.lit(True))
    of = accepted(tried).select("section_id", "variant_id")
    known = label_pairs(targets).join(of, "section_id").select("variant_id", "a", "b")
    extra = label_pairs(new).withColumnRenamed("section_id", "variant_id").join(known, ["variant_id", "a", "b"], "left_anti").select("variant_id").distinct().withColumn("_extra", F.lit(True))
    affine = accepted(tried).where(F.size(F.array_except("edits", F.array(F.lit("scale"), F.lit("rigid")))) == 0).select("variant_id")
    only = lambda df: df.join(affine.withColumnRenamed("variant_id", "section_id"), "section_id", "left_semi")
    rematched = silver.silver(*(only(variant[k]) for k in ("sections", "points", "curves", "graph")), only(moved_regions(regions, tried)))
    agreed = agreement(only(new), rematched).select(F.col("section_id").alias("variant_id"), "agreement")
    out = tried.join(lost, "variant_id", "left").join(extra, "variant_id", "left").join(agreed, "variant_id", "left")
    gate = F.when(F.col("_lost"), "gate2_empty").when(F.col("_extra"), "gate3_cooccurrence").when(F.col("agreement") < LEAST_AGREEMENT, "gate4_affine")
    return out.withColumn("reason", F.when(F.col("reason") == "ok", F.coalesce(gate, F.col("reason"))).otherwise(F.col("reason"))).select(*tried.columns, "agreement")


def renumbered(targets: DataFrame, variant: dict[str, DataFrame]) -> DataFrame:
    """Numbers by place, top to bottom and left to right, within section, label and base name where two or more have one; a target's place is its faces' or curves' mean, by area or length."""
    face = part(variant["graph"], "face").select("section_id", F.col("face_id").alias("x"), F.col("area").alias("w"), "cu", "cv", F.lit("f").alias("t"))
    u0, v0, u1, v1 = bounds("polyline")
    line = variant["curves"].select("section_id", F.col("name").alias("x"), F.col("length").alias("w"), ((u0 + u1) / 2).alias("cu"), ((v0 + v1) / 2).alias("cv"), F.lit("c").alias("t"))
    named = targets.where("ordinal is not null").where(~flagged("synthetic") & ~is_empty())
    isface = F.size("face_ids") > 0
    each = named.select("section_id", "ord", F.when(isface, "f").otherwise("c").alias("t"), F.explode(F.when(isface, F.col("face_ids")).otherwise(F.col("curve_names"))).alias("x")).join(face.unionByName(line), ["section_id", "t", "x"])
    place = each.groupBy("section_id", "ord").agg((F.sum(F.col("cu") * F.col("w")) / F.sum("w")).alias("_u"), (F.sum(F.col("cv") * F.col("w")) / F.sum("w")).alias("_v"))
    base = F.regexp_replace(F.lower("region_name"), NUMBER, "")
    key = Window.partitionBy("section_id", "label_id", "_base")
    rows = named.join(place, ["section_id", "ord"]).withColumn("_base", base).withColumns({"_k": F.row_number().over(key.orderBy(F.desc("_v"), "_u", "ord")), "_n": F.count("*").over(key)})
    new = rows.where("_n >= 2").select("section_id", "ord", "_base", "_k")
    out = targets.join(new, ["section_id", "ord"], "left")
    return out.withColumns({"ordinal": F.coalesce("_k", "ordinal"), "region_name": F.when(F.col("_k").isNotNull(), F.concat_ws("_", "_base", F.col("_k").cast("string"))).otherwise(F.col("region_name"))}).select(*targets.columns)


def drawn(corpus: dict[str, DataFrame]) -> DataFrame:
    """The points and curves of all sections as rows that edits take, with the control points of curves that have them."""
    control = corpus["curves"].select("section_id", "name", F.lit("curve").alias("kind"), "control")
    return section_rows(corpus["sections"], corpus["points"], corpus["curves"]).join(control, ["section_id", "name", "kind"], "left")


def generate(corpus: dict[str, DataFrame], regions: DataFrame, per_section: int = 20, seed: int = 1, quota: int = 0, rounds: int = 4, sections: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(attempts with reasons, targets of accepted variants, quota status) for sections with labels.

    With a quota, labels that have fewer targets, sources' and variants' together, get more attempts from the sections that have
    them, in ``rounds`` at most and up to three times per_section each. A round is one job over all sections.
    """
    real = corpus["targets"].where(~flagged("synthetic", "empty_target"))
    hosts = real.select("section_id").distinct()
    if sections is not None:
        hosts = hosts.join(sections.select("section_id"), "section_id", "left_semi")
    rows = drawn(corpus).join(corpus["sections"].select("section_id", "plane"), "section_id")
    rows = cut(rows.join(hosts, "section_id", "left_semi"))
    prints = augment.source_fingerprints(rows)
    short = lambda df: df.where(~flagged("synthetic", "empty_target") & ~is_empty()).select(F.substring_index("label_id", ".", -1).alias("label"), "section_id")
    tried, first = None, 0
    for k in range(rounds + 1 if quota else 1):
        n = per_section if k == 0 else max(1, per_section // 2)
        more = augment.attempts(rows, n, seed, first)
        first += n * augment.TRIES
        done = augment.settled(more if tried is None else tried.drop("agreement").unionByName(more), prints)
        done = cut(done)
        variant = {name: cut(df) for name, df in tables(done).items()}
        new = cut(renumbered(propagated(corpus["targets"], done, corpus["graph"], variant), variant))
        tried = cut(judged(done, corpus["targets"], new, regions, variant))
        new = new.join(accepted(tried).select(F.col("variant_id").alias("section_id")), "section_id", "left_semi")
        counts = short(corpus["targets"]).unionByName(short(new)).groupBy("label").agg(F.count("*").alias("n"))
        missing = counts.where(F.col("n") < quota).select("label")
        made = accepted(tried).groupBy("section_id").agg(F.count("*").alias("made"))
        hungry = short(corpus["targets"]).join(F.broadcast(missing), "label", "left_semi").select("section_id").distinct().join(made, "section_id", "left").where(F.coalesce("made", F.lit(0)) < 3 * per_section)
        if not quota or hungry.isEmpty():
            break
        rows = cut(rows.join(hungry.select("section_id"), "section_id", "left_semi"))
    status = counts.withColumn("met", F.col("n") >= quota)
    return tried, new, status


def read_variants(spark, path: str, reports: bool = False) -> DataFrame:
    """Attempts as ``augment.attempts`` gives them, from JSON lines written before; with ``reports`` also what ``verify.reported`` added."""
    return spark.read.schema(f"{augment.VARIANT}, agreement double" + (f", {REPORTED}" if reports else "")).json(path)


def families(meta: DataFrame, tried: DataFrame) -> DataFrame:
    """(section_id, family, source_id, ops): variants have their source's family, and the names of their edits; originals have none."""
    of = meta.select("section_id", "family")
    var = accepted(tried).select("section_id", "variant_id", F.array_join("edits", "+").alias("ops")).join(of, "section_id").select(F.col("variant_id").alias("section_id"), "family", F.col("section_id").alias("source_id"), "ops")
    return of.withColumns({"source_id": F.col("section_id"), "ops": F.lit("")}).unionByName(var)


def union_tables(corpus: dict[str, DataFrame], variant: dict[str, DataFrame], names: Sequence[str]) -> dict[str, DataFrame]:
    """Originals and variants in one table each, by column name."""
    return {k: corpus[k].unionByName(variant[k], allowMissingColumns=True) for k in names}
