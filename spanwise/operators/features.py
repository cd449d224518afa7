"""Features of curves (33) and faces (13) as column expressions over the graph's tables.

Lengths, extents, ranks and degrees are those of a curve's run, so that an added point changes none of them; places
are the curve's own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.functions.geometry import distance_to_boundary, hull
from spanwise.operators.topology import part, rank_by

#: The features' names in order.
CURVE_FEATURES = [
    "run_len_norm", "u_center", "v_center", "run_du_norm", "run_dv_norm", "orient_cos", "orient_sin", "is_horizontal", "is_vertical", "straightness",
    "border_dist_min", "hull_dist_norm", "aligned_long_axis", "run_span_long_axis", "run_span_short_axis", "run_len_over_longdim", "run_v_rank", "run_u_rank",
    "run_len_rank", "n_cells_norm", "separates_cells", "on_outer", "dangling", "transition_like", "transition_convex", "run_has_tip_endpoint",
    "run_min_degree_norm", "run_max_degree_norm", "chain_len_norm", "in_pocket", "section_aspect", "n_runs_norm", "section_closed",
]
FACE_FEATURES = [
    "area_norm", "u_center", "v_center", "aspect", "v_rank", "u_rank", "area_rank", "n_boundary_runs_norm", "is_subcell", "waist_ratio", "rel_area_to_max",
    "boundary_outer_frac", "section_aspect",
]

#: Degrees that count as horizontal and vertical, pocket depth, and scales.
HORIZONTAL, VERTICAL, POCKET = 20.0, 70.0, 0.02


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("u", T.DoubleType()), T.StructField("v", T.DoubleType())])))
def convex_hull(points: pd.Series) -> pd.Series:
    return pd.Series([[{"u": u, "v": v} for u, v in hull([(p["u"], p["v"]) for p in x])] for x in points])


def frames(sections: DataFrame, points: DataFrame, graph: DataFrame) -> DataFrame:
    """Per section: width, height, diagonal, hull, whether it has cells."""
    outline = points.groupBy("section_id").agg(F.collect_list(F.struct("u", "v")).alias("_p")).select("section_id", convex_hull("_p").alias("hull"))
    cells = part(graph, "face").groupBy("section_id").agg(F.count("*").alias("n_faces"), F.max("area").alias("max_area"))
    size = sections.select("section_id", F.greatest("width", F.lit(1e-6)).alias("W"), F.greatest("height", F.lit(1e-6)).alias("H"), F.greatest(F.hypot("width", "height"), F.lit(1e-6)).alias("diag"))
    return size.join(outline, "section_id").join(cells, "section_id", "left").withColumn("closed", F.coalesce(F.col("n_faces") > 0, F.lit(False)).cast("double"))


def run_stats(curves: DataFrame, graph: DataFrame) -> DataFrame:
    """Per run: length, extents, centroid by length, least and greatest degree of its ends, ranks among the section's runs."""
    topo = part(graph, "topo").select("section_id", "name", "run", "nodes")
    members = curves.join(topo, ["section_id", "name"])
    us, vs = F.transform("polyline", lambda p: p["u"]), F.transform("polyline", lambda p: p["v"])
    mid = F.col("polyline")[(F.size("polyline") / 2).cast("int")]
    stats = members.groupBy("section_id", "run").agg(
        F.sum("length").alias("len"), (F.max(F.array_max(us)) - F.min(F.array_min(us))).alias("du"), (F.max(F.array_max(vs)) - F.min(F.array_min(vs))).alias("dv"),
        (F.sum(mid["u"] * F.col("length")) / F.greatest(F.sum("length"), F.lit(1e-9))).alias("cu"), (F.sum(mid["v"] * F.col("length")) / F.greatest(F.sum("length"), F.lit(1e-9))).alias("cv"), F.min("ord").alias("ord"),
    )
    degree = part(graph, "edge").select("section_id", F.explode(F.array("node_a", "node_b")).alias("node")).groupBy("section_id", "node").agg(F.count("*").alias("degree"))
    touch = topo.select("section_id", "name", "run", F.explode("nodes").alias("node"))
    at_node = touch.groupBy("section_id", "node").agg(F.countDistinct("name").alias("n_curves"), F.countDistinct("run").alias("n_runs"))
    # A node where only two curves of one run meet lies inside the run.
    ends = touch.select("section_id", "run", "node").distinct().join(at_node, ["section_id", "node"]).where("not (n_runs = 1 and n_curves = 2)")
    ends = ends.join(degree, ["section_id", "node"], "left").groupBy("section_id", "run").agg(F.min(F.coalesce("degree", F.lit(0))).alias("min_deg"), F.max(F.coalesce("degree", F.lit(0))).alias("max_deg"))
    out = stats.join(ends, ["section_id", "run"], "left").na.fill(0, ["min_deg", "max_deg"])
    s = F.col("section_id")
    return out.withColumns({"v_rank": rank_by(s, F.asc("cv"), F.asc("ord")), "u_rank": rank_by(s, F.asc("cu"), F.asc("ord")), "len_rank": rank_by(s, F.asc("len"), F.asc("ord"))})


def curve_features(sections: DataFrame, points: DataFrame, curves: DataFrame, graph: DataFrame) -> DataFrame:
    """(section_id, name, ord, CURVE_FEATURES)."""
    runs = run_stats(curves, graph).select("section_id", "run", *(F.col(c).alias(f"r_{c}") for c in ("len", "du", "dv", "cu", "cv", "min_deg", "max_deg", "v_rank", "u_rank", "len_rank")))
    n_runs = runs.groupBy("section_id").agg(F.count("*").alias("n_runs"))
    frame = frames(sections, points, graph).join(n_runs, "section_id", "left")
    topo = part(graph, "topo").drop("nodes", "cells", "component", "chain")
    x = curves.join(topo, ["section_id", "name"]).join(runs, ["section_id", "run"]).join(frame, "section_id")
    c = F.col
    flag = lambda cond: cond.cast("double")
    mean = lambda f: F.aggregate("polyline", F.lit(0.0), lambda s, p: s + p[f]) / F.size("polyline")
    first, last = c("polyline")[0], F.element_at("polyline", -1)
    du, dv = F.abs(last["u"] - first["u"]), F.abs(last["v"] - first["v"])
    span = F.greatest(F.hypot(du, dv), F.lit(1e-9))
    x = x.withColumns({"_cu": mean("u"), "_cv": mean("v"), "_du": du, "_dv": dv, "_span": span, "_angle": F.degrees(F.atan2(dv, du)), "_mid": c("polyline")[(F.size("polyline") / 2).cast("int")]})
    tall = c("H") >= c("W")
    horizontal, vertical = flag(c("_angle") < HORIZONTAL), flag(c("_angle") > VERTICAL)
    rdu, rdv = c("r_du") / c("W"), c("r_dv") / c("H")
    depth = distance_to_boundary(c("r_cu"), c("r_cv"), "hull") / c("diag")
    values = [
        c("r_len") / c("diag"), c("_cu") / c("W"), c("_cv") / c("H"), rdu, rdv, c("_du") / c("_span"), c("_dv") / c("_span"), horizontal, vertical,
        c("chord") / F.greatest("length", F.lit(1e-9)),
        F.least(c("_cu"), c("W") - c("_cu"), c("_cv"), c("H") - c("_cv")) / F.greatest("W", "H"),
        distance_to_boundary(c("_mid")["u"], c("_mid")["v"], "hull") / c("diag"),
        F.when(tall, vertical).otherwise(horizontal), F.when(tall, rdv).otherwise(rdu), F.when(tall, rdu).otherwise(rdv), c("r_len") / F.greatest("W", "H"),
        c("r_v_rank"), c("r_u_rank"), c("r_len_rank"), c("n_cells") / 2.0, flag(c("n_cells") >= 2), flag(c("on_outer")), flag(c("dangling")),
        flag(c("transition")), flag(c("convex")), flag(c("r_min_deg") <= 1), c("r_min_deg") / 4.0, c("r_max_deg") / 4.0, c("chain_length") / c("diag"),
        flag(c("on_outer") & (depth > POCKET)), F.least(c("H") / c("W"), F.lit(8.0)) / 8.0, c("n_runs") / 30.0, c("closed"),
    ]
    return x.select("section_id", "name", "ord", *(v.alias(n) for v, n in zip(values, CURVE_FEATURES, strict=True)))


def face_features(sections: DataFrame, points: DataFrame, graph: DataFrame) -> DataFrame:
    """(section_id, face_id, ord, FACE_FEATURES)."""
    topo = part(graph, "topo").select("section_id", F.col("name").alias("curve"), "run", "on_outer")
    face = part(graph, "face").join(frames(sections, points, graph), "section_id")
    edge = face.select("section_id", "face_id", F.explode("curves").alias("curve")).join(topo, ["section_id", "curve"])
    border = edge.groupBy("section_id", "face_id").agg(F.countDistinct("run").alias("n_runs"), F.avg(F.col("on_outer").cast("double")).alias("outer"))
    x = face.join(border, ["section_id", "face_id"], "left").na.fill(0, ["n_runs", "outer"])
    c, s = F.col, F.col("section_id")
    values = [
        c("area") / (c("W") * c("H")), c("cu") / c("W"), c("cv") / c("H"),
        F.least(F.greatest(c("u1") - c("u0"), F.lit(1e-9)) / F.greatest(c("v1") - c("v0"), F.lit(1e-9)), F.lit(8.0)) / 8.0,
        rank_by(s, F.asc("cv"), F.asc("ord")), rank_by(s, F.asc("cu"), F.asc("ord")), rank_by(s, F.asc("area"), F.asc("ord")), c("n_runs") / 12.0,
        c("is_sub").cast("double"), c("waist"), c("area") / c("max_area"), c("outer"), F.least(c("H") / c("W"), F.lit(8.0)) / 8.0,
    ]
    return x.select("section_id", "face_id", "ord", *(v.alias(n) for v, n in zip(values, FACE_FEATURES, strict=True)))
