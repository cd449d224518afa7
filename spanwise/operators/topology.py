"""Topology of sections: the planar kernel's tables, and the plain endpoint topology as joins and aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.operators.planar import Planar
from spanwise.operators.relational import class_of, degrees, graph_components, resolve_unique

UV = "struct<u: double, v: double>"
EDGE = f"struct<edge_id: int, curve: string, sub_index: int, node_a: string, node_b: string, length: double, polyline: array<{UV}>>"
FACE = (
    "struct<face_id: string, ord: int, is_sub: boolean, parent: string, waist: double, area: double, cu: double, cv: double, u0: double, v0: double,"
    f" u1: double, v1: double, polygon: array<{UV}>, curves: array<string>, points: array<string>>"
)
TOPO = (
    "struct<name: string, n_cells: int, cells: array<string>, on_outer: boolean, dangling: boolean, chain: int, chain_length: double,"
    " component: int, transition: boolean, convex: boolean, run: int, nodes: array<string>>"
)
NODE = "struct<name: string, rep: string, degree: int, on_outer: boolean, is_tip: boolean, component: int>"
GRAPH = f"section_id string, kind string, edge {EDGE}, face {FACE}, topo {TOPO}, node {NODE}"


def _uv(poly) -> list[dict]:
    return [{"u": float(p[0]), "v": float(p[1])} for p in poly]


def graph_rows(section_id: str, g: Planar) -> list[tuple]:
    """The kernel's result as rows of GRAPH."""
    out: list[tuple] = []
    for e in g.edges:
        out.append((section_id, "edge", {"edge_id": e.id, "curve": e.curve, "sub_index": e.sub, "node_a": e.a, "node_b": e.b, "length": e.length, "polyline": _uv(e.poly)}, None, None, None))
    for k, f in enumerate([*g.faces, *g.subs]):
        u0, v0, u1, v1 = f.bbox
        row = {"face_id": f.id, "ord": k, "is_sub": f.parent is not None, "parent": f.parent, "waist": f.waist, "area": f.area, "cu": f.centroid[0], "cv": f.centroid[1], "u0": u0, "v0": v0, "u1": u1, "v1": v1, "polygon": _uv(f.polygon), "curves": f.curves, "points": f.points}
        out.append((section_id, "face", None, row, None, None))
    chain_length = {c: sum(g.arcs[x].length for x in chain) for chain in g.chains for c in chain}
    touch: dict[str, list[str]] = {}
    for e in g.edges:
        if e.curve:
            touch.setdefault(e.curve, []).extend(n for n in (e.a, e.b) if n not in touch.get(e.curve, ()))
    for c, t in g.topo.items():
        row = {"name": c, "n_cells": t.n_cells, "cells": t.cells, "on_outer": t.on_outer, "dangling": t.dangling, "chain": t.chain, "chain_length": chain_length.get(c, g.arcs[c].length), "component": t.component, "transition": t.transition, "convex": t.convex, "run": t.run, "nodes": touch.get(c, [])}
        out.append((section_id, "topo", None, None, row, None))
    for p in g.points:
        rep = g.rep.get(p, p)
        degree = len(g.at[rep]) if g.edges and rep in g.at else 0
        row = {"name": p, "rep": rep, "degree": degree, "on_outer": rep in g.outer_nodes, "is_tip": degree == 1, "component": g.component.get(rep, -1)}
        out.append((section_id, "node", None, None, None, row))
    return out


def planar_of(group: pd.DataFrame) -> Planar:
    """A section's kernel from its rows (kind point or curve, name, ord, u, v, start, end, polyline, width, height)."""
    rows = group.sort_values("ord", kind="stable")
    points = {x["name"]: (x["u"], x["v"]) for x in rows[rows["kind"] == "point"].to_dict("records")}
    curves = {x["name"]: (x["start"], x["end"], [(p["u"], p["v"]) for p in x["polyline"]]) for x in rows[rows["kind"] == "curve"].to_dict("records")}
    return Planar(points, curves, float(rows["width"].iloc[0]), float(rows["height"].iloc[0]))


def section_rows(sections: DataFrame, points: DataFrame, curves: DataFrame) -> DataFrame:
    """Points and curves of a section as rows of one table, pruned to what the kernel reads."""
    size = sections.select("section_id", "width", "height")
    none = lambda t: F.lit(None).cast(t)
    p = points.select("section_id", F.lit("point").alias("kind"), "name", "ord", "u", "v", none("string").alias("start"), none("string").alias("end"), none(f"array<{UV}>").alias("polyline"))
    c = curves.select("section_id", F.lit("curve").alias("kind"), "name", "ord", none("double").alias("u"), none("double").alias("v"), "start", "end", "polyline")
    return p.unionByName(c).join(size, "section_id")


def graph(sections: DataFrame, points: DataFrame, curves: DataFrame) -> DataFrame:
    """GRAPH rows of all sections; take a table of it with ``part``. Persist it: the kernel runs once."""

    def kernel(key, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(graph_rows(key[0], planar_of(group)), columns=["section_id", "kind", "edge", "face", "topo", "node"])

    return section_rows(sections, points, curves).groupBy("section_id").applyInPandas(kernel, GRAPH)


def part(graph_rows_: DataFrame, kind: str) -> DataFrame:
    return graph_rows_.where(F.col("kind") == kind).select("section_id", f"{kind}.*")


def endpoint_topology(curves: DataFrame) -> DataFrame:
    """Per section, from curve ends alone (curves: section_id, name, start, end, valid): class and signature.

    missing_endpoint if a curve lacks an end, else branched, open or closed; the signature is class:degrees:cK, with the
    least and greatest degree and the number of components, counted from 1 in the extractor's numbering.
    """
    good = curves.where("valid")
    nodes = degrees(good, "start", "end", ["section_id"]).groupBy("section_id").agg(
        F.sum((F.col("degree") > 2).cast("int")).alias("n_branch"), F.sum((F.col("degree") == 1).cast("int")).alias("n_end"), F.min("degree").alias("lo"), F.max("degree").alias("hi")
    )
    comps = graph_components(good, "start", "end", ["section_id"]).groupBy("section_id").agg(F.countDistinct("component").alias("n_components"))
    sizes = curves.groupBy("section_id").agg(F.count("*").alias("n_curves"), F.sum((~F.col("valid")).cast("int")).alias("n_invalid"))
    out = sizes.join(nodes, "section_id", "left").join(comps, "section_id", "left").na.fill(0)
    plain = class_of(F.col("n_branch"), F.col("n_end"), F.col("n_curves") - F.col("n_invalid"))
    signature = F.format_string("%s:d%d-d%d:c%d", F.when(F.col("n_invalid") > 0, "missing_endpoint").otherwise(plain), "lo", "hi", "n_components")
    return out.select("section_id", "n_curves", "n_invalid", "n_branch", "n_end", "n_components", plain.alias("class"), signature.alias("signature"))


def resolve_ends(curves: DataFrame, points: DataFrame) -> DataFrame:
    """Curve ends by point name, else by id, within the section; an ambiguous end is null, never the first."""
    out = curves
    for end in ("start", "end"):
        by_name = points.select("section_id", F.col("name").alias(f"{end}_name"), F.col("key").alias("key"))
        by_id = points.where("id is not null").select("section_id", F.col("id").alias(f"{end}_id"), "key")
        out = resolve_unique(out, by_name, ["section_id", f"{end}_name"], "key", "_k1").withColumnRenamed("n_matches", "_n1")
        out = resolve_unique(out, by_id, ["section_id", f"{end}_id"], "key", "_k2").withColumnRenamed("n_matches", "_n2")
        # A name that matches hides the id, even if it is ambiguous.
        out = out.withColumn(end, F.when(F.col("_n1") > 0, F.col("_k1")).otherwise(F.col("_k2"))).drop("_k1", "_k2", "_n1", "_n2")
    return out.withColumn("valid", F.col("start").isNotNull() & F.col("end").isNotNull())


def region_candidates(regions: DataFrame, curves: DataFrame) -> DataFrame:
    """(section_id, region, curve): boxes that meet, both ends included. The equi key makes it a hash join with a residual predicate."""
    meet = (F.col("u1") >= F.col("x0")) & (F.col("u0") <= F.col("x1")) & (F.col("v1") >= F.col("y0")) & (F.col("v0") <= F.col("y1"))
    return regions.join(curves, (regions["section_id"] == curves["section_id"]) & meet).select(regions["section_id"], "region", "curve")


def with_bounds(curves: DataFrame) -> DataFrame:
    from spanwise.functions.geometry import bounds

    u0, v0, u1, v1 = bounds("polyline")
    return curves.withColumns({"u0": u0, "v0": v0, "u1": u1, "v1": v1})


def rank_by(key: Column, *order: Column) -> Column:
    from spanwise.functions.scalar import position_rank

    w = Window.partitionBy(key)
    return position_rank(F.row_number().over(w.orderBy(*order)), F.count("*").over(w))
