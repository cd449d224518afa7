"""Answers to label queries, a table of queries at a time: which entities of a section are meant, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.scalar import decision
from spanwise.operators.labels import Registry, resolve
from spanwise.operators.models import Bank, point_scores
from spanwise.operators.relational import cut, graph_components
from spanwise.operators.topology import part

#: Score from which an entity, or a corner point, counts; share of the largest cell below which a face is a splinter; nearness of positions.
THRESHOLD, CORNER, SPLINTER, NEAR = 0.5, 0.35, 0.05, 0.12


def whole_faces(graph: DataFrame) -> DataFrame:
    """(section_id, face_id) of faces that can answer: no splinters, and no cells that have sub-cells."""
    face = part(graph, "face").select("section_id", "face_id", "area", "parent", "is_sub")
    parents = face.where("is_sub").select("section_id", F.col("parent").alias("face_id")).distinct()
    largest = face.where("not is_sub").groupBy("section_id").agg(F.max("area").alias("most"))
    return face.join(parents, ["section_id", "face_id"], "left_anti").join(largest, "section_id").where(F.col("area") >= SPLINTER * F.col("most")).select("section_id", "face_id")


def candidates(registry: Registry, bank: Bank, curve_features: DataFrame, face_features: DataFrame, graph: DataFrame) -> DataFrame:
    """(label_id, section_id, kind, name, ord, score, scorer, contributions) of all curves and faces for all labels; splinters and cells with sub-cells are out.

    contributions names the features that add most to a model's score; rules have none.
    """
    label = lambda row: row[0].rsplit(".", 1)[-1]

    def of(kind: str, score) -> Column:
        rows = []
        for row in registry.labels:
            if row[2] == kind:
                name, model = bank.scorer(label(row), kind == "face"), bank.face if kind == "face" else bank.curves.get(label(row))
                why = model.contributions() if name != "rules" and model else F.array().cast("array<string>")
                rows.append(F.struct(F.lit(row[0]).alias("label_id"), score(row).alias("score"), F.lit(name).alias("scorer"), why.alias("contributions")))
        return F.explode(F.array(*rows))

    faces = face_features.join(whole_faces(graph), ["section_id", "face_id"]).select("section_id", F.col("face_id").alias("name"), "ord", of("face", lambda row: bank.face_score()).alias("s"))
    lines = curve_features.select("section_id", "name", "ord", of("curve", lambda row: bank.curve_score(label(row))).alias("s"))
    both = faces.withColumn("kind", F.lit("face")).unionByName(lines.withColumn("kind", F.lit("curve")))
    return both.select("s.label_id", "section_id", "kind", "name", "ord", "s.score", "s.scorer", "s.contributions")


def instances(chosen: DataFrame, curves: DataFrame, graph: DataFrame) -> DataFrame:
    """Chosen entities (query_id, section_id, kind, name, ord, score) grouped into instances: curves that share a node, each face, each point.

    (query_id, section_id, kind, iid, names, points, boundary, score, cu, cv)
    """
    key = ["query_id", "section_id"]
    topo = part(graph, "topo").select("section_id", "name", F.explode("nodes").alias("node"))
    line = chosen.where("kind = 'curve'")
    links = line.select(*key, "name").join(topo, ["section_id", "name"]).select(*key, F.concat(F.lit("c:"), "name").alias("a"), F.concat(F.lit("n:"), "node").alias("b"))
    comp = graph_components(links, "a", "b", key).where("node like 'c:%'").select(*key, F.substring("node", 3, 10_000).alias("name"), F.col("component").alias("iid"))
    geo = curves.select("section_id", "name", "start", "end", "length", F.col("polyline")[(F.size("polyline") / 2).cast("int")].alias("mid"))
    rows = line.join(comp, [*key, "name"], "left").withColumn("iid", F.coalesce("iid", "name")).join(geo, ["section_id", "name"])
    w = F.greatest(F.sum("length"), F.lit(1e-9))
    sorted_ = F.array_sort(F.collect_list(F.struct("ord", "name", "start", "end")))
    grouped = rows.groupBy(*key, "iid").agg(sorted_.alias("_m"), F.avg("score").alias("score"), (F.sum(F.col("mid.u") * F.col("length")) / w).alias("cu"), (F.sum(F.col("mid.v") * F.col("length")) / w).alias("cv"))
    none = F.array().cast("array<string>")
    by_curve = grouped.select(*key, F.lit("curve").alias("kind"), "iid", F.transform("_m", lambda x: x["name"]).alias("names"), F.array_distinct(F.flatten(F.transform("_m", lambda x: F.array(x["start"], x["end"])))).alias("points"), none.alias("boundary"), "score", "cu", "cv")
    face = part(graph, "face").select("section_id", F.col("face_id").alias("name"), "curves", "points", "cu", "cv", "parent", "is_sub")
    faces = chosen.where("kind = 'face'").join(face, ["section_id", "name"])
    # A cell and its sub-cells chosen together: the finer ones stay if their mean score isn't lower.
    sub = faces.where("is_sub").groupBy(*key, F.col("parent").alias("name")).agg(F.avg("score").alias("sub_mean"))
    own = faces.where("not is_sub").select(*key, F.col("name").alias("parent"), F.col("score").alias("own"))
    faces = faces.join(sub, [*key, "name"], "left").join(own, [*key, "parent"], "left")
    subs = faces.where("is_sub").withColumn("mean", F.avg("score").over(Window.partitionBy(*key, "parent"))).where("own is null or mean >= own").drop("mean")
    faces = faces.where("not is_sub and (sub_mean is null or score > sub_mean)").unionByName(subs)
    by_face = faces.select(*key, "kind", F.col("name").alias("iid"), F.array("name").alias("names"), "points", F.col("curves").alias("boundary"), "score", "cu", "cv")
    return by_curve.unionByName(by_face)


def map_queries(queries: DataFrame, sections: DataFrame, points: DataFrame, curves: DataFrame, graph: DataFrame, curve_features: DataFrame, face_features: DataFrame, bank: Bank | None = None, registry: Registry | None = None, top_k: int = 10, compat: bool = False, scored: DataFrame | None = None, ready: bool = False) -> DataFrame:
    """queries (query_id, section_id, text, or with label_id, ordinal, count, position, text_score resolved) to one answer each.

    query_id, section_id, label_id, decision, confidence, targets (kind, name, runtime id, stable reference), instances,
    derived points and curves, candidates, scorer and contributions of the best candidate, evidence. Selectors apply in turn:
    position, ordinal, count. scored: ``candidates`` made before, of one bank or of several for different sections. ready: the
    tables are cut already, as by a caller that asks more than once.
    """
    registry = registry or Registry()
    asked = queries if "label_id" in queries.columns else resolve(queries, registry, compat)
    if not ready:
        sections, points, curves, graph = (cut(x) for x in (sections, points, curves, graph))
    have = sections.select("section_id", "section_name", F.greatest("width", F.lit(1e-9)).alias("W"), F.greatest("height", F.lit(1e-9)).alias("H"))
    asked = asked.join(have, "section_id", "left").withColumn("entity_type", registry.entity_type(F.col("label_id")))
    asked = cut(asked)
    scored = scored if scored is not None else candidates(registry, bank, curve_features, face_features, graph)
    every = asked.where("label_id is not null and section_name is not null").join(scored, ["section_id", "label_id"])
    every = cut(every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))))
    key = ["query_id", "section_id"]
    chosen = every.where(F.col("score") >= THRESHOLD).select(*key, "kind", "name", "ord", "score")
    # Fillets are often drawn as sharp corners: without one, corner points answer.
    lacking = asked.where("label_id like '%.fillet'").join(chosen.select("query_id").distinct(), "query_id", "left_anti")
    at = points.select("section_id", "name", F.col("ord").alias("p_ord"), F.col("u").alias("cu"), F.col("v").alias("cv"))
    corner = lacking.select(*key).join(point_scores(graph, curves), "section_id").where(F.col("score") >= CORNER).join(at, ["section_id", "name"])
    none = F.array().cast("array<string>")
    by_point = corner.select(*key, F.lit("point").alias("kind"), F.col("name").alias("iid"), F.array("name").alias("names"), F.array("name").alias("points"), none.alias("boundary"), "score", "cu", "cv")
    inst = cut(instances(chosen, curves, graph).unionByName(by_point)).join(asked.select("query_id", "ordinal", "count", "position", "W", "H"), "query_id")
    q = Window.partitionBy("query_id")
    u, v = F.col("cu") / F.col("W"), F.col("cv") / F.col("H")
    crit = F.when(F.col("position") == "center", F.abs(v - 0.5) + 0.3 * F.abs(u - 0.5)).when(F.col("position") == "top", -v).when(F.col("position") == "bottom", v).when(F.col("position") == "left", u).when(F.col("position") == "right", -u)
    spatial = [F.desc("cv"), F.asc("cu"), F.asc("iid")]
    inst = inst.withColumn("crit", crit)
    inst = inst.withColumns({"best": F.min("crit").over(q), "place": F.row_number().over(q.orderBy("crit", *spatial))})
    inst = inst.where("position is null or (count is not null and place <= count) or (count is null and crit - best <= " + str(NEAR) + ")")
    inst = inst.withColumns({"at": F.row_number().over(q.orderBy(*spatial)), "n_place": F.count("*").over(q)})
    inst = cut(inst)
    late = inst.groupBy("query_id").agg(F.max((F.col("ordinal") > F.col("n_place")).cast("int")).alias("out_of_range"), F.max("n_place").alias("n_place"))
    inst = inst.where("ordinal is null or at = ordinal")
    inst = inst.withColumns({"n": F.count("*").over(q), "by_score": F.row_number().over(q.orderBy(F.desc("score"), "at"))})
    inst = inst.withColumn("mismatch", F.col("count").isNotNull() & (F.col("n") < F.col("count"))).where("count is null or n <= count or by_score <= count")
    answer = inst.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "kind", "names", "points", "boundary", "score"))).alias("instances"), F.avg("score").alias("mean"), F.max(F.col("mismatch").cast("int")).alias("mismatch"), F.max("n").alias("n"),
    )
    top = every.where(F.col("rank") <= top_k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name", F.round("score", 4).alias("score")))).alias("candidates"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), *(F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c) for c in ("scorer", "contributions")))
    any_face = part(graph, "face").select("section_id").distinct().withColumn("has_face", F.lit(True))
    out = asked.join(answer, "query_id", "left").join(late, "query_id", "left").join(top, "query_id", "left").join(any_face, "section_id", "left")
    confidence = F.coalesce(F.col("mean") * F.col("text_score"), F.when(F.col("out_of_range") == 1, 0.0), F.col("top_score"), F.lit(0.0))
    no_cells = (F.col("entity_type") == "face") & F.col("has_face").isNull()
    known = F.col("section_name").isNotNull() & F.col("label_id").isNotNull() & ~no_cells
    verdict = F.when(~known, "unsupported").when(F.col("instances").isNull(), "not_found").otherwise(decision(F.col("mean") * F.col("text_score"), F.col("mismatch") == 1))
    why = F.array_compact(F.array(
        F.when(F.col("section_name").isNull(), F.concat(F.lit("unknown_section:"), "section_id")), F.when(F.col("label_id").isNull(), "unresolved_query"), F.when(known.eqNullSafe(False) & no_cells, "no_closed_cells_in_section"),
        F.when(F.col("evidence").isNotNull(), F.concat(F.lit("text:"), "evidence", F.lit("="), "matched")) if "evidence" in asked.columns else F.lit("input:label_id"),
        F.when(F.col("out_of_range") == 1, F.format_string("ordinal_out_of_range:%d>%d", "ordinal", "n_place")), F.when(known & F.col("instances").isNull() & F.coalesce(F.col("out_of_range") != 1, F.lit(True)), "no_entity_above_threshold"),
        F.when(F.col("position").isNotNull(), F.concat(F.lit("selector:position="), "position")), F.when(F.col("ordinal").isNotNull(), F.concat(F.lit("selector:ordinal="), F.col("ordinal").cast("string"))),
        F.when(F.col("mismatch") == 1, F.format_string("count_mismatch:expect%d_got%d", "count", "n")),
    ))
    names = F.flatten(F.transform("instances", lambda i: F.transform(i["names"], lambda x: F.struct(i["kind"].alias("kind"), x.alias("name"), F.concat_ws("/", "section_id", "section_name", F.when(i["kind"] == "face", "derived_face").otherwise(i["kind"]), x).alias("stable_ref")))))
    return out.select(
        "query_id", "section_id", "label_id", "entity_type", "ordinal", "count", "position", verdict.alias("decision"), F.when(known, F.round(confidence, 4)).otherwise(0.0).alias("confidence"),
        F.coalesce(names, F.array()).alias("targets"), F.array_distinct(F.flatten(F.transform("instances", lambda i: F.when(i["kind"] == "point", none).otherwise(i["points"])))).alias("derived_points"),
        F.array_distinct(F.flatten(F.transform("instances", lambda i: i["boundary"]))).alias("derived_curves"), "instances", "candidates", "scorer", F.coalesce("contributions", none).alias("contributions"), why.alias("evidence"),
    )
