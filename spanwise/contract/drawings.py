"""The section operators themselves over the benchmark tables: the lines of an order are a drawing, points at (quantity, supplier).

An order has few lines, so its drawing is one row; coordinates are whole numbers, so sums are exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.contract.queries import query, t
from spanwise.functions import geometry as G
from spanwise.functions import scalar as S
from spanwise.operators import augment, topology
from spanwise.operators import relational as R

#: A drawing of each order, and neighbours in it, closed and open.
SQL_POLY = """WITH d AS (SELECT l_orderkey, list(struct_pack(u := l_quantity, v := (l_suppkey % 50)::DOUBLE) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p, count(*) AS n FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey, p, n, unnest(range(1, n + 1)) AS i FROM d),
e AS (SELECT l_orderkey, n, i, p[i].u AS au, p[i].v AS av, p[(i % n) + 1].u AS bu, p[(i % n) + 1].v AS bv FROM c)
"""


def polygons(spark, sf: str) -> DataFrame:
    line = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    point = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("u"), (F.col("l_suppkey") % 50).cast("double").alias("v"))
    rows = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("x"))
    return rows.select("l_orderkey", F.transform("x", lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"))).alias("poly"))


@query(SQL_POLY + "SELECT l_orderkey, sum(au * bv - bu * av) / 2 AS area FROM e GROUP BY l_orderkey")
def polygon_area(spark, sf):
    return polygons(spark, sf).select("l_orderkey", G.signed_area("poly").alias("area"))


@query(SQL_POLY + "SELECT l_orderkey, round(coalesce(sum(CASE WHEN i < n THEN sqrt((bu - au) * (bu - au) + (bv - av) * (bv - av)) END), 0), 6) AS length FROM e GROUP BY l_orderkey")
def polyline_lengths(spark, sf):
    return polygons(spark, sf).select("l_orderkey", F.round(G.polyline_length("poly"), 6).alias("length"))


@query(SQL_POLY + """, a AS (SELECT l_orderkey, sum(au * bv - bu * av) / 2 AS area, sum((au + bu) * (au * bv - bu * av)) AS su, sum((av + bv) * (au * bv - bu * av)) AS sv, sum(au) / count(*) AS mu, sum(av) / count(*) AS mv FROM e GROUP BY l_orderkey)
SELECT l_orderkey, round(CASE WHEN abs(area) > 1e-9 THEN su / (6 * area) ELSE mu END, 6) AS u, round(CASE WHEN abs(area) > 1e-9 THEN sv / (6 * area) ELSE mv END, 6) AS v FROM a""")
def polygon_centroid(spark, sf):
    c = polygons(spark, sf).select("l_orderkey", G.centroid("poly").alias("c"))
    return c.select("l_orderkey", F.round("c.u", 6).alias("u"), F.round("c.v", 6).alias("v"))


@query(SQL_POLY + "SELECT l_orderkey, coalesce(sum(CASE WHEN (av > 24.5) <> (bv > 24.5) AND au + (24.5 - av) * (bu - au) / (bv - av) > 25 THEN 1 ELSE 0 END) % 2 = 1, false) AS inside FROM e GROUP BY l_orderkey")
def point_in_polygon(spark, sf):
    return polygons(spark, sf).select("l_orderkey", G.in_polygon(F.lit(25.0), F.lit(24.5), "poly").alias("inside"))


@query(SQL_POLY + """, s AS (SELECT l_orderkey, au, av, bu - au AS du, bv - av AS dv FROM e),
f AS (SELECT *, CASE WHEN du * du + dv * dv < 1e-12 THEN 0 ELSE greatest(0, least(1, ((25 - au) * du + (25 - av) * dv) / (du * du + dv * dv))) END AS t FROM s)
SELECT l_orderkey, round(min(sqrt((25 - (au + t * du)) * (25 - (au + t * du)) + (25 - (av + t * dv)) * (25 - (av + t * dv)))), 6) AS distance FROM f GROUP BY l_orderkey""")
def boundary_distance(spark, sf):
    return polygons(spark, sf).select("l_orderkey", F.round(G.distance_to_boundary(F.lit(25.0), F.lit(25.0), "poly"), 6).alias("distance"))


@query(SQL_POLY + "SELECT l_orderkey, min(au) AS u0, min(av) AS v0, max(au) AS u1, max(av) AS v1 FROM e GROUP BY l_orderkey")
def polygon_bounds(spark, sf):
    return polygons(spark, sf).select("l_orderkey", *(c.alias(n) for c, n in zip(G.bounds("poly"), ("u0", "v0", "u1", "v1"), strict=True)))


@query(SQL_POLY + "SELECT l_orderkey, sum((au BETWEEN 9.5 AND 30.5 AND av BETWEEN 4.5 AND 35.5)::INT)::DOUBLE / count(*) AS share FROM e GROUP BY l_orderkey")
def inside_share(spark, sf):
    box = [F.lit(x) for x in (10.0, 5.0, 30.0, 35.0)]
    return polygons(spark, sf).select("l_orderkey", G.inside_fraction("poly", *box, F.lit(0.5)).alias("share"))


@query(SQL_POLY + """, b AS (SELECT l_orderkey AS k, min(au) AS u0, min(av) AS v0, max(au) AS u1, max(av) AS v1 FROM e GROUP BY l_orderkey),
j AS (SELECT x.k, greatest(0, least(x.u1, y.u1) - greatest(x.u0, y.u0)) * greatest(0, least(x.v1, y.v1) - greatest(x.v0, y.v0)) AS i, (x.u1 - x.u0) * (x.v1 - x.v0) + (y.u1 - y.u0) * (y.v1 - y.v0) AS s FROM b x JOIN b y ON y.k = x.k + 1)
SELECT k, CASE WHEN s - i > 1e-6 THEN i / (s - i) ELSE 0 END AS iou FROM j""")
def box_overlap(spark, sf):
    """Overlap of each drawing's box with the next drawing's."""
    b = polygons(spark, sf).select(F.col("l_orderkey").alias("k"), *(c.alias(n) for c, n in zip(G.bounds("poly"), ("u0", "v0", "u1", "v1"), strict=True)))
    other = b.select((F.col("k") - 1).alias("k"), *(F.col(c).alias(f"o{c}") for c in ("u0", "v0", "u1", "v1")))
    both = b.join(other, "k")
    return both.select("k", G.rect_iou([F.col(c) for c in ("u0", "v0", "u1", "v1")], [F.col(f"o{c}") for c in ("u0", "v0", "u1", "v1")]).alias("iou"))


@query(SQL_POLY + "SELECT l_orderkey, min(-av + 3) AS u0, min(2 * au - 1) AS v0, max(-av + 3) AS u1, max(2 * au - 1) AS v1 FROM e GROUP BY l_orderkey")
def affine_drawing(spark, sf):
    """A quarter turn, stretched and shifted."""
    rows = polygons(spark, sf).select("l_orderkey", G.affine("poly", [[0.0, -1.0, 3.0], [2.0, 0.0, -1.0]]).alias("moved"))
    return rows.select("l_orderkey", *(c.alias(n) for c, n in zip(G.bounds("moved"), ("u0", "v0", "u1", "v1"), strict=True)))


def _bezier_sql(n: int) -> str:
    return SQL_POLY + f""", q AS (SELECT l_orderkey, p[1] AS a, p[2] AS b, p[3] AS c, p[4] AS d, unnest(range(0, {n + 1})) / {n}::DOUBLE AS t FROM d WHERE n >= 4),
z AS (SELECT l_orderkey, t, (1-t)^3 * a.u + 3 * (1-t)^2 * t * b.u + 3 * (1-t) * t^2 * c.u + t^3 * d.u AS u, (1-t)^3 * a.v + 3 * (1-t)^2 * t * b.v + 3 * (1-t) * t^2 * c.v + t^3 * d.v AS v FROM q),
s AS (SELECT l_orderkey, sqrt((u - lag(u) OVER w) ^ 2 + (v - lag(v) OVER w) ^ 2) AS l FROM z WINDOW w AS (PARTITION BY l_orderkey ORDER BY t))
SELECT l_orderkey, round(sum(l), 6) AS length FROM s GROUP BY l_orderkey"""


def _bezier(spark, sf, n: int) -> DataFrame:
    at = lambda k: F.get("poly", F.lit(k))
    rows = polygons(spark, sf).where(F.size("poly") >= 4).select("l_orderkey", *(at(k).alias(f"p{k}") for k in range(4)))
    return rows.select("l_orderkey", G.bezier("p0", "p1", "p2", "p3", n).alias("line")).select("l_orderkey", F.round(G.polyline_length("line"), 6).alias("length"))


@query(_bezier_sql(8))
def bezier_lengths(spark, sf):
    """Cubics through the first four points, flattened to eight segments."""
    return _bezier(spark, sf, 8)


@query(_bezier_sql(24))
def bezier_lengths_fine(spark, sf):
    """The same with 24 segments, as the extractor flattens."""
    return _bezier(spark, sf, 24)


@query(SQL_POLY + "SELECT l_orderkey, i, round(degrees(atan2(bv - av, bu - au)), 6) AS angle FROM e WHERE i < n")
def orientations(spark, sf):
    rows = polygons(spark, sf).select("l_orderkey", F.posexplode(G._pairs("poly", False)).alias("i", "x"))
    return rows.select("l_orderkey", (F.col("i") + 1).cast("long").alias("i"), F.round(G.orientation(F.col("x.a"), F.col("x.b")), 6).alias("angle"))


@query(SQL_POLY + """, b AS (SELECT l_orderkey, min(au) AS u0, min(av) AS v0, max(au) AS u1, max(av) AS v1 FROM e GROUP BY l_orderkey),
o AS (SELECT o_custkey AS g, o_orderkey AS k, o_orderstatus = 'F' AS f, b.* FROM orders JOIN b ON o_orderkey = l_orderkey)
SELECT r.g::VARCHAR AS section_id, r.k AS region, c.k AS curve FROM o r JOIN o c ON r.g = c.g AND r.f AND NOT c.f AND c.u1 >= r.u0 AND c.u0 <= r.u1 AND c.v1 >= r.v0 AND c.v0 <= r.v1""")
def box_candidates(spark, sf):
    """Finished orders' boxes with other orders' boxes of the same customer that they meet."""
    b = polygons(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), *(c.alias(n) for c, n in zip(G.bounds("poly"), ("u0", "v0", "u1", "v1"), strict=True)))
    rows = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("section_id"), (F.col("o_orderstatus") == "F").alias("f")).join(b, "o_orderkey")
    regions = rows.where("f").select("section_id", F.col("o_orderkey").alias("region"), F.col("u0").alias("x0"), F.col("v0").alias("y0"), F.col("u1").alias("x1"), F.col("v1").alias("y1"))
    return topology.region_candidates(regions, rows.where("not f").select("section_id", F.col("o_orderkey").alias("curve"), "u0", "v0", "u1", "v1"))


@query("""WITH nm AS (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY ALL), ty AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT p.p_partkey AS name, CASE WHEN a.n IS NOT NULL THEN CASE WHEN a.n = 1 THEN a.k END WHEN i.n = 1 THEN i.k END AS start, CASE WHEN j.n = 1 THEN j.k END AS "end"
FROM part p LEFT JOIN nm a ON a.p_brand = p.p_brand AND a.p_name = p.p_name AND p.p_size % 2 = 0 LEFT JOIN ty i ON i.p_brand = p.p_brand AND i.p_type = p.p_type LEFT JOIN ty j ON j.p_brand = p.p_brand AND j.p_type = p.p_type""")
def resolved_ends(spark, sf):
    """Ends by name, where there is one, else by id, within a brand; ambiguous ones are null. Every other part names its start wrongly."""
    part = t(spark, sf, "part")
    points = part.select(F.col("p_brand").alias("section_id"), F.col("p_name").alias("name"), F.col("p_type").alias("id"), F.col("p_partkey").alias("key"))
    name = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("?"), "p_name"))
    curves = part.select(F.col("p_brand").alias("section_id"), F.col("p_partkey").alias("name"), name.alias("start_name"), F.col("p_type").alias("start_id"), F.lit("?").alias("end_name"), F.col("p_type").alias("end_id"))
    return topology.resolve_ends(curves, points).select("name", "start", "end")


@query("""WITH RECURSIVE l AS (SELECT o_custkey::VARCHAR AS s, 'a' || (l_partkey % 7) AS a, 'b' || (l_suppkey % 7) AS b, l_quantity > 2 AS ok FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
e AS (SELECT DISTINCT s, a, b FROM l WHERE ok), y AS (SELECT s, a, b FROM e UNION SELECT s, b, a FROM e),
r(s, node, seen) AS (SELECT DISTINCT s, a, a FROM y UNION SELECT r.s, r.node, y.b FROM r JOIN y ON r.s = y.s AND r.seen = y.a),
k AS (SELECT s, node, min(seen) AS c FROM r GROUP BY s, node), kc AS (SELECT s, count(DISTINCT c) AS n_components FROM k GROUP BY s),
d AS (SELECT s, node, count(*) AS degree FROM (SELECT s, unnest([a, b]) AS node FROM l WHERE ok) GROUP BY s, node),
g AS (SELECT s, sum((degree > 2)::INT)::BIGINT AS n_branch, sum((degree = 1)::INT)::BIGINT AS n_end, min(degree) AS lo, max(degree) AS hi FROM d GROUP BY s),
z AS (SELECT s, count(*) AS n_curves, sum((NOT ok)::INT)::BIGINT AS n_invalid FROM l GROUP BY s),
f AS (SELECT z.s, n_curves, n_invalid, coalesce(n_branch, 0) AS n_branch, coalesce(n_end, 0) AS n_end, coalesce(n_components, 0) AS n_components, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM z LEFT JOIN g USING (s) LEFT JOIN kc USING (s)),
h AS (SELECT *, CASE WHEN n_branch > 0 THEN 'branched' WHEN n_end > 0 THEN 'open' WHEN n_curves - n_invalid > 0 THEN 'closed' ELSE 'unknown' END AS class FROM f)
SELECT s AS section_id, n_curves, n_invalid, n_branch, n_end, n_components, class, (CASE WHEN n_invalid > 0 THEN 'missing_endpoint' ELSE class END) || ':d' || lo || '-d' || hi || ':c' || n_components AS signature FROM h""")
def endpoint_signature(spark, sf):
    """Each customer's lines as curves between parts and suppliers: degrees, components, class and signature."""
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_quantity")
    rows = t(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    end = lambda x, c: F.concat(F.lit(x), (F.col(c) % 7).cast("string"))
    curves = rows.select(F.col("o_custkey").cast("string").alias("section_id"), end("a", "l_partkey").alias("start"), end("b", "l_suppkey").alias("end"), (F.col("l_quantity") > 2).alias("valid"))
    return topology.endpoint_topology(curves)


@query("""WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), r AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey + 1 AS l_orderkey, l_suppkey, true AS hit FROM lineitem)
SELECT o.l_orderkey, coalesce(bool_and(r.l_suppkey IS NULL OR b.hit IS NOT NULL), true) AS within FROM o JOIN o p ON p.l_orderkey + 1 = o.l_orderkey LEFT JOIN r ON r.l_orderkey = o.l_orderkey LEFT JOIN b ON b.l_orderkey = r.l_orderkey AND b.l_suppkey = r.l_suppkey GROUP BY o.l_orderkey""")
def subset_test(spark, sf):
    line = t(spark, sf, "lineitem")
    sets = line.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("all_s"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("returned"))
    before = sets.select((F.col("l_orderkey") + 1).alias("l_orderkey"), F.col("all_s").alias("before"))
    return sets.join(before, "l_orderkey").select("l_orderkey", S.is_subset(F.col("returned"), F.col("before")).alias("within"))


@query("""SELECT count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS median, min(o_totalprice) AS least FROM orders WHERE o_orderstatus = 'O'""")
def clearance_summary(spark, sf):
    rows = t(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "O", "ok").otherwise("gate").alias("reason"), F.col("o_totalprice").alias("clearance"))
    out = augment.clearance_figures(rows)
    return out.withColumn("median", F.round("median", 4))


@query("""WITH x AS (SELECT doc_id, source, md5(text) AS f, row_number() OVER (PARTITION BY md5(text) ORDER BY source NULLS FIRST, doc_id) AS r FROM documents) SELECT CASE WHEN r = 1 THEN 'ok' ELSE 'gate5_duplicate' END AS reason, count(*) AS n FROM x GROUP BY ALL""")
def settled_copies(spark, sf):
    """Of equal fingerprints the first stays; the reasons are counted."""
    tried = t(spark, sf, "documents").select(F.col("source").alias("section_id"), F.col("doc_id").alias("counter"), F.lit("ok").alias("reason"), F.md5("text").alias("fingerprint"))
    return augment.accounting(augment.settled(tried))


@query("""WITH c AS (SELECT c_custkey::VARCHAR AS section_id, c_nationkey AS family FROM customer), f AS (SELECT *, section_id IN ('1', '2', '3') AS fixed FROM c),
g AS (SELECT *, max(fixed) OVER (PARTITION BY family) AS seen, row_number() OVER (PARTITION BY family ORDER BY section_id) AS r FROM f)
SELECT section_id FROM g WHERE fixed OR (NOT seen AND r = 1) ORDER BY fixed DESC, section_id LIMIT 10""")
def pilot_sections(spark, sf):
    """The fixed ids, then one of each family that they lack; the limit is the pilot's size."""
    rows = t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("section_id"), F.col("c_nationkey").alias("family"))
    return augment.pilot(rows, ["1", "2", "3"], 10)


@query("""WITH e AS (SELECT user_id, max(CASE WHEN value > 30 THEN value END) AS v FROM events GROUP BY user_id) SELECT user_id % 5 AS bucket, coalesce(round(avg(v), 6), 0) AS mean_v, count(*) AS n FROM e GROUP BY bucket""")
def null_skipping_mean(spark, sf):
    """Means skip nulls; a group without values has 0."""
    rows = t(spark, sf, "events").groupBy("user_id").agg(F.max(F.when(F.col("value") > 30, F.col("value"))).alias("v")).withColumn("bucket", F.col("user_id") % 5)
    out = R.grouping_means(rows, [["bucket"]], ["v"])
    return out.select("bucket", F.round("mean_v", 6).alias("mean_v"), "n")
