"""Pattern queries over the driver's tables. Each has a DataFrame form here and DuckDB SQL of the same rows.

Sums of doubles are taken as decimals, so that no engine's order of addition shows in the last digit.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwise.functions import scalar as S
from spanwise.operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(c: str):
    return F.sum(F.col(c).cast("decimal(18,4)"))


@query("""SELECT text_hash, count(*) AS n_rows, min(doc_id) AS first_id FROM (SELECT md5(text) AS text_hash, doc_id FROM documents) GROUP BY text_hash HAVING count(*) > 1""")
def duplicate_diagnostics(spark, sf):
    docs = t(spark, sf, "documents").select(F.md5("text").alias("text_hash"), "doc_id")
    return R.duplicates(docs, ["text_hash"], "doc_id")


@query("""WITH one AS (SELECT p_name, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY p_name)
SELECT p.p_partkey, p.p_name, CASE WHEN n = 1 THEN k END AS resolved, n AS n_matches FROM part p LEFT JOIN one USING (p_name)""")
def ambiguous_name_lookup(spark, sf):
    part = t(spark, sf, "part")
    return R.resolve_unique(part.select("p_partkey", "p_name"), part, ["p_name"], "p_partkey", "resolved").select("p_partkey", "p_name", "resolved", "n_matches")


@query("""WITH one AS (SELECT p_name, p_brand, p_size, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY ALL)
SELECT p.p_partkey, CASE WHEN n = 1 THEN k END AS resolved, n AS n_matches FROM part p LEFT JOIN one USING (p_name, p_brand, p_size)""")
def composite_name_lookup(spark, sf):
    part = t(spark, sf, "part")
    on = ["p_name", "p_brand", "p_size"]
    return R.resolve_unique(part.select("p_partkey", *on), part, on, "p_partkey", "resolved").select("p_partkey", "resolved", "n_matches")


@query("""WITH b AS (SELECT p_partkey, p_brand, p_size AS lo, p_size + 4 AS hi FROM part)
SELECT b.p_partkey, b.p_brand, count(*) AS n_lines, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS quantity FROM lineitem JOIN b ON l_partkey = p_partkey AND l_quantity + 2 >= lo AND l_quantity - 2 <= hi GROUP BY ALL""")
def theta_overlap(spark, sf):
    """Overlapping ranges with an equi key: a hash join with a residual predicate."""
    part = t(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").alias("lo"), (F.col("p_size") + 4).alias("hi"))
    line = t(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    hit = line.join(part, (F.col("l_partkey") == F.col("p_partkey")) & S.overlaps(F.col("l_quantity") - 2, F.col("l_quantity") + 2, F.col("lo"), F.col("hi")))
    return hit.groupBy("p_partkey", "p_brand").agg(F.count("*").alias("n_lines"), exact("l_quantity").cast("double").alias("quantity"))


@query("""SELECT n_name, s_suppkey, s_acctbal FROM (SELECT n_name, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE r = 1""")
def arg_max_supplier(spark, sf):
    best = R.arg_best(t(spark, sf, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")])
    return best.join(t(spark, sf, "nation"), best["s_nationkey"] == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_acctbal")


@query("""WITH w AS (SELECT p_partkey, p_brand, p_retailprice,
 lag(struct_pack(p := p_retailprice, k := p_partkey)) OVER o AS below, lead(struct_pack(p := p_retailprice, k := p_partkey)) OVER o AS above FROM part WINDOW o AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)),
d AS (SELECT p_partkey, below.k AS bk, above.k AS ak, p_retailprice::DECIMAL(18,4) - below.p::DECIMAL(18,4) AS bd, above.p::DECIMAL(18,4) - p_retailprice::DECIMAL(18,4) AS ad FROM w)
SELECT p_partkey, CASE WHEN bk IS NULL THEN ak WHEN ak IS NULL THEN bk WHEN bd < ad OR (bd = ad AND bk < ak) THEN bk ELSE ak END AS nearest,
 CASE WHEN bk IS NULL THEN ad WHEN ak IS NULL THEN bd ELSE least(bd, ad) END::DOUBLE AS distance FROM d""")
def nearest_part(spark, sf):
    """Nearest price in the same brand: the two neighbours in order, not all pairs of the brand."""
    rows = t(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_retailprice").cast("decimal(18,4)").alias("p"))
    w = R.neighbours(rows, ["p_brand"], ["p", "p_partkey"], ["p_partkey", "p"])
    w = w.select("p_partkey", F.col("below.p_partkey").alias("bk"), F.col("above.p_partkey").alias("ak"), (F.col("p") - F.col("below.p")).alias("bd"), (F.col("above.p") - F.col("p")).alias("ad"))
    below = F.col("ak").isNull() | (F.col("bk").isNotNull() & ((F.col("bd") < F.col("ad")) | ((F.col("bd") == F.col("ad")) & (F.col("bk") < F.col("ak")))))
    return w.select("p_partkey", F.when(below, F.col("bk")).otherwise(F.col("ak")).alias("nearest"), F.least("bd", "ad").cast("double").alias("distance"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def anti_customers(spark, sf):
    orders = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT p_brand, count(*) AS n_parts FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY p_brand""")
def semi_parts(spark, sf):
    used = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, sf, "part").join(used, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count("*").alias("n_parts"))


@query("""WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey ),
n AS (SELECT unnest([a, b]) AS node FROM e)
SELECT node, count(*) AS degree, CASE WHEN count(*) > 2 THEN 'branch' WHEN count(*) = 2 THEN 'junction' ELSE 'endpoint' END AS role FROM n GROUP BY node""")
def degree_roles(spark, sf):
    return _degree_roles(t(spark, sf, "orders"), t(spark, sf, "lineitem"))


def _degree_roles(orders, lines):
    line = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    pairs = orders.join(line, "o_orderkey")
    edges = pairs.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")).distinct()
    return R.degrees(edges, "a", "b")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, (s_suppkey * 7 + 3) % 1000 AS b FROM supplier),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, seen) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.seen = s.a)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def components(spark, sf):
    return _components(t(spark, sf, "supplier"))


def _components(suppliers):
    edges = suppliers.select(F.col("s_suppkey").alias("a"), ((F.col("s_suppkey") * 7 + 3) % 1000).alias("b")).distinct()
    return R.graph_components(edges, "a", "b")


@query("""WITH e AS (SELECT o_custkey % 40 AS g, o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
d AS (SELECT g, node, count(*) AS degree FROM (SELECT g, unnest([a, -1 - b]) AS node FROM e) GROUP BY ALL),
c AS (SELECT g, count(*) AS n_edges FROM e GROUP BY g)
SELECT g, n_edges, sum((degree > 2)::INT)::BIGINT AS n_branch, sum((degree = 1)::INT)::BIGINT AS n_end,
 CASE WHEN sum((degree > 2)::INT) > 0 THEN 'branched' WHEN sum((degree = 1)::INT) > 0 THEN 'open' WHEN n_edges > 0 THEN 'closed' ELSE 'unknown' END AS class FROM d JOIN c USING (g) GROUP BY g, n_edges""")
def topology_class(spark, sf):
    return _topology_class(t(spark, sf, "orders"), t(spark, sf, "lineitem"))


def _topology_class(orders, lines):
    line = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    edges = orders.join(line, "o_orderkey").select((F.col("o_custkey") % 40).alias("g"), F.col("o_custkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b"))
    nodes = R.degrees(edges, "a", "b", ["g"]).groupBy("g").agg(F.sum((F.col("degree") > 2).cast("long")).alias("n_branch"), F.sum((F.col("degree") == 1).cast("long")).alias("n_end"))
    sizes = edges.groupBy("g").agg(F.count("*").alias("n_edges"))
    return nodes.join(sizes, "g").select("g", "n_edges", "n_branch", "n_end", R.class_of(F.col("n_branch"), F.col("n_end"), F.col("n_edges")).alias("class"))


@query("""SELECT l_suppkey, (sum(l_extendedprice::DECIMAL(18,4) * l_quantity::DECIMAL(10,2))::DOUBLE / sum(l_quantity::DECIMAL(18,4))::DOUBLE) AS centroid FROM lineitem GROUP BY l_suppkey""")
def weighted_centroid(spark, sf):
    weight = F.sum(F.col("l_extendedprice").cast("decimal(18,4)") * F.col("l_quantity").cast("decimal(10,2)"))
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg((weight.cast("double") / exact("l_quantity").cast("double")).alias("centroid"))


@query("""SELECT c_custkey, c_nationkey, CASE WHEN n > 1 THEN (r - 1)::DOUBLE / (n - 1) ELSE 0.5 END AS rank FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""")
def rank_position(spark, sf):
    ranked = R.with_position_rank(t(spark, sf, "customer"), ["c_nationkey"], ["c_acctbal", "c_custkey"], "rank")
    return ranked.select("c_custkey", "c_nationkey", "rank")


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, v[n // 2 + 1] AS p50, v[CASE WHEN n * 95 // 100 < 1 THEN n ELSE n * 95 // 100 END] AS p95, n FROM s""")
def percentile_by_index(spark, sf):
    return R.index_percentile(t(spark, sf, "events"), ["event_type"], "value")


@query("""SELECT r_name, c_mktsegment, o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,4))::DOUBLE / count(*) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY GROUPING SETS ((), (r_name), (c_mktsegment), (o_orderpriority))""")
def grouping_summary(spark, sf):
    """All groupings in one pass."""
    geo = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    cust = t(spark, sf, "customer").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "c_mktsegment")  # 25 nations
    rows = t(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("r_name", "c_mktsegment", "o_orderpriority", "o_totalprice")
    keys = ["r_name", "c_mktsegment", "o_orderpriority"]
    return rows.groupingSets([[], *([k] for k in keys)], *keys).agg(F.count("*").alias("n"), (exact("o_totalprice").cast("double") / F.count("*")).alias("mean_price"))


@query("""WITH x AS (SELECT lang, quality = 1 AS gold, n_chars > 200 AS pred FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, sum((gold AND pred)::INT)::DOUBLE AS tp, sum(gold::INT)::DOUBLE AS g, sum(pred::INT)::DOUBLE AS p FROM x GROUP BY lang),
m AS (SELECT lang, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS precision, CASE WHEN g = 0 THEN 0 ELSE tp / g END AS recall, CASE WHEN g + p - tp = 0 THEN 0 ELSE tp / (g + p - tp) END AS jaccard FROM c)
SELECT lang, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, jaccard FROM m""")
def rule_metrics(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 200).alias("pred")).join(t(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("gold")), "doc_id")
    n = lambda c: F.sum(c.cast("int")).cast("double")
    c = rows.groupBy("lang").agg(n(F.col("gold") & F.col("pred")).alias("tp"), n(F.col("gold")).alias("g"), n(F.col("pred")).alias("p"))
    m = c.select("lang", S.ratio(F.col("tp"), F.col("p")).alias("precision"), S.ratio(F.col("tp"), F.col("g")).alias("recall"), S.ratio(F.col("tp"), F.col("g") + F.col("p") - F.col("tp")).alias("jaccard"))
    f1 = S.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return m.select("lang", "precision", "recall", f1.alias("f1"), "jaccard")


@query("""WITH s AS (SELECT o_custkey AS k, list(DISTINCT l_suppkey) AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey),
p AS (SELECT s.k, s.a AS gold, n.a AS pred FROM s JOIN s n ON n.k = s.k + 1),
c AS (SELECT k, len(list_intersect(gold, pred))::DOUBLE AS b, len(gold) AS g, len(pred) AS p FROM p)
SELECT k, CASE WHEN p = 0 THEN 0 ELSE b / p END AS precision, CASE WHEN g = 0 THEN 0 ELSE b / g END AS recall, CASE WHEN g + p - b = 0 THEN 0 ELSE b / (g + p - b) END AS jaccard, (b = g AND b = p AND b > 0) AS exact FROM c""")
def set_jaccard(spark, sf):
    line = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    sets = t(spark, sf, "orders").join(line, "o_orderkey").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("l_suppkey").alias("gold"))
    both = sets.join(sets.select((F.col("k") - 1).alias("k"), F.col("gold").alias("pred")), "k")
    m = S.set_measures(F.col("gold"), F.col("pred"))
    return both.select("k", *(m[x].alias(x) for x in ("precision", "recall", "jaccard", "exact")))


@query("""WITH g AS (SELECT o_custkey AS k, l_suppkey AS s, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
r AS (SELECT k, s, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, s) AS rk FROM g),
gold AS (SELECT o_custkey AS k, list(DISTINCT l_suppkey) AS gold FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY o_custkey),
top AS (SELECT k, list(s) AS top FROM r WHERE rk <= 20 GROUP BY k)
SELECT k, len(list_intersect(gold, top))::DOUBLE / len(gold) AS recall_at_20 FROM gold JOIN top USING (k)""")
def recall_at_k(spark, sf):
    line = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag")
    rows = t(spark, sf, "orders").join(line, "o_orderkey").select(F.col("o_custkey").alias("k"), F.col("l_suppkey").alias("s"), "l_returnflag")
    counts = rows.groupBy("k", "s").agg(F.count("*").alias("n"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("hit"))
    gold = counts.groupBy("k").agg(F.collect_list(F.when(F.col("hit") == 1, F.col("s"))).alias("gold")).where(F.size("gold") > 0)
    top = R.arg_best(counts, ["k"], [F.desc("n"), F.asc("s")], 20).groupBy("k").agg(F.collect_list("s").alias("top"))
    return gold.join(top, "k").select("k", S.recall_at(F.col("gold"), F.col("top"), 20).alias("recall_at_20"))


@query("""SELECT doc_id, h AS text_hash, copies FROM (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents) WHERE r = 1""")
def first_wins(spark, sf):
    """First of each fingerprint: an aggregation, as a window would shuffle every row."""
    return t(spark, sf, "documents").groupBy(F.md5("text").alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "text_hash", "copies")


@query("""SELECT doc_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY md5(text)) AS weight FROM documents""")
def source_weight(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return R.source_weights(rows, ["h"]).select("doc_id", "weight")


@query("""SELECT event_type, user_id % 10 AS bucket, count(*) AS n_rows, count(*) >= 200 AS met FROM events GROUP BY ALL""")
def quota(spark, sf):
    return R.quota_status(t(spark, sf, "events").select("event_type", (F.col("user_id") % 10).alias("bucket")), ["event_type", "bucket"], 200)


@query("""WITH d AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS label_a, b.event_type AS label_b, count(*) AS n_groups FROM d a JOIN d b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""")
def label_pairs(spark, sf):
    return R.cooccurring(t(spark, sf, "events"), "user_id", "event_type")


@query("""SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '(\\d+)$', 1), '') AS INT) AS brand_no, CASE WHEN regexp_matches(p_name, '_[a-h]$') THEN ascii(right(p_name, 1)) - 96 END AS ordinal, nullif(regexp_extract(p_type, '^(\\w+)', 1), '') AS head FROM part""")
def selector_regex(spark, sf):
    head = F.nullif(F.regexp_extract("p_type", r"^(\w+)", 1), F.lit(""))
    letter = F.regexp_extract("p_name", r"_([a-h])$", 1)
    return t(spark, sf, "part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)$", 1).try_cast("int").alias("brand_no"), F.when(letter != "", F.ascii(letter) - 96).alias("ordinal"), head.alias("head"))


ALIASES = [("BRASS", "metal"), ("STEEL", "metal"), ("ECONOMY", "class"), ("ECONOMY ANODIZED", "finish"), ("STANDARD", "class"), ("PROMO", "class"), ("TIN", "metal"), ("A", "letter")]


@query("WITH a(alias, label, ord) AS (VALUES " + ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(ALIASES)) + """)
SELECT p_partkey, alias, label FROM (SELECT p_partkey, alias, label, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, ord) AS r FROM part LEFT JOIN a ON contains(p_type, alias)) WHERE r = 1""")
def alias_match(spark, sf):
    aliases = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(ALIASES)], "alias string, label string, ord int")
    return R.longest_alias(t(spark, sf, "part"), "p_type", aliases, ["p_partkey"])


@query("""SELECT c_custkey, 1 / (1 + exp(-greatest(-30.0, least(30.0, -1.0 + c_acctbal / 2500 + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.8 ELSE -0.2 END)))) AS score FROM customer""")
def rule_score(spark, sf):
    z = -1.0 + F.col("c_acctbal") / 2500 + F.when(F.col("c_mktsegment") == "BUILDING", 0.8).otherwise(-0.2)
    return t(spark, sf, "customer").select("c_custkey", S.sigmoid(z).alias("score"))


@query("""WITH m AS (SELECT c_mktsegment, count(*) AS n, sum(c_acctbal::DECIMAL(18,4))::DOUBLE AS s, sum(c_acctbal::DECIMAL(18,2) * c_acctbal::DECIMAL(18,2))::DOUBLE AS q FROM customer GROUP BY c_mktsegment)
SELECT c_custkey, round((c_acctbal - s / n) / sqrt(q / n - (s / n) * (s / n)), 6) AS z FROM customer JOIN m USING (c_mktsegment)""")
def standardised(spark, sf):
    z = R.standardise(t(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])
    return z.select("c_custkey", F.round("z", 6).alias("z"))


@query("""SELECT decision, count(*) AS n FROM (SELECT CASE WHEN s >= 0.75 AND NOT f THEN 'resolved' WHEN s >= 0.4 THEN 'needs_confirmation' ELSE 'not_found' END AS decision FROM (SELECT greatest(0, least(1, c_acctbal / 10000)) AS s, c_nationkey % 5 = 0 AS f FROM customer)) GROUP BY decision""")
def decisions(spark, sf):
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000))
    return t(spark, sf, "customer").select(S.decision(score, F.col("c_nationkey") % 5 == 0).alias("decision")).groupBy("decision").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT s_nationkey, s_suppkey, s_acctbal, min(s_acctbal) OVER (PARTITION BY s_nationkey) AS lo, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS hi FROM supplier),
near AS (SELECT * FROM a WHERE hi = lo OR (s_acctbal - lo) / (hi - lo) <= 0.6),
o AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS pos FROM near)
SELECT s_nationkey, s_suppkey, pos FROM o WHERE pos <= 2""")
def instance_chain(spark, sf):
    """Position, then ordinal, then count, each over what the one before has left."""
    near = R.with_group(t(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], lo=F.min("s_acctbal"), hi=F.max("s_acctbal"))
    near = near.where("hi = lo or (s_acctbal - lo) / (hi - lo) <= 0.6")
    return R.arg_best(near, ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 2, "pos").select("s_nationkey", "s_suppkey", "pos")


@query("""WITH f AS (SELECT n_regionkey AS family, c_acctbal AS v FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT r.r_regionkey AS family, (SELECT count(*) FROM f WHERE family = r.r_regionkey) AS n, (SELECT sum(v::DECIMAL(38,4))::DOUBLE / count(*) FROM f WHERE family = r.r_regionkey) AS own_mean, (SELECT sum(v::DECIMAL(38,4))::DOUBLE / count(*) FROM f WHERE family <> r.r_regionkey) AS others_mean FROM region r WHERE r.r_regionkey IN (SELECT family FROM f)""")
def leave_one_family_out(spark, sf):
    rows = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("family"), "c_acctbal")
    return R.leave_one_out(rows, "family", "c_acctbal")


@query("""SELECT l_orderkey, sum(abs(l_quantity - p_size)::DECIMAL(18,4))::DOUBLE / count(*) AS mean_abs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def lineage_difference(spark, sf):
    """An order holds a map from its lines to parts, as a section maps curves to their children; the map is exploded and joined with what the children score."""
    line = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    # Line numbers repeat within an order, so a line is named by its place.
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    parents = line.groupBy("l_orderkey").agg(F.map_from_entries(F.transform(lines, lambda x, i: F.struct(i, F.struct(x["l_partkey"], x["l_quantity"])))).alias("name_map"))
    kids = parents.select("l_orderkey", F.explode("name_map").alias("name", "child")).select("l_orderkey", "child.*")
    both = kids.join(t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    return both.groupBy("l_orderkey").agg((F.sum(F.abs(F.col("l_quantity") - F.col("p_size")).cast("decimal(18,4)")).cast("double") / F.count("*")).alias("mean_abs"))


@query("""SELECT l_orderkey, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS total, sum(l_linenumber)::BIGINT AS n_pieces FROM lineitem GROUP BY l_orderkey""")
def split_preserving_total(spark, sf):
    """Each line is cut into as many pieces as its number; the sum stays."""
    line = t(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber", F.explode(F.sequence(F.lit(1), "l_linenumber")).alias("piece"))
    exact_q = F.col("l_quantity").cast("decimal(18,4)")
    even = F.round(exact_q / F.col("l_linenumber"), 4).cast("decimal(18,4)")
    piece = F.when(F.col("piece") < F.col("l_linenumber"), even).otherwise(exact_q - even * (F.col("l_linenumber") - 1))
    return line.select("l_orderkey", piece.alias("q")).groupBy("l_orderkey").agg(F.sum("q").cast("double").alias("total"), F.count("*").alias("n_pieces"))


@query("""WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), r AS (SELECT label, -y * 2 AS u, x * 0.5 AS v FROM p)
SELECT label, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, count(*) AS n FROM r GROUP BY label""")
def affine_bbox(spark, sf):
    """Rotate by 90 degrees, scale, and bound."""
    p = t(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    r = p.select("label", (-F.col("y") * 2).alias("u"), (F.col("x") * 0.5).alias("v"))
    return r.groupBy("label").agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.count("*").alias("n"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT (l_quantity >= 3) THEN 'quantity' WHEN NOT (l_discount <= 0.08) THEN 'discount' WHEN NOT (l_returnflag <> 'R') THEN 'returned' WHEN NOT (l_tax >= 0.01) THEN 'tax' END AS reason FROM lineitem) GROUP BY reason""")
def gate_reasons(spark, sf):
    gates = [("quantity", F.col("l_quantity") >= 3), ("discount", F.col("l_discount") <= 0.08), ("returned", F.col("l_returnflag") != "R"), ("tax", F.col("l_tax") >= 0.01)]
    return t(spark, sf, "lineitem").select(S.first_failure(gates).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT 'orphan_lines' AS check_name, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n
UNION ALL SELECT 'duplicate_line_keys', (SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber))
UNION ALL SELECT 'orders_without_lines', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
UNION ALL SELECT 'length_mismatches', (SELECT count(*) FROM documents WHERE length(text) IS DISTINCT FROM n_chars)""")
def integrity_audit(spark, sf):
    line, orders = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    one = lambda df, name, n=F.count("*"): df.agg(F.lit(name).alias("check_name"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    keys = line.groupBy("l_orderkey", "l_linenumber").agg((F.count("*") - 1).alias("c"))
    # The tables hold no hash of a text, but its length when it was written.
    docs = t(spark, sf, "documents").where(~F.length("text").eqNullSafe(F.col("n_chars")))
    parts = [one(line.join(orders, "l_orderkey", "left_anti"), "orphan_lines"), one(keys, "duplicate_line_keys", F.sum("c")), one(orders.join(line, "l_orderkey", "left_anti"), "orders_without_lines"), one(docs, "length_mismatches")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH v AS (SELECT l_quantity AS q, p_size AS q2, l_discount AS d, l_tax AS d2 FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT feature, (sum(diff::DECIMAL(28,6))::DOUBLE / count(*)) AS mean_abs, sum(diff::DECIMAL(28,6))::DOUBLE / count(*) > 0.1 AS unstable FROM (SELECT unnest(['quantity', 'discount']) AS feature, unnest([abs(q - q2), abs(d - d2)]) AS diff FROM v) GROUP BY feature""")
def feature_audit(spark, sf):
    part = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    line = t(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_discount", "l_tax").join(part, "l_partkey")
    pair = lambda name, a, b: F.struct(F.lit(name).alias("feature"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    return R.audit(line.select(F.explode(F.array(pair("quantity", "l_quantity", "p_size"), pair("discount", "l_discount", "l_tax"))).alias("x")).select("x.*"), ["feature"], "a", "b")


@query("""SELECT n_name, o_orderkey, o_totalprice, rk FROM (SELECT n_name, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE rk <= 5""")
def top_k_candidates(spark, sf):
    cust = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = t(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("n_name", "o_orderkey", "o_totalprice")
    return R.arg_best(rows, ["n_name"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5, "rk")


@query("""WITH c AS (SELECT user_id AS k, event_type AS mode_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY user_id, event_type) SELECT k, mode_type, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def majority_first_seen(spark, sf):
    """The most frequent value, ties by first occurrence."""
    counts = t(spark, sf, "events").groupBy(F.col("user_id").alias("k"), F.col("event_type").alias("mode_type")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return R.arg_best(counts, ["k"], [F.desc("n"), F.asc("first")]).drop("first")


@query("""SELECT user_id, event_type, pos FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS pos FROM events GROUP BY user_id, event_type)""")
def first_seen_distinct(spark, sf):
    first = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).alias("pos"))


@query("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey) AS ordinal FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 2)""")
def renumbered(spark, sf):
    """Ordinals top to bottom, then left to right, in groups of two or more only."""
    rows = R.ranked(t(spark, sf, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), ["p_brand"], ["-p_size", "p_retailprice", "p_partkey"], "ordinal", "n")
    return rows.where("n >= 2").select("p_brand", "p_partkey", "ordinal")


@query("""WITH o AS (SELECT user_id, event_id, value > 50 AS up FROM events), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, up ORDER BY event_id) AS island FROM o)
SELECT user_id, up, island, min(event_id) AS first_id, count(*) AS n FROM g GROUP BY ALL""")
def gaps_and_islands(spark, sf):
    o = t(spark, sf, "events").select("user_id", "event_id", (F.col("value") > 50).alias("up"))
    island = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - F.row_number().over(Window.partitionBy("user_id", "up").orderBy("event_id"))
    return o.withColumn("island", island).groupBy("user_id", "up", "island").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


@query("""(SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') EXCEPT (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N')""")
def set_difference(spark, sf):
    line = t(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    a, n = (line.where(F.col("l_returnflag") == x).select("l_suppkey", "l_partkey") for x in "AN")
    return a.subtract(n)


@query("""SELECT c_custkey AS k, 'customer' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier""")
def union_by_name(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("bal"))
    return c.unionByName(t(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")))


@query("""SELECT DISTINCT c_mktsegment AS family, md5(c_mktsegment) AS md5_hex, sha256(c_mktsegment) AS sha256_hex FROM customer""")
def distinct_families(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_mktsegment").alias("family")).distinct().select("family", F.md5("family").alias("md5_hex"), F.sha2("family", 256).alias("sha256_hex"))


@query("""WITH s AS (SELECT o_custkey, list(struct_pack(d := o_orderkey, p := o_totalprice) ORDER BY o_orderkey) AS pts FROM orders GROUP BY o_custkey)
SELECT o_custkey, (list_sum([(pts[i].p::DECIMAL(18,4) * pts[i % len(pts) + 1].d - pts[i % len(pts) + 1].p::DECIMAL(18,4) * pts[i].d)::DECIMAL(38,4) FOR i IN range(1, len(pts) + 1)]))::DOUBLE / 2 AS area FROM s""")
def shoelace_area(spark, sf):
    """Signed area of each customer's orders as a polygon, from neighbours in order; sums are exact decimals."""
    part = Window.partitionBy("o_custkey")
    o = part.orderBy("o_orderkey")
    rows = t(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("d"), F.col("o_totalprice").cast("decimal(18,4)").alias("p"), F.lead("o_orderkey").over(o).alias("nd"), F.lead(F.col("o_totalprice").cast("decimal(18,4)")).over(o).alias("np"), F.first("o_orderkey").over(o).alias("fd"), F.first(F.col("o_totalprice").cast("decimal(18,4)")).over(o).alias("fp"))
    d, p = F.coalesce("nd", "fd").cast("decimal(18,0)"), F.coalesce("np", "fp")
    return rows.groupBy("o_custkey").agg((F.sum(F.col("p") * d - p * F.col("d").cast("decimal(18,0)")).cast("double") / 2).alias("area"))


@query("""SELECT event_id, event_type, TRY_CAST(props->>'$.k' AS VARCHAR) AS k, TRY_CAST(json_extract_string(props, '$.v') AS BIGINT) AS v FROM events""")
def json_props(spark, sf):
    return t(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.v").try_cast("long").alias("v"))


@query()
def fuzzy_names(spark, sf):
    """Closest of the known type names for each part name, by Ratcliff-Obershelp; no SQL has that ratio."""
    known = sorted(a.lower() for a, _ in ALIASES if len(a) > 1)

    @F.pandas_udf("struct<alias: string, ratio: double>")
    def closest(names: pd.Series) -> pd.DataFrame:
        best = [max(((difflib.SequenceMatcher(None, n.lower(), a).ratio(), a) for a in known), key=lambda x: (x[0], x[1])) for n in names]
        return pd.DataFrame({"alias": [a for _, a in best], "ratio": [r for r, _ in best]})

    return t(spark, sf, "part").select("p_name").distinct().select("p_name", closest("p_name").alias("m")).select("p_name", "m.alias", "m.ratio")


@query()
def hull_per_label(spark, sf):
    """Convex hull of the first two coordinates per label: partial hulls per part first, so no group is gathered whole."""
    from spanwise.functions.geometry import area_of, hull

    def shrink(key, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], u, v) for u, v in hull(list(zip(group["u"], group["v"], strict=True)))], columns=["label", "u", "v"])

    def measure(key, group: pd.DataFrame) -> pd.DataFrame:
        h = hull(list(zip(group["u"], group["v"], strict=True)))
        return pd.DataFrame([(key[0], len(h), area_of(h))], columns=["label", "n_corners", "area"])

    points = t(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("u"), F.col("embedding")[1].cast("double").alias("v"))
    parts = points.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).groupBy("label", "part").applyInPandas(shrink, "label int, u double, v double")
    return parts.groupBy("label").applyInPandas(measure, "label int, n_corners int, area double")
