"""Joins, ranks, aggregates and graph steps as DataFrame compositions.

Order is data here: every operator that picks "first" takes an explicit order, never the order of rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.scalar import position_rank


def arg_best(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in the order given. The rank-limit filter is pushed into a partial top-k by Spark."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[str], rank: str = "rank", size: str | None = None) -> DataFrame:
    """df with each row's place in its key's order, from 1, and the key's size, for keys of any size. order: columns, "-" before one that descends.

    Rows are range-partitioned by key and order, so that a key of a third of all rows lies on as many tasks as its share. A row's
    place is its place in its part plus the rows of the key's parts before; only parts are ever ordered whole.
    """
    cols = df.columns
    sort = [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_first() for c in order]
    parts = cut(df.repartitionByRange(*(F.col(c) for c in key), *sort).withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy(*key, "_p").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*key)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*key, "_p", before.alias("_before"), F.sum("_n").over(group).alias("_size"))
    here = F.row_number().over(Window.partitionBy(*key, "_p").orderBy(*sort))
    keys = [*key, "_p"]
    both = parts.withColumn("_r", here).alias("a").join(counts.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys])
    return both.select(*(F.col(f"a.{c}") for c in cols), (F.col("_r") + F.col("_before")).cast("long").alias(rank), *([F.col("_size").alias(size)] if size else []))


def with_position_rank(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    return ranked(df, key, order, "_r", "_n").withColumn(name, position_rank(F.col("_r"), F.col("_n"))).drop("_r", "_n")


def neighbours(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], sides: Sequence[str] = ("below", "above")) -> DataFrame:
    """df with ``below`` and ``above``, or one of them: structs of values of the rows before and after in the key's order, by an equal join on places for each."""
    rows = cut(ranked(df, key, order, "_r"))
    other = lambda step, name: rows.select(*(F.col(c).alias(f"_{c}") for c in key), (F.col("_r") + step).alias("_at"), F.struct(*values).alias(name))
    out = rows
    for name in sides:
        step = {"below": 1, "above": -1}[name]
        side = other(step, name)
        out = out.join(side, [*(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key), F.col("_r") == F.col("_at")], "left").drop("_at", *(f"_{c}" for c in key))
    return out.drop("_r")


def index_percentile(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Per key: p50 = sorted[n // 2] and p95 = sorted[int(n * 0.95) - 1], the last for n = 1: rows are picked, not interpolated."""
    rows = ranked(df.select(*key, value), key, [value], "_r", "_n")
    p95 = F.floor(F.col("_n") * 95 / 100)
    at = F.when(p95 < 1, F.col("_n")).otherwise(p95)
    return rows.groupBy(*key).agg(
        F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col(value))).alias("p50"),
        F.max(F.when(F.col("_r") == at, F.col(value))).alias("p95"),
        F.count("*").alias("n"),
    )


def resolve_unique(facts: DataFrame, dim: DataFrame, on: Sequence[str], key: str, as_: str) -> DataFrame:
    """Left join facts to the dimension's key by ``on``; an ambiguous match is null, never the first. The dimension is aggregated before the join."""
    one = dim.groupBy(*on).agg(F.count("*").alias("_n"), F.min(key).alias(as_))
    return facts.join(one, list(on), "left").withColumn(as_, F.when(F.col("_n") == 1, F.col(as_))).withColumn("n_matches", F.coalesce("_n", F.lit(0))).drop("_n")


def duplicates(df: DataFrame, key: Sequence[str], id_: str) -> DataFrame:
    """Keys that occur more than once, their number and least id."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows"), F.min(id_).alias("first_id")).where("n_rows > 1")


def with_group(df: DataFrame, key: Sequence[str], **aggregates: Column) -> DataFrame:
    """df with aggregates of its key's group: partial sums and a join back, where a window would gather the group in one task."""
    per = df.groupBy(*(F.col(c).alias(f"_k_{c}") for c in key)).agg(*(a.alias(n) for n, a in aggregates.items()))
    if not key:
        return df.crossJoin(F.broadcast(per))  # one row
    return df.join(per, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]).drop(*(f"_k_{c}" for c in key))


def standardise(df: DataFrame, value: str, key: Sequence[str] = (), name: str = "z", floor: float = 1e-9) -> DataFrame:
    """(value - mean) / population deviation; a deviation below the floor counts as 1."""
    out = with_group(df, key, _mean=F.avg(value), _std=F.stddev_pop(value))
    return out.withColumn(name, (F.col(value) - F.col("_mean")) / F.when(F.col("_std") < floor, F.lit(1.0)).otherwise(F.col("_std"))).drop("_mean", "_std")


def audit(pairs: DataFrame, key: Sequence[str], a: str, b: str, most: float = 0.1) -> DataFrame:
    """Per key the mean absolute difference of two columns, and whether it is more than ``most``."""
    mean = F.sum(F.abs(F.col(a) - F.col(b)).cast("decimal(28,6)")).cast("double") / F.count("*")
    return pairs.groupBy(*key).agg(mean.alias("mean_abs"), (mean > most).alias("unstable"))


def degrees(edges: DataFrame, a: str, b: str, key: Sequence[str] = ()) -> DataFrame:
    """Degree of every end, by key, with its role: branch (> 2), junction (2), endpoint (1). A loop counts twice."""
    ends = edges.select(*key, F.explode(F.array(a, b)).alias("node"))
    role = F.when(F.col("degree") > 2, "branch").when(F.col("degree") == 2, "junction").otherwise("endpoint")
    return ends.groupBy(*key, "node").agg(F.count("*").alias("degree")).withColumn("role", role)


#: Keys with so many edges have their components found by one fold over the list of them.
FEW_EDGES = 200


def graph_components(edges: DataFrame, a: str, b: str, key: Sequence[str] = (), max_rounds: int = 40, few: int = FEW_EDGES) -> DataFrame:
    """(key, node, component): the least node that is reachable.

    Keys with few edges hold them as a list, whose length is bounded, and are done at once; the others take part in rounds.
    """
    key = list(key)
    if not key:
        return _starred(edges, a, b, key, max_rounds)
    edges = edges.select(*key, a, b)
    sizes = edges.groupBy(*key).agg(F.count("*").alias("_n"), F.count_if(F.col(a).isNull() | F.col(b).isNull()).alias("_none"))
    small = sizes.where(f"_n <= {few} and _none = 0").select(*key)
    rest = cut(edges.join(small, key, "left_anti"))
    found = _folded(edges.join(small, key), a, b, key)
    return found if rest.isEmpty() else found.unionByName(_starred(rest, a, b, key, max_rounds))


def _folded(edges: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """graph_components of keys with few edges: each edge joins the sets of nodes that hold one of its ends."""
    lists = edges.groupBy(*key).agg(F.collect_set(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))).alias("_e"))
    none = F.slice(F.transform("_e", lambda e: F.array(e["a"], e["b"])), 1, 0)
    has = lambda c, e: F.array_contains(c, e["a"]) | F.array_contains(c, e["b"])
    joined = lambda s, e: F.array_union(F.array(e["a"], e["b"]), F.flatten(F.filter(s, lambda c: has(c, e))))
    sets = F.aggregate("_e", none, lambda s, e: F.concat(F.filter(s, lambda c: ~has(c, e)), F.array(joined(s, e))))
    one = lists.select(*key, F.explode(sets).alias("_c"))
    return one.select(*key, F.explode("_c").alias("node"), F.array_min("_c").alias("component"))


def _starred(edges: DataFrame, a: str, b: str, key: list[str], max_rounds: int) -> DataFrame:
    """graph_components by alternating large and small stars over edges that each round writes.

    Each round is an aggregation and an equi-join on edges; their number grows with the logarithm of a component's size.
    """
    nodes = edges.select(*key, F.explode(F.array(a, b)).alias("node")).distinct()
    links = edges.select(*key, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = cut(links)
    state = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*key, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, [*key, "u"]).where("v > u").select(*key, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(*key, "u").agg(F.min("v").alias("m"))
        joined = large.join(low, [*key, "u"])
        links = cut(joined.select(*key, "u", F.col("m").alias("v")).unionByName(joined.select(*key, F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        now = links.agg(F.count("*"), F.expr(f"bit_xor(xxhash64({', '.join([*key, 'u', 'v'])}))")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = links.select(*key, F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, [*key, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def descend(edges: DataFrame, roots: DataFrame, parent: str, child: str, key: Sequence[str] = (), max_depth: int = 30) -> tuple[DataFrame, DataFrame]:
    """((key, root, node, level, n_paths), (key, root, node)): what each root reaches at each level and by how many paths, and where its paths still go on after max_depth levels, as those of a cycle do.

    edges (key, parent, child): a row for each use, so equal rows are uses of their own. roots (key, root). Level by level: the nodes of one
    level meet the edges on the parent and paths are added up by root and child, so a level has a row for each node it holds, however many
    paths lead there. Edges are added up first, and levels are checkpointed.
    """
    key = list(key)
    uses = cut(edges.groupBy(*key, F.col(parent).alias("node"), F.col(child).alias("_c")).agg(F.count("*").alias("_n")))
    front = cut(roots.select(*key, "root", F.col("root").alias("node"), F.lit(1).cast("long").alias("n_paths")))
    found = front.withColumn("level", F.lit(0))
    for level in range(1, max_depth + 2):
        front = cut(front.join(uses, [*key, "node"]).groupBy(*key, "root", F.col("_c").alias("node")).agg(F.sum(F.col("n_paths") * F.col("_n")).alias("n_paths")))
        if level > max_depth or front.isEmpty():
            break
        found = found.unionByName(front.withColumn("level", F.lit(level)))
    return found.select(*key, "root", "node", "level", "n_paths"), front.select(*key, "root", "node")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the shared folder and read back, for tables that many branches or rounds read.

    A checkpoint would keep the size that Spark estimates for the plan before, which a join multiplies, so that rounds which join a table
    with itself get sizes of millions of digits; files have the size they have.
    """
    session = df.sparkSession
    path = f"{_shared_dir(session)}/spanwise-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)


def _shared_dir(session) -> str:
    """The folder that the session says; it is set only on one machine, as in tests."""
    sc = session.sparkContext
    at = session.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanwise-"))
        at = sc.getCheckpointDir()
    return at


def class_of(n_branch: Column, n_end: Column, n_edges: Column) -> Column:
    """open, closed or branched by the roles of a component's nodes."""
    return F.when(n_branch > 0, "branched").when(n_end > 0, "open").when(n_edges > 0, "closed").otherwise("unknown")


def quota_status(df: DataFrame, key: Sequence[str], quota: int) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).withColumn("met", F.col("n_rows") >= quota)


def grouping_means(df: DataFrame, sets: Sequence[Sequence[str]], values: Sequence[str]) -> DataFrame:
    """Means over several groupings at once, one scan and one shuffle; a null mean counts 0."""
    keys = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([list(s) for s in sets], *keys).agg(F.count("*").alias("n"), *(F.coalesce(F.avg(v), F.lit(0.0)).alias(f"mean_{v}") for v in values))
    return out


def source_weights(df: DataFrame, key: Sequence[str], name: str = "weight") -> DataFrame:
    """1 / size of the key's group: each source weighs 1 in all."""
    return with_group(df, key, _n=F.count("*")).withColumn(name, 1 / F.col("_n")).drop("_n")


def cooccurring(df: DataFrame, group: str, label: str) -> DataFrame:
    """Distinct pairs of labels a < b that share a group, with their number of groups. The labels of a group are few; rows are made distinct first."""
    one = df.select(group, label).distinct()
    other = one.select(group, F.col(label).alias("label_b"))
    pairs = one.withColumnRenamed(label, "label_a").join(other, group).where("label_a < label_b")
    return pairs.groupBy("label_a", "label_b").agg(F.count("*").alias("n_groups"))


def longest_alias(texts: DataFrame, text: str, aliases: DataFrame, key: Sequence[str]) -> DataFrame:
    """The longest alias (alias, label, ord) contained in each text, ties by ord; null where there is none.

    Aliases are a registry of a few hundred rows at most, so they are folded into one row and matched in place.
    """
    rows = aliases.orderBy(F.length("alias").desc(), "ord").select("alias", "label").limit(2001).collect()
    if len(rows) > 2000:
        raise ValueError("an alias registry of over 2000 rows needs a join by word, not this operator")
    alias, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rows):
        hit = F.contains(F.col(text), F.lit(r["alias"]))
        alias, label = F.when(hit, r["alias"]).otherwise(alias), F.when(hit, r["label"]).otherwise(label)
    return texts.select(*key, alias.alias("alias"), label.alias("label"))


def leave_one_out(df: DataFrame, family: str, value: str) -> DataFrame:
    """Per family: its mean and the mean of all others, from one grouped sum rather than a cross join."""
    per = df.groupBy(family).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(38,4)")).alias("s"))
    rows = per.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    joined = per.crossJoin(F.broadcast(rows))  # one row
    return joined.select(
        family, "n", (F.col("s").cast("double") / F.col("n")).alias("own_mean"),
        ((F.col("all_s") - F.col("s")).cast("double") / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))).alias("others_mean"),
    )
