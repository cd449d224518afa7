"""Cycles of a permutation, and the faces of a drawing as the cycles of its half-edges: joins and windows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.operators.relational import cut


def cycles(successor: DataFrame, id_: str = "id", next_: str = "next", key: Sequence[str] = (), max_rounds: int = 60) -> DataFrame:
    """(key, id, cycle, place, size): the least id of each row's cycle, its place from there on, from 0, and the cycle's size.

    Pointer jumping: in each round a row knows the least id among twice as many rows from itself on, and how far ahead it is, so
    the rounds grow with the logarithm of the longest cycle. Rounds are equal joins on ids, whose rows are as many as the table's, whatever the
    cycles; each is cut off from those before. The table must be a permutation of the ids of each key.
    """
    key = list(key)
    links = cut(successor.select(*key, F.col(id_).alias("id"), F.col(next_).alias("next")))
    odd = links.groupBy(*key, F.col("next").alias("id")).agg(F.count("*").alias("_in")).join(links.groupBy(*key, "id").agg(F.count("*").alias("_out")), [*key, "id"], "full_outer").where("_in is null or _out is null or _in <> 1 or _out <> 1")
    if not odd.isEmpty():
        raise ValueError("not a permutation: an id has no single successor and predecessor")
    # far: the row after the span of 2 ** round rows from id on; least: the least id of the span; ahead: how far it is.
    state, span = links.select(*key, "id", F.col("next").alias("far"), F.col("id").alias("least"), F.lit(0).cast("long").alias("ahead")), 1
    for _ in range(max_rounds):
        then = state.select(*key, F.col("id").alias("far"), F.col("far").alias("_far"), F.col("least").alias("_least"), F.col("ahead").alias("_ahead"))
        moved = F.col("_least") < F.col("least")
        new = state.join(then, [*key, "far"]).select(*key, "id", F.col("_far").alias("far"), F.least("least", "_least").alias("least"), F.when(moved, F.col("_ahead") + span).otherwise(F.col("ahead")).alias("ahead"), moved.alias("moved"))
        new, span = cut(new), span * 2
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"cycles did not settle in {max_rounds} rounds")
    size = state.groupBy(*key, F.col("least").alias("cycle")).agg((F.max("ahead") + 1).alias("size"))
    rows = state.select(*key, "id", F.col("least").alias("cycle"), "ahead").join(size, [*key, "cycle"])
    return rows.select(*key, "id", "cycle", F.when(F.col("ahead") == 0, 0).otherwise(F.col("size") - F.col("ahead")).alias("place"), "size")


def half_edges(edges: DataFrame, nodes: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(key, id, twin, from, to, u, v, next) of edges (edge_id, a, b) between nodes (node, u, v): two half-edges each, ids 2 edge_id and 2 edge_id + 1.

    The next half-edge of a walk with the face on its left is, at the far node, the one before the twin in anticlockwise order; ties of angle go
    by id. (u, v) is the place of ``from``.
    """
    key = list(key)
    both = edges.select(*key, F.explode(F.array(F.struct((F.col("edge_id") * 2).alias("id"), F.col("a").alias("from"), F.col("b").alias("to")), F.struct((F.col("edge_id") * 2 + 1).alias("id"), F.col("b").alias("from"), F.col("a").alias("to")))).alias("h")).select(*key, "h.*")
    at = lambda name, u, v: nodes.select(*key, F.col("node").alias(name), F.col("u").cast("double").alias(u), F.col("v").cast("double").alias(v))
    both = both.join(at("from", "u", "v"), [*key, "from"]).join(at("to", "u1", "v1"), [*key, "to"])
    out = both.select(*key, "id", (F.col("id").bitwiseXOR(F.lit(1))).alias("twin"), "from", "to", "u", "v", F.atan2(F.col("v1") - F.col("v"), F.col("u1") - F.col("u")).alias("angle"))
    around = Window.partitionBy(*key, "from")
    order = around.orderBy("angle", "id")
    before = F.coalesce(F.lag("id").over(order), F.last("id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    turned = out.withColumn("before", before)
    return turned.join(turned.select(*key, F.col("id").alias("twin"), F.col("before").alias("next")), [*key, "twin"]).select(*key, "id", "twin", "from", "to", "u", "v", "next")


def walks(half: DataFrame, key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(key, id, cycle, place, size, from, u, v) of every half-edge in its face's walk, and (key, cycle, size, area) of the faces.

    Inner faces have positive area, outer ones negative.
    """
    key = list(key)
    half = cut(half)
    placed = cut(cycles(half, key=key).join(half.select(*key, "id", "from", "u", "v", "next"), [*key, "id"]))
    ahead = placed.select(*key, F.col("id").alias("next"), F.col("u").alias("_u"), F.col("v").alias("_v"))
    area = placed.join(ahead, [*key, "next"]).groupBy(*key, "cycle", "size").agg((F.sum(F.col("u") * F.col("_v") - F.col("_u") * F.col("v")) / 2).alias("area"))
    return placed.drop("next"), area.select(*key, "cycle", "size", "area")


def greedy_matching(edges: DataFrame, a: str, b: str, order: Sequence[str], key: Sequence[str] = (), one_set: bool = False, max_rounds: int = 200) -> DataFrame:
    """The edges that a loop in ascending ``order`` would take, each node once: rounds take all edges that are the first of both their ends.

    Such an edge is taken by the loop whatever else is, so rounds and loop agree. Ties of ``order`` go to the least ends. one_set: a and b are
    nodes of one set, else of two. Each round is two grouped minima and joins, checkpointed; what is left shrinks by more than
    the number of local firsts, and only a chain of ever later edges takes a round for each.
    """
    key, cols = list(key), edges.columns
    rank = F.struct(*order, a, b)
    left = cut(edges.where(F.col(a) != F.col(b)) if one_set else edges)
    taken = None
    for _ in range(max_rounds):
        rows = left.withColumn("_e", rank)
        if one_set:
            ends = rows.select(*key, F.explode(F.array(a, b)).alias("_x"), "_e").groupBy(*key, "_x").agg(F.min("_e").alias("_f"))
            first = {c: ends for c in (a, b)}
        else:
            first = {c: rows.groupBy(*key, F.col(c).alias("_x")).agg(F.min("_e").alias("_f")) for c in (a, b)}
        for k, c in enumerate((a, b)):
            rows = rows.join(first[c].select(*key, F.col("_x").alias(c), F.col("_f").alias(f"_f{k}")), [*key, c])
        new = cut(rows.where("_e = _f0 and _e = _f1").select(*cols).distinct())
        if new.isEmpty():
            return new if taken is None else taken
        taken = new if taken is None else taken.unionByName(new)
        if one_set:
            used = new.select(*key, F.explode(F.array(a, b)).alias("_x"))
            used = {c: used for c in (a, b)}
        else:
            used = {c: new.select(*key, F.col(c).alias("_x")) for c in (a, b)}
        for c in (a, b):
            left = left.join(used[c].withColumnRenamed("_x", c), [*key, c], "left_anti")
        left = cut(left.select(*cols))
    raise RuntimeError(f"the matching did not end in {max_rounds} rounds")


def _nearest(own: DataFrame, others: DataFrame, limit, key: list[str]) -> DataFrame:
    """own (key, v, first) with d, the distance to the nearest value of others, to, the one or two values at it as (first, v), for those that have one within the limit.

    Windows run over cells as wide as the limit; others are put into three each.
    """
    cell = F.floor(F.col("v") / limit).cast("long")
    mine = own.select(*key, cell.alias("_cell"), "v", F.lit(1).alias("_own"), "first")
    rows = mine.unionByName(others.select(*key, F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell"), "v", F.lit(0).alias("_own"), "first"))
    part = Window.partitionBy(*key, "_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = F.when(F.col("_own") == 0, F.struct("first", "v"))
    rows = rows.select("*", F.last(other, True).over(part.orderBy("v", "_own")).alias("_lo"), F.last(other, True).over(part.orderBy(F.desc("v"), F.desc("_own"))).alias("_hi"))
    lo, hi = F.col("v") - F.col("_lo.v"), F.col("_hi.v") - F.col("v")
    found = rows.where("_own = 1").withColumn("d", F.least(lo, hi)).where(F.col("d") <= limit)
    to = F.array_compact(F.array(F.when(lo == F.col("d"), F.col("_lo")), F.when(hi == F.col("d"), F.col("_hi"))))
    return found.select(*key, "v", "first", "d", to.alias("to"))


def nearest_matching(left: DataFrame, right: DataFrame, limit, key: Sequence[str], max_rounds: int = 200) -> DataFrame:
    """(key, a, b, d): what ``greedy_matching`` makes of all pairs of left (key, a, v) and right (key, b, v) that are at most ``limit`` apart, nearest first, without making the pairs.

    A round holds each value against the nearest ones of the other side. Where two values are nearest to each other and to no third, their ids
    are the next pairs of the loop, in turn; so they are where one value lies between two that are nearest to it alone. At longer chains of equal distances,
    a pair is taken if it is the first of both its ends. Rounds read rows as many as the table has, each with a neighbour on either side. An id
    with several values would be found in several places at once; keys that have one go by their pairs.
    """
    key = list(key)
    free, odd = {}, None
    for s, df in (("a", left), ("b", right)):
        free[s] = cut(df.select(*key, s, "v").dropna().distinct())
        again = free[s].groupBy(*key, s).agg(F.count("*").alias("_n")).where("_n > 1").select(*key)
        odd = again if odd is None else odd.union(again)
    odd, taken = cut(odd.distinct()), None
    if not odd.isEmpty():
        cell = F.floor(F.col("v") / limit).cast("long")
        some = {s: free[s].join(odd, key, "left_semi") for s in "ab"}
        free = {s: cut(free[s].join(odd, key, "left_anti")) for s in "ab"}
        near = some["b"].select(*key, "b", F.col("v").alias("_v"), F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell"))
        pairs = some["a"].withColumn("_cell", cell).join(near, [*key, "_cell"]).select(*key, "a", "b", F.abs(F.col("v") - F.col("_v")).alias("d"))
        taken = greedy_matching(pairs.where(F.col("d") <= limit), "a", "b", ["d"], key, max_rounds=max_rounds)
    for _ in range(max_rounds):
        group = {s: free[s].groupBy(*key, "v").agg(F.min(s).alias("first")) for s in "ab"}
        best = {s: cut(_nearest(group[s], group[o], limit, key)) for s, o in ("ab", "ba")}
        ends = {}
        for s, o in ("ab", "ba"):
            to = best[s].select(*key, F.col("v").alias(f"v{s}"), F.col("first").alias(s), (F.size("to") > 1).alias(f"tie_{s}"), F.array_min("to")["v"].alias("_v"), "d", F.explode("to").alias("_to"))
            ends[s] = to.select(*key, f"v{s}", F.col("_to.v").alias(f"v{o}"), s, f"tie_{s}", (F.col("_v") == F.col("_to.v")).alias(f"first_{s}"), *(["d"] if s == "a" else []))
        edges = ends["a"].join(ends["b"], [*key, "va", "vb"])
        for s, o in ("ab", "ba"):
            w = Window.partitionBy(*key, f"v{s}")
            edges = edges.withColumns({f"n_{s}": F.count("*").over(w), f"tied_{s}": F.max(f"tie_{o}").over(w)})
        among = {s: F.expr(f"tie_{s} and n_{s} = 2 and not tied_{s}") for s in "ab"}
        whole = F.when(among["a"] | F.expr("not tie_a and not tie_b"), F.struct(F.lit("a").alias("s"), F.col("va").alias("v"))).when(among["b"], F.struct(F.lit("b").alias("s"), F.col("vb").alias("v")))
        edges = cut(edges.withColumn("whole", whole))
        # Ids in turn, on both sides of what goes together.
        turns = {}
        for s in "ab":
            at = edges.where("whole is not null").select(*key, F.col(f"v{s}").alias("v"), "whole", *(["d"] if s == "a" else [])).distinct()
            turns[s] = free[s].join(at, [*key, "v"]).withColumn("_turn", F.row_number().over(Window.partitionBy(*key, "whole").orderBy(s))).drop("v")
        single = edges.where("whole is null and first_a and first_b").select(*key, "a", "b", "d")
        new = cut(turns["a"].join(turns["b"], [*key, "whole", "_turn"]).select(*key, "a", "b", "d").unionByName(single))
        if new.isEmpty():
            return new if taken is None else taken.unionByName(new)
        taken = new if taken is None else taken.unionByName(new)
        # What has nothing near will never have.
        free = {s: cut(free[s].join(best[s].select(*key, "v"), [*key, "v"], "left_semi").join(new.select(*key, s), [*key, s], "left_anti")) for s in "ab"}
    raise RuntimeError(f"the matching did not end in {max_rounds} rounds")
