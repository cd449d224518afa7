"""Near pairs, crossings, clearances, cycles, faces, matchings and clipping against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanwise.functions import geometry as G
from spanwise.operators import relational as R
from spanwise.operators import rings, spatial


def made_points(rng, n):
    """Scattered and crowded points, some at one place, some on borders of cells."""
    out = [(f"g{rng.randrange(2)}", k, rng.uniform(-20, 20), rng.uniform(-20, 20)) for k in range(n)]
    out += [("g0", n + k, rng.gauss(3, 0.4), rng.gauss(4, 0.4)) for k in range(n)]
    out += [("g1", 2 * n + k, float(rng.randrange(-4, 4)), float(rng.randrange(-4, 4))) for k in range(n)]
    return [*out, ("g0", 4 * n, None, 1.0), ("g1", 4 * n + 1, 1.0, None)]


def test_all_near_pairs_come_once(spark):
    rows = made_points(random.Random(1), 60)
    df = spark.createDataFrame(rows, "g string, id long, u double, v double").repartition(3)
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and None not in (*a, *b) and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 1.0)
    for how in ({}, {"most": 5}, {"side": 1.0}):
        assert sorted((r.g, r.id_a, r.id_b) for r in spatial.within(df, "id", "u", "v", 1.0, ["g"], **how).collect()) == want
    assert len(want) > 1000
    assert spatial.within(df.limit(0), "id", "u", "v", 1.0).collect() == []


def test_points_at_one_place_travel_together(spark, monkeypatch):
    """Many points at few places, some with equal ids, zeros of both signs: all pairs come once, and each place meets its neighbours once for up to so many of its points."""
    rows = [("g", k if k % 50 else 7, float(k % 4), -0.0 if k % 3 else 0.0) for k in range(240)] + [("g", None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, id long, u double, v double").repartition(5)
    from collections import Counter

    of = [r for r in rows if r[1] is not None]
    want = Counter((min(a[1], b[1]), max(a[1], b[1])) for n, a in enumerate(of) for b in of[:n] if a[1] != b[1] and abs(a[2] - b[2]) <= 1.0)
    sent, join = [], spatial.cell_join
    monkeypatch.setattr(spatial, "cell_join", lambda left, right, *how: [sent.append((left.count(), right.count())), join(left, right, *how)][1])
    for most, n in ((spatial.MOST, 4), (200, 24)):
        assert Counter((r.id_a, r.id_b) for r in spatial.within(df, "id", "u", "v", 1.0, ["g"], most=most).collect()) == want
        assert sent[-1][1] <= n and sent[-1][0] <= 6 * n


def test_crowded_cells_spread(spark):
    """One cell with all rows is as many parts as it needs."""
    df = spark.range(900).select("id", F.lit(0.5).alias("u"), F.lit(0.5).alias("v"), F.lit(1).alias("i"))
    both = spatial.cell_join(df, df.select("i", F.col("id").alias("other")), ["i"], "id", most=100)
    assert both.count() == 900 * 900
    parts = {r._part for r in df.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(9))).select("_part").distinct().collect()}
    assert len(parts) == 9


def crossing(a, b):
    au, av, bu, bv = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    det = au * bv - av * bu
    if det == 0:
        return False
    t, s = ((b[0] - a[0]) * bv - (b[1] - a[1]) * bu) / det, ((b[0] - a[0]) * av - (b[1] - a[1]) * au) / det
    return -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= s <= 1 + 1e-9


def made_segments(rng, n):
    out = []
    for k in range(n):
        u, v = rng.choice([rng.uniform(-9, 9), float(rng.randrange(-9, 9))]), float(rng.randrange(-9, 9))
        du, dv = rng.choice([(rng.uniform(-4, 4), rng.uniform(-4, 4)), (float(rng.randrange(-3, 4)), 0.0), (0.0, float(rng.randrange(-3, 4))), (0.0, 0.0)])
        out.append((f"g{k % 2}", k, u, v, u + du, v + dv))
    return out


SEGMENT = "g string, id long, u0 double, v0 double, u1 double, v1 double"


@pytest.mark.parametrize("side", [1.0, 2.5])
def test_all_crossings_come_once(spark, side):
    rows = made_segments(random.Random(2), 400)
    df = spark.createDataFrame([*rows, ("g0", 999, None, 0.0, 1.0, 1.0)], SEGMENT)
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and crossing(a[2:], b[2:]))
    for most in (2000, 3):
        assert sorted((r.g, r.id_a, r.id_b) for r in spatial.crossings(df, "id", side, side, ["g"], most).collect()) == want
    assert len(want) > 100


def test_few_and_many_segments(spark):
    """Keys on both sides of the limit give what a grid for all and pairs for all give; few segments make no cells."""
    rows = [(f"g{k % 9 % 4}", *x[1:]) for k, x in enumerate(made_segments(random.Random(8), 300))]
    df, none = spark.createDataFrame(rows, SEGMENT), spark.createDataFrame([], "g string, id_a long, id_b long")
    sides, ways = [], (0, 40, 90, 1000)
    for few in ways:
        crossed = sorted((r.g, r.id_a, r.id_b, round(r.u, 6)) for r in spatial.crossings(df, "id", 2.0, 2.0, ["g"], few=few).collect())
        clear = sorted((r.g, r.id_a, r.id_b, r.clearance) for r in spatial.clearances(df, none, "id", ["g"], few=few).collect())
        sides.append((crossed, clear))
    assert all(x == sides[0] for x in sides) and len(sides[0][0]) > 50 and len(sides[0][1]) == 4


def test_crowded_cells_send_rows_by_both_sides(spark):
    """Twice the rows of a cell are no more than twice the copies of each row, on both sides, and no pair is lost."""
    df = spark.range(1200).select("id", F.lit(1).alias("i"))
    both = spatial.cell_join(df, df.select("i", F.col("id").alias("other")), ["i"], "id", most=300)
    assert both.distinct().count() == both.count() == 1200 * 1200
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_row") and plan.count("_col")


def distance(a, b):
    if crossing(a, b):
        return 0.0

    def end(u, v, o):
        du, dv = o[2] - o[0], o[3] - o[1]
        n = du * du + dv * dv
        t = max(0.0, min(1.0, ((u - o[0]) * du + (v - o[1]) * dv) / n)) if n else 0.0
        return math.hypot(u - o[0] - t * du, v - o[1] - t * dv)

    return min(end(*a[:2], b), end(*a[2:], b), end(*b[:2], a), end(*b[2:], a))


def test_clearances(spark):
    """Each group's nearest pair that isn't adjacent: near and far ones, all adjacent, one segment, all at one place."""
    rng = random.Random(3)
    rows = [("many", k, u := rng.uniform(0, 500), v := rng.uniform(0, 500), u + rng.uniform(-9, 9), v + rng.uniform(-9, 9)) for k in range(60)]
    rows += [("chain", k, 3.0 * k, 0.0, 3.0 * k + 3, 0.0) for k in range(12)]
    rows += [("pair", 0, 0.0, 0.0, 1.0, 0.0), ("pair", 1, 1.0, 0.0, 2.0, 0.0), ("one", 0, 0.0, 0.0, 1.0, 1.0), ("far", 0, 0.0, 0.0, 0.0, 0.0), ("far", 1, 1e6, 0.0, 1e6, 0.0), *(("spot", k, 2.0, 2.0, 2.0, 2.0) for k in range(4))]
    adjacent = [("chain", k + 1, k) for k in range(11)] + [("pair", 0, 1), ("spot", 0, 1)]
    near = {frozenset(x[1:]) | {x[0]} for x in adjacent}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and frozenset((a[1], b[1])) | {a[0]} not in near:
                want[a[0]] = min(want.get(a[0], (math.inf,)), (round(distance(a[2:], b[2:]), 9), a[1], b[1]))
    df = spark.createDataFrame(rows, SEGMENT)
    got = spatial.clearances(df, spark.createDataFrame(adjacent, "g string, id_a long, id_b long"), "id", ["g"], most=40).collect()
    assert {r.g: (round(r.clearance, 9), r.id_a, r.id_b) for r in got} == want
    assert set(want) == {"many", "chain", "far", "spot"}


def test_cycles(spark):
    rng = random.Random(4)
    rows = []
    for g, n in (("a", 300), ("b", 40), ("c", 1)):
        ids = list(range(n))
        to = ids[1:] + ids[:1] if g == "b" else rng.sample(ids, n)
        rows += [(g, i, j) for i, j in zip(ids, to, strict=True)]
    got = {(r.g, r.id): (r.cycle, r.place, r.size) for r in rings.cycles(spark.createDataFrame(rows, "g string, id long, next long"), key=["g"]).collect()}
    next_, want = {(g, i): j for g, i, j in rows}, {}
    for g, i, _ in rows:
        if (g, i) not in want:
            walk = [i]
            while (j := next_[g, walk[-1]]) != i:
                walk.append(j)
            want |= {(g, x): (i, k, len(walk)) for k, x in enumerate(walk)}
    assert got == want
    with pytest.raises(ValueError, match="permutation"):
        rings.cycles(spark.createDataFrame([("a", 1, 2), ("a", 2, 2)], "g string, id long, next long"), key=["g"])


def test_rounds_keep_their_size(spark):
    """What rounds join is as large as its files, not the product of all joins before: a cycle of 2^12 rows needs 13 rounds."""
    n = 1 << 12
    ring = spark.range(n).select("id", F.pmod(F.col("id") * 5 + 3, F.lit(n)).alias("next"))
    found = rings.cycles(ring)
    row = found.agg(F.count("*"), F.countDistinct("place"), F.min("size"), F.max("size"), F.max("cycle")).first()
    assert tuple(row) == (n, n, n, n, 0)
    both = R.cut(found.join(found.select("id", F.col("place").alias("p")), "id"))
    assert int(str(both._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 40


def test_faces(spark):
    """A 40 x 120 frame with two rungs, by joins: three faces of 1600 and the outer one."""
    uv = {"a": (0, 0), "b": (40, 0), "c": (40, 40), "d": (40, 80), "e": (40, 120), "f": (0, 120), "g": (0, 80), "h": (0, 40), "tip": (20, 20)}
    lines = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "h"), ("h", "a"), ("c", "h"), ("d", "g"), ("a", "tip")]
    nodes = spark.createDataFrame([(k, float(u), float(v)) for k, (u, v) in uv.items()], "node string, u double, v double")
    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(lines)], "edge_id long, a string, b string")
    placed, faces = rings.walks(rings.half_edges(edges, nodes))
    assert sorted((r.area, r.size) for r in faces.collect()) == [(-4800.0, 8), (1600.0, 4), (1600.0, 4), (1600.0, 6)]
    walk = [r["from"] for r in placed.join(faces.where("size = 6").select("cycle"), "cycle").orderBy("place").collect()]
    assert walk[1:] + walk[:1] != walk and walk.count("a") == 2 and walk.count("tip") == 1


@pytest.mark.parametrize("one_set", [False, True])
def test_greedy_matching(spark, one_set):
    """The same as a sorted loop, ties included."""
    rng = random.Random(5)
    rows = list({(f"g{rng.randrange(2)}", rng.randrange(25), rng.randrange(25)): rng.randrange(12) for _ in range(300)}.items())
    rows = [(*k, w) for k, w in rows]
    used, want = set(), []
    for g, a, b, w in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        ends = [(g, 0, a), (g, 0 if one_set else 1, b)]
        if len({*ends}) == 2 and not used & {*ends}:
            used |= {*ends}
            want.append((g, a, b, w))
    got = rings.greedy_matching(spark.createDataFrame(rows, "g string, a long, b long, w long"), "a", "b", ["w"], ["g"], one_set)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert rings.greedy_matching(spark.createDataFrame([], "a long, b long, w long"), "a", "b", ["w"]).collect() == []


def test_clipping(spark):
    rng = random.Random(6)
    rows = []
    for k in range(80):
        n = rng.randrange(0, 9)
        poly = [(rng.uniform(0, 10), rng.choice([rng.uniform(0, 10), 3.0])) for _ in range(n)]
        rows.append((k, [{"u": u, "v": v} for u, v in poly], *(lambda a, b, c, d: (min(a, b), min(c, d), max(a, b), max(c, d)))(*(rng.uniform(-1, 11) for _ in range(4)))))
    df = spark.createDataFrame(rows, "id int, p array<struct<u: double, v: double>>, x0 double, y0 double, x1 double, y1 double")
    got = {r.id: r.iou for r in df.select("id", G.polygon_box_iou(F.col("p"), [F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("iou")).collect()}
    for k, p, *box in rows:
        poly = [(q["u"], q["v"]) for q in p]
        assert math.isclose(got[k], G.polygon_rect_iou(poly, tuple(box)) if poly else 0.0, abs_tol=1e-12)


def test_nearest_matching(spark, monkeypatch):
    """The same as the loop over all pairs, with copies, equal distances on both sides and an id with two values; the pairs aren't made."""
    rng = random.Random(2)
    values = [50 * k + rng.randrange(20) for k in range(8)]
    left = [("x", 10 * c + k, v) for c in range(5) for k, v in enumerate(values)] + [("x", 99, None), (None, 98, 3), ("z", 1, 5)]
    right = [("x", 10 * c + k, values[k] + d) for c in range(3) for k, d in enumerate([0, 3, -4, 9, 0, 20, 5])] + [("z", 1, 100), ("z", 2, 9), ("z", 3, 1)]
    # Two values at one distance of a third, and a chain of equal distances.
    left += [("x", 200 + k, v) for k, v in enumerate([900, 900, 900, 1010, 1002, 1006])]
    right += [("x", 200 + k, v) for k, v in enumerate([903, 897, 897, 1000, 1004, 1008, 1004])]

    def loop(left, right):
        used, out = set(), []
        for d, g, a, b in sorted((abs(v - w), g, a, b) for g, a, v in left for h, b, w in right if g == h and None not in (g, v, w) and abs(v - w) <= 25):
            if not {(g, "a", a), (g, "b", b)} & used:
                used |= {(g, "a", a), (g, "b", b)}
                out.append((g, a, b, d))
        return sorted(out)

    def found(left, right):
        df = lambda rows, c: spark.createDataFrame(rows, f"g string, {c} long, v int").withColumn("v", F.col("v").cast("decimal(18,4)")).coalesce(1)
        return sorted((r.g, r.a, r.b, int(r.d)) for r in rings.nearest_matching(df(left, "a"), df(right, "b"), 25, ["g"]).collect())

    twice = [("x", 1, 10), ("x", 1, 40), ("x", 2, 12), ("z", 1, 5)]
    assert found(twice, right) == loop(twice, right)
    monkeypatch.setattr(rings, "greedy_matching", None)
    assert found(left, right) == loop(left, right)
