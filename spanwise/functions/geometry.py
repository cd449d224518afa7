"""Geometry of polylines, polygons and rectangles as column functions over array<struct<u, v>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bezier(p0: str, q1: str, q2: str, p1: str, n: int) -> Column:
    """n + 1 points of a cubic."""
    def at(t: Column, c: str) -> Column:
        s = 1 - t
        return s * s * s * F.col(f"{p0}.{c}") + 3 * s * s * t * F.col(f"{q1}.{c}") + 3 * s * t * t * F.col(f"{q2}.{c}") + t * t * t * F.col(f"{p1}.{c}")

    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(at(i / n, "u").alias("u"), at(i / n, "v").alias("v")))


def _pairs(poly: str | Column, closed: bool) -> Column:
    """Neighbours of a polyline or of a closed polygon, as structs (a, b)."""
    other = F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1)) if closed else F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0)))
    first = (F.col(poly) if isinstance(poly, str) else poly) if closed else F.slice(poly, 1, F.greatest(F.size(poly) - 1, F.lit(0)))
    return F.zip_with(first, other, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def polyline_length(poly: str) -> Column:
    return F.aggregate(_pairs(poly, False), F.lit(0.0), lambda s, x: s + F.hypot(x["b"]["u"] - x["a"]["u"], x["b"]["v"] - x["a"]["v"]))


def signed_area(poly: str | Column) -> Column:
    """Shoelace; anticlockwise is positive."""
    return F.aggregate(_pairs(poly, True), F.lit(0.0), lambda s, x: s + x["a"]["u"] * x["b"]["v"] - x["b"]["u"] * x["a"]["v"]) / 2


def centroid(poly: str) -> Column:
    """Of the area; the mean of the vertices if there is no area."""
    cross = lambda x: x["a"]["u"] * x["b"]["v"] - x["b"]["u"] * x["a"]["v"]
    part = lambda c: F.aggregate(_pairs(poly, True), F.lit(0.0), lambda s, x: s + (x["a"][c] + x["b"][c]) * cross(x))
    mean = lambda c: F.aggregate(poly, F.lit(0.0), lambda s, x: s + x[c]) / F.size(poly)
    area = signed_area(poly)
    return F.when(F.abs(area) > 1e-9, F.struct((part("u") / (6 * area)).alias("u"), (part("v") / (6 * area)).alias("v"))).otherwise(F.struct(mean("u").alias("u"), mean("v").alias("v")))


def in_polygon(u: Column, v: Column, poly: str) -> Column:
    """Even-odd rule; an edge holds its lower end."""
    return F.aggregate(
        _pairs(poly, True), F.lit(False),
        lambda s, x: F.when((x["a"]["v"] > v) != (x["b"]["v"] > v), s != (x["a"]["u"] + (v - x["a"]["v"]) * (x["b"]["u"] - x["a"]["u"]) / (x["b"]["v"] - x["a"]["v"]) > u)).otherwise(s),
    )


def rect_iou(a: list[Column], b: list[Column]) -> Column:
    """Of rectangles (u0, v0, u1, v1)."""
    inter = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 1e-6, inter / union).otherwise(0.0)


def distance_to_segment(pu: Column, pv: Column, a: Column, b: Column) -> Column:
    du, dv = b["u"] - a["u"], b["v"] - a["v"]
    n = du * du + dv * dv
    t = F.when(n < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((pu - a["u"]) * du + (pv - a["v"]) * dv) / n)))
    return F.hypot(pu - (a["u"] + t * du), pv - (a["v"] + t * dv))


def distance_to_boundary(pu: Column, pv: Column, poly: str) -> Column:
    """Distance of a point to a closed polygon's edges; 0 for an empty one."""
    return F.coalesce(F.array_min(F.transform(_pairs(poly, True), lambda x: distance_to_segment(pu, pv, x["a"], x["b"]))), F.lit(0.0))


def bound(value: Column, use) -> Column:
    """use(x) with x standing for the value: a lambda variable, so the expression isn't repeated at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def resampled(poly: str, length: Column, step: float = 1.0) -> Column:
    """n + 1 points at equal arc length, n = length / step + 2 between 8 and 64."""
    n = F.greatest(F.lit(8), F.least(F.lit(64), F.floor(length / step).cast("int") + 2))
    steps = F.transform(_pairs(poly, False), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.hypot(x["b"]["u"] - x["a"]["u"], x["b"]["v"] - x["a"]["v"]).alias("l")))

    def with_ends(steps: Column) -> Column:
        return F.transform(steps, lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["l"].alias("l"), F.aggregate(F.slice(steps, F.lit(1), i + 1), F.lit(0.0), lambda s, y: s + y["l"]).alias("to")))

    def place(seg: Column, s: Column) -> Column:
        t = F.when(seg["l"] < 1e-6, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - seg["to"] + seg["l"]) / seg["l"])))
        return bound(t, lambda t: F.struct((seg["a"]["u"] + t * (seg["b"]["u"] - seg["a"]["u"])).alias("u"), (seg["a"]["v"] + t * (seg["b"]["v"] - seg["a"]["v"])).alias("v")))

    def dots(ends: Column) -> Column:
        def at(k: Column) -> Column:
            s = length * k / n
            return bound(F.coalesce(F.get(F.filter(ends, lambda e: e["to"] >= s - 1e-6), F.lit(0)), F.element_at(ends, -1)), lambda seg: place(seg, s))

        return F.transform(F.sequence(F.lit(0), n), at)

    return bound(steps, lambda x: bound(with_ends(x), dots))


def inside_fraction(points: str, u0: Column, v0: Column, u1: Column, v1: Column, tol: Column) -> Column:
    """Share of sampled points in a rectangle that is widened by tol."""
    hit = F.filter(points, lambda p: (p["u"] >= u0 - tol) & (p["u"] <= u1 + tol) & (p["v"] >= v0 - tol) & (p["v"] <= v1 + tol))
    return F.size(hit) / F.size(points)


def affine(poly: str, m: list[list[float]]) -> Column:
    return F.transform(poly, lambda p: F.struct((m[0][0] * p["u"] + m[0][1] * p["v"] + m[0][2]).alias("u"), (m[1][0] * p["u"] + m[1][1] * p["v"] + m[1][2]).alias("v")))


def bounds(poly: str) -> list[Column]:
    u, v = F.transform(poly, lambda p: p["u"]), F.transform(poly, lambda p: p["v"])
    return [F.array_min(u), F.array_min(v), F.array_max(u), F.array_max(v)]


def clipped(poly: Column, axis: str, at: Column, above: bool) -> Column:
    """A polygon's part on one side of an axis-parallel line: each corner inside stays, each edge that changes sides adds the place where it does."""
    other = "v" if axis == "u" else "u"
    inside = lambda p: p[axis] >= at if above else p[axis] <= at
    none = F.slice(poly, 1, 0)

    def of(x: Column) -> Column:
        p, q = x["a"], x["b"]
        t = (at - p[axis]) / (q[axis] - p[axis])
        place = {axis: at, other: p[other] + t * (q[other] - p[other])}
        cut = (inside(p) != inside(q)) & (F.abs(q[axis] - p[axis]) > 1e-6)
        return F.concat(F.when(inside(p), F.array(p)).otherwise(none), F.when(cut, F.array(F.struct(place["u"].alias("u"), place["v"].alias("v")))).otherwise(none))

    return F.flatten(F.transform(_pairs(poly, True), of))


def clipped_to_box(poly: Column, box: list[Column], use) -> Column:
    """use(part) of a polygon's part in a rectangle (u0, v0, u1, v1); each of the four cuts is computed once."""
    steps = [("u", box[0], True), ("u", box[2], False), ("v", box[1], True), ("v", box[3], False)]

    def after(k: int, part: Column) -> Column:
        return use(part) if k == 4 else bound(clipped(part, *steps[k]), lambda p: after(k + 1, p))

    return after(0, poly)


def polygon_box_iou(poly: Column, box: list[Column]) -> Column:
    """Intersection over union of a polygon and a rectangle (u0, v0, u1, v1); 0 where less than a triangle is left or nothing has area."""
    inter = clipped_to_box(poly, box, lambda p: F.when(F.size(p) < 3, 0.0).otherwise(F.abs(signed_area(p))))
    whole = F.abs(signed_area(poly)) + F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))
    return bound(inter, lambda i: F.when(whole - i > 1e-6, i / (whole - i)).otherwise(0.0))


def clip(poly: list[tuple[float, float]], axis: int, at: float, keep_above: bool) -> list[tuple[float, float]]:
    """A polygon's part on one side of an axis-parallel line (for kernels)."""
    out = []
    for k, p in enumerate(poly):
        q = poly[(k + 1) % len(poly)]
        p_in, q_in = (p[axis] >= at, q[axis] >= at) if keep_above else (p[axis] <= at, q[axis] <= at)
        if p_in:
            out.append(p)
        if p_in != q_in and abs(q[axis] - p[axis]) > 1e-6:
            t = (at - p[axis]) / (q[axis] - p[axis])
            out.append((at, p[1] + t * (q[1] - p[1])) if axis == 0 else (p[0] + t * (q[0] - p[0]), at))
    return out


def area_of(poly: list[tuple[float, float]]) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1], strict=True)) / 2


def centroid_of(poly: list[tuple[float, float]]) -> tuple[float, float]:
    a = area_of(poly)
    if abs(a) < 1e-9:
        return sum(p[0] for p in poly) / len(poly), sum(p[1] for p in poly) / len(poly)
    pairs = [(p, q, p[0] * q[1] - q[0] * p[1]) for p, q in zip(poly, poly[1:] + poly[:1], strict=True)]
    return sum((p[0] + q[0]) * c for p, q, c in pairs) / (6 * a), sum((p[1] + q[1]) * c for p, q, c in pairs) / (6 * a)


def polygon_rect_iou(poly: list[tuple[float, float]], rect: tuple[float, float, float, float]) -> float:
    """Intersection over union of a polygon and a rectangle (for kernels)."""
    part = list(poly)
    for axis, at, above in ((0, rect[0], True), (0, rect[2], False), (1, rect[1], True), (1, rect[3], False)):
        part = clip(part, axis, at, above)
        if len(part) < 3:
            return 0.0
    inter = abs(area_of(part))
    union = abs(area_of(list(poly))) + max(rect[2] - rect[0], 0.0) * max(rect[3] - rect[1], 0.0) - inter
    return inter / union if union > 1e-6 else 0.0


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, anticlockwise from the least point (for kernels)."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def side(seq) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return side(pts) + side(reversed(pts))


def orientation(a: Column, b: Column) -> Column:
    """Direction from a to b in degrees, in (-180, 180]."""
    return F.degrees(F.atan2(b["v"] - a["v"], b["u"] - a["u"]))
