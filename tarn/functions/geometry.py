"""Polygons as column expressions: edges, crossings, clipped lengths, intersection tests, reprojection.

A polygon is ``rings array<array<struct<x,y>>>`` (closed rings; holes and parts alike count by the
even-odd rule); a segment is a struct(a, b) of points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import crs


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def edges(rings: Column) -> Column:
    """array<struct<a, b>> of all rings."""
    ring = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda k: F.struct(F.element_at(r, k).alias("a"), F.element_at(r, k + 1).alias("b")))
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), ring))


def inside(p: Column, sides: Column) -> Column:
    """Whether a point lies inside: crossings to the right are odd."""
    crosses = lambda q: ((q["a"]["y"] <= p["y"]) != (q["b"]["y"] <= p["y"])) & (p["x"] < q["a"]["x"] + (p["y"] - q["a"]["y"]) * (q["b"]["x"] - q["a"]["x"]) / (q["b"]["y"] - q["a"]["y"]))
    return F.size(F.filter(sides, crosses)) % 2 == 1


def _cross(o: Column, p: Column, q: Column) -> Column:
    return (p["x"] - o["x"]) * (q["y"] - o["y"]) - (p["y"] - o["y"]) * (q["x"] - o["x"])


def strictly_inside(p: Column, sides: Column) -> Column:
    """Whether a point lies inside and on no edge."""
    on = lambda q: (_cross(q["a"], q["b"], p) == 0) & p["x"].between(F.least(q["a"]["x"], q["b"]["x"]), F.greatest(q["a"]["x"], q["b"]["x"])) & p["y"].between(F.least(q["a"]["y"], q["b"]["y"]), F.greatest(q["a"]["y"], q["b"]["y"]))
    return inside(p, sides) & ~F.exists(sides, on)


def segments_meet(s: Column, t: Column) -> Column:
    """Whether two closed segments share a point."""
    d1, d2, d3, d4 = _cross(t["a"], t["b"], s["a"]), _cross(t["a"], t["b"], s["b"]), _cross(s["a"], s["b"], t["a"]), _cross(s["a"], s["b"], t["b"])
    on = lambda d, u, p: (d == 0) & p["x"].between(F.least(u["a"]["x"], u["b"]["x"]), F.greatest(u["a"]["x"], u["b"]["x"])) & p["y"].between(F.least(u["a"]["y"], u["b"]["y"]), F.greatest(u["a"]["y"], u["b"]["y"]))
    proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
    return proper | on(d1, t, s["a"]) | on(d2, t, s["b"]) | on(d3, s, t["a"]) | on(d4, s, t["b"])


def polygons_meet(left: Column, right: Column) -> Column:
    """Whether two polygons, given by their edges, share a point."""
    touch = F.exists(left, lambda s: F.exists(right, lambda t: segments_meet(s, t)))
    return touch | inside(F.element_at(left, 1)["a"], right) | inside(F.element_at(right, 1)["a"], left)


def clipped_length(segment: Column, sides: Column) -> Column:
    """Length of the part of a segment inside a polygon: cut where it meets an edge, pieces kept by their middle."""
    a, b = segment["a"], segment["b"]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]

    def cut(q):
        ex, ey = q["b"]["x"] - q["a"]["x"], q["b"]["y"] - q["a"]["y"]
        det = dx * ey - dy * ex
        wx, wy = q["a"]["x"] - a["x"], q["a"]["y"] - a["y"]
        t, u = (wx * ey - wy * ex) / F.nullif(det, F.lit(0.0)), (wx * dy - wy * dx) / F.nullif(det, F.lit(0.0))
        return F.when(u.between(0, 1) & t.between(0, 1), t)

    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.transform(sides, cut), lambda t: t.isNotNull())))
    part = lambda c, k: F.struct(F.element_at(c, k).alias("t0"), F.element_at(c, k + 1).alias("t1"))
    parts = F.transform(F.array(cuts), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda k: part(c, k)))[0]
    middle = lambda s: point(a["x"] + dx * (s["t0"] + s["t1"]) / 2, a["y"] + dy * (s["t0"] + s["t1"]) / 2)
    kept = F.filter(parts, lambda s: inside(middle(s), sides))
    share = F.aggregate(kept, F.lit(0.0), lambda n, s: n + s["t1"] - s["t0"])
    return share * F.sqrt(dx * dx + dy * dy)


def reproject(rings: Column, source: int, target: int) -> Column:
    """Every vertex in another code; equal codes copy."""
    if source == target:
        return rings

    def one(p):
        x, y = crs.project_columns(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda r: F.transform(r, one))


def bounds(rings: Column) -> Column:
    """struct(minx, miny, maxx, maxy)."""
    return F.transform(F.array(F.flatten(rings)), lambda p: F.struct(F.array_min(F.transform(p, lambda q: q["x"])).alias("minx"), F.array_min(F.transform(p, lambda q: q["y"])).alias("miny"), F.array_max(F.transform(p, lambda q: q["x"])).alias("maxx"), F.array_max(F.transform(p, lambda q: q["y"])).alias("maxy")))[0]
