"""Areas common to two polygons and the general classification of water polygons by reference layers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from .features import LEAST_LENGTH, LEAST_SHARE, box_join, decided, ranked

LINES, AREAS = ("sea", "river", "stream"), ("lake", "glacier", "reservoir", "dock")


def _edges(rings) -> np.ndarray:
    parts = []
    for ring in rings:
        p = np.array([(q["x"], q["y"]) for q in ring], float)
        if len(p) > 1:
            parts.append(np.column_stack((p[:-1], p[1:])))
    e = np.concatenate(parts) if parts else np.zeros((0, 4))
    e = e[e[:, 0] != e[:, 2]]  # an upright edge bounds no slab
    turn = e[:, 0] > e[:, 2]
    e[turn] = e[turn][:, [2, 3, 0, 1]]
    return e


def common_area(left, right) -> float:
    """Exact area inside both by the even-odd rule: slabs between all corners and crossings, in each the trapezoids that both cover."""
    a, b = _edges(left), _edges(right)
    if not len(a) or not len(b):
        return 0.0
    lo, hi = max(a[:, 0].min(), b[:, 0].min()), min(a[:, 2].max(), b[:, 2].max())
    if lo >= hi:
        return 0.0
    slope = lambda e: (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    every = np.concatenate((a, b))
    m = slope(every)
    k = every[:, 1] - m * every[:, 0]
    met = []
    for i in range(0, len(every), 256):  # a block of edges against all
        e = slice(i, i + 256)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (k[None, :] - k[e, None]) / (m[e, None] - m[None, :])
        met.append(x[(x > np.maximum(every[e, None, 0], every[None, :, 0])) & (x < np.minimum(every[e, None, 2], every[None, :, 2]))])
    cuts = np.unique(np.concatenate((every[:, 0], every[:, 2], *met, [lo, hi])))
    cuts = cuts[(cuts >= lo) & (cuts <= hi)]
    total = 0.0
    for x0, x1 in zip(cuts, cuts[1:]):
        mid = (x0 + x1) / 2
        spans = []
        for e, s in ((a, slope(a)), (b, slope(b))):
            on = (e[:, 0] < mid) & (e[:, 2] > mid)
            y = np.sort(e[on, 1] + s[on] * (mid - e[on, 0]))
            spans.append(y[: len(y) // 2 * 2].reshape(-1, 2))
        # in a slab nothing crosses, so the height over it is that of the middle
        low, top = np.maximum(spans[0][:, None, 0], spans[1][None, :, 0]), np.minimum(spans[0][:, None, 1], spans[1][None, :, 1])
        total += float(np.clip(top - low, 0, None).sum()) * (x1 - x0)
    return total


def overlap_area(left: str, right: str) -> Column:
    """:func:`common_area` of two columns of rings."""

    @F.pandas_udf("double")
    def area(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common_area(x, y) for x, y in zip(a, b)], dtype=float)

    return area(left, right)


def shape_measures(rings: Column) -> Column:
    """struct(area, cx, cy) of a polygon with outer rings and holes wound as given by the even-odd rule: rings turned so that holes count against it."""
    sides = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda k: F.struct(F.element_at(r, k).alias("a"), F.element_at(r, k + 1).alias("b")))
    q = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    total = lambda r, f: F.aggregate(sides(r), F.lit(0.0), lambda n, e: n + f(e))
    one = lambda r: F.struct(total(r, q).alias("q"), total(r, lambda e: (e["a"]["x"] + e["b"]["x"]) * q(e)).alias("sx"), total(r, lambda e: (e["a"]["y"] + e["b"]["y"]) * q(e)).alias("sy"))
    # the first ring counts as it is, each later one inside it against it, by sign
    sums = F.transform(rings, one)
    signed = F.transform(sums, lambda s, i: F.transform(F.array(F.signum(s["q"]) * F.when(i == 0, 1.0).otherwise(-1.0)), lambda g: F.struct((s["q"] * g).alias("q"), (s["sx"] * g).alias("sx"), (s["sy"] * g).alias("sy")))[0])
    add = lambda name: F.aggregate(signed, F.lit(0.0), lambda n, s: n + s[name])
    return F.struct((add("q") / 2).alias("area"), (add("sx") / (3 * add("q"))).alias("cx"), (add("sy") / (3 * add("q"))).alias("cy"))


def _boxed(shapes: DataFrame, rings: Column, *more: str) -> DataFrame:
    return shapes.withColumn("__b", geometry.bounds(rings)).select("__b.*", *more)


def classify(water: DataFrame, areas: DataFrame, lines: DataFrame, cell: float, least_length: float = LEAST_LENGTH, least_share: float = LEAST_SHARE) -> DataFrame:
    """(id, fclass, reason) of water polygons (id, rings: one polygon) by reference polygons (id, layer, rings) and segments (id, layer, segment; the segments of a line share its id).

    A reference polygon hits if it holds the centroid or covers ``least_share`` of the water by itself; a line if the
    parts of it inside are ``least_length`` together. Polygons count for lake, glacier, reservoir and dock, lines for
    sea, river and stream; the first class in priority order wins, and a shape without area falls back to ``water``.
    """
    # what hits a polygon depends on nothing else, so equal polygons, and equal lines, are joined as one
    w = water.select("rings").distinct().withColumn("__m", shape_measures(F.col("rings"))).filter("__m.area > 0")
    w = w.select("rings", F.col("__m.area").alias("area"), F.col("__m.cx").alias("cx"), F.col("__m.cy").alias("cy"))
    a, li = areas.filter(F.col("layer").isin(*AREAS)), lines.filter(F.col("layer").isin(*LINES))
    a = a.select("layer", "rings").distinct()
    near = box_join(_boxed(w, F.col("rings"), "rings", "area", "cx", "cy"), _boxed(a, F.col("rings"), "layer", "rings"), cell)
    near = near.select(F.col("l_rings").alias("rings"), F.col("l_area").alias("area"), F.col("l_cx").alias("cx"), F.col("l_cy").alias("cy"), F.col("r_layer").alias("layer"), F.col("r_rings").alias("other"))
    near = near.withColumns({"__s": geometry.edges(F.col("rings")), "__t": geometry.edges(F.col("other"))})
    holds = geometry.strictly_inside(geometry.point(F.col("cx"), F.col("cy")), F.col("__t"))
    hit = near.withColumn("__holds", holds).filter("__holds").select("rings", "layer")
    share = near.withColumn("__holds", holds).filter(~F.col("__holds")).filter(geometry.polygons_meet(F.col("__s"), F.col("__t")))
    share = share.withColumn("__o", overlap_area("rings", "other")).filter(F.col("__o") / F.col("area") >= least_share).select("rings", "layer")
    polygons = hit.unionByName(share).select("rings", ranked(F.col("layer"), "_polygon").alias("p"))
    whole = li.groupBy("id", "layer").agg(F.array_sort(F.collect_list("segment")).alias("segments"))
    # a line's segments go to cells one by one; the least id of equal lines tells them apart within a layer
    parts = whole.groupBy("layer", "segments").agg(F.min("id").alias("line")).select("layer", "line", F.explode("segments").alias("segment"))
    ends = F.array(F.array(F.col("segment.a"), F.col("segment.b")))
    met = box_join(_boxed(w, F.col("rings"), "rings"), _boxed(parts, ends, "layer", "line", "segment"), cell)
    met = met.select(F.col("l_rings").alias("rings"), F.col("r_layer").alias("layer"), F.col("r_line").alias("line"), F.col("r_segment").alias("segment"))
    inner = met.withColumn("__n", geometry.clipped_length(F.col("segment"), geometry.edges(F.col("rings"))))
    long = inner.groupBy("rings", "layer", "line").agg(F.sum("__n").alias("n")).filter(F.col("n") >= least_length).select("rings", ranked(F.col("layer"), "_line").alias("p"))
    return decided(water.select("id", "rings"), polygons.unionByName(long), "rings")
