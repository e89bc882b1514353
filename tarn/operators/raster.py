"""Raster operators on long-form cells (r, c, z) and masks (poly, r, c); absence is nodata or false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crs
from . import blocks


def rasterize(rings: DataFrame, h: int, w: int, transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """(poly, r, c) of pixel centres inside by the even-odd rule. ``rings``: (poly, ring array<struct<x,y>>, closed), one row per ring.

    Each edge gives its crossing with each row of centres; crossings of a row pair up in order.
    """
    a, _, c0, _, e, f0 = transform
    v = F.transform("ring", lambda p: F.struct((p["x"] * F.lit(1 / a) - F.lit(c0 / a)).alias("x"), (p["y"] * F.lit(1 / e) - F.lit(f0 / e)).alias("y")))
    edges = rings.select("poly", v.alias("v")).select("poly", F.explode(F.arrays_zip(F.slice("v", 1, F.size("v") - 1).alias("a"), F.slice("v", 2, F.size("v") - 1).alias("b"))).alias("e"))
    edges = edges.select("poly", F.col("e.a.x").alias("xa"), F.col("e.a.y").alias("ya"), F.col("e.b.x").alias("xb"), F.col("e.b.y").alias("yb")).filter("ya <> yb")
    lo, hi = F.ceil(F.least("ya", "yb") - 0.5), F.ceil(F.greatest("ya", "yb") - 0.5) - 1
    rows = edges.withColumns({"lo": F.greatest(F.lit(0), lo).cast("int"), "hi": F.least(F.lit(h - 1), hi).cast("int")}).filter("lo <= hi").withColumn("r", F.explode(F.sequence("lo", "hi")))
    rows = rows.withColumn("x", F.col("xa") + (F.col("r") + 0.5 - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya")))
    by = Window.partitionBy("poly", "r").orderBy("x")
    rows = rows.select("poly", "r", "x", F.lead("x").over(by).alias("x2"), F.row_number().over(by).alias("k")).filter("k % 2 = 1 AND x2 IS NOT NULL")
    first, last = F.greatest(F.lit(0), F.floor(F.col("x") - 1e-12 + 0.5)), F.least(F.lit(w), F.floor(F.col("x2") - 1e-12 + 0.5)) - 1
    rows = rows.withColumns({"a": first.cast("int"), "b": last.cast("int")}).filter("a <= b")
    return rows.select("poly", "r", F.explode(F.sequence("a", "b")).alias("c")).distinct()


def rectangle_rings(rects: DataFrame) -> DataFrame:
    """(poly, ring) of pixel rectangles (c0, r0, w, h)."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1 = F.col("c0"), F.col("r0"), F.col("c0") + F.col("w"), F.col("r0") + F.col("h")
    return rects.select("poly", F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0)).alias("ring"))


WIDE = 1 << 24  # rows and columns of a grid whose size doesn't matter


def dilate(mask: DataFrame, n: int, h: int, w: int) -> DataFrame:
    """Cross dilation repeated n times: the L1 ball of radius n, within the grid."""
    return blocks.morph(mask, n, h, w, True)


def erode(mask: DataFrame, n: int) -> DataFrame:
    """Cross erosion repeated n times; outside the grid is false. A cell stays if all cells of its ball are set."""
    return blocks.morph(mask, n, WIDE, WIDE, False)


def ring(mask: DataFrame) -> DataFrame:
    """The mask without its erosion: cells with an unset neighbour. Four neighbours are asked for, no array is built."""
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])
    d = mask.select("poly", "r", "c", F.explode(step).alias("o")).select("poly", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    return d.groupBy("poly", "r", "c").agg(F.count("*").alias("k"), F.bool_or("own").alias("own")).filter("own AND k < 5").select("poly", "r", "c")


def reflect(i: Column, n: int) -> Column:
    m = F.pmod(i, F.lit(2 * n))
    return F.when(m >= n, 2 * n - 1 - m).otherwise(m)


rank_filter, gaussian = blocks.rank_filter, blocks.gaussian


def closing(mask: DataFrame, n: int, h: int, w: int) -> DataFrame:
    """Dilation by n, then erosion by n; beyond the grid counts as false."""
    return erode(dilate(mask, n, h, w), n)


def rasterize_touched(rings: DataFrame, h: int, w: int, transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """(poly, r, c) of cells whose centre lies inside or that an edge passes through. ``rings`` as for :func:`rasterize`."""
    a, _, c0, _, e, f0 = transform
    v = F.transform("ring", lambda p: F.struct(((p["x"] - F.lit(c0)) / F.lit(a)).alias("x"), ((p["y"] - F.lit(f0)) / F.lit(e)).alias("y")))
    edges = rings.select("poly", v.alias("v")).select("poly", F.explode(F.arrays_zip(F.slice("v", 1, F.size("v") - 1).alias("a"), F.slice("v", 2, F.size("v") - 1).alias("b"))).alias("e"))
    edges = edges.select("poly", F.col("e.a.x").alias("xa"), F.col("e.a.y").alias("ya"), F.col("e.b.x").alias("xb"), F.col("e.b.y").alias("yb"))

    def run(batches):
        import pandas as pd

        from tarn.operators.window import walk

        for pdf in batches:
            rows = [(p, r, c) for p, *e in pdf.itertuples(index=False) for r, c in walk(*e, h, w)]
            yield pd.DataFrame(rows, columns=["poly", "r", "c"]).astype({"poly": "int64", "r": "int32", "c": "int32"})

    return rasterize(rings, h, w, transform).unionByName(edges.mapInPandas(run, "poly long, r int, c int")).distinct()


def reproject(cells: DataFrame, source_t: tuple[float, ...], source: int, target_t: tuple[float, ...], width: int, height: int, target: int, method: str = "bilinear") -> DataFrame:
    """(r, c, z) of the target grid: each of its centres goes back to the source by expressions, and meets its neighbours in a join.

    Bilinear weights go to the neighbours that have a value; a centre none of whose neighbours has one, or outside the source, gives no row.
    """
    a, _, c0, _, e, f0 = target_t
    sa, _, sc, _, se, sf = source_t
    grid = cells.sparkSession.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    x, y = crs.project_columns((F.col("c") + 0.5) * a + c0, (F.col("r") + 0.5) * e + f0, target, source)
    grid = grid.select("r", "c", ((x - sc) / sa).alias("x"), ((y - sf) / se).alias("y"))
    side = cells.select(F.col("r").alias("sr"), F.col("c").alias("sc"), F.col("z").cast("double").alias("z"))
    extent = side.agg(F.max("sr"), F.max("sc"))
    if method == "nearest":
        return grid.select("r", "c", F.floor("y").alias("sr"), F.floor("x").alias("sc")).join(side, ["sr", "sc"]).select("r", "c", "z")
    h, w = (extent.first()[i] for i in (0, 1))
    grid = grid.filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < (w or 0) + 1) & (F.col("y") < (h or 0) + 1))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    q = grid.withColumns({"fx": F.col("x") - 0.5, "fy": F.col("y") - 0.5}).withColumn("o", F.explode(near))
    q = q.withColumns({"sr": F.floor("fy") + F.col("o.j"), "sc": F.floor("fx") + F.col("o.i")})
    q = q.withColumn("k", (1 - F.abs(F.col("fx") - F.col("sc"))) * (1 - F.abs(F.col("fy") - F.col("sr"))))
    s = q.join(side, ["sr", "sc"]).groupBy("r", "c").agg(F.sum(F.col("k") * F.col("z")).alias("t"), F.sum("k").alias("k"))
    return s.filter("k >= 1e-5").select("r", "c", (F.col("t") / F.col("k")).alias("z"))


def edt(mask: DataFrame, h: int, w: int) -> DataFrame:
    """(poly, r, c, d2, nr, nc): squared distance of mask cells to the nearest cell of the grid that isn't set, and that cell, ties by row, then column.

    Each polygon works in its own box with a margin of one cell, where its nearest clear cell always lies unless the
    polygon fills the grid there; null where no cell is clear.
    """
    def run(pdf):
        import numpy as np
        import pandas as pd

        from tarn.operators.kernels import nearest_clear

        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        r0, c0, r1, c1 = max(0, r.min() - 1), max(0, c.min() - 1), min(h, r.max() + 2), min(w, c.max() + 2)
        m = np.zeros((r1 - r0, c1 - c0), bool)
        m[r - r0, c - c0] = True
        d, nr, nc = (x[r - r0, c - c0] for x in nearest_clear(m))
        ok = np.isfinite(d)
        whole = lambda v: pd.array(np.where(ok, v, 0), dtype="Int64").astype("Int64")
        out = pd.DataFrame({"poly": pdf["poly"], "r": r, "c": c, "d2": whole(np.rint(np.where(ok, d, 0) ** 2).astype("int64")), "nr": whole(nr + r0), "nc": whole(nc + c0)})
        out.loc[~ok, ["d2", "nr", "nc"]] = pd.NA
        return out

    return mask.select("poly", "r", "c").groupBy("poly").applyInPandas(run, "poly long, r int, c int, d2 long, nr int, nc int")


def bilinear(points: DataFrame, dem: DataFrame, transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """(id, elev) at points (id, x, y); an integer index is a pixel's top left corner. Null unless all four neighbours have values."""
    a, _, c0, _, e, f0 = transform
    p = points.select("id", ((F.col("x") - c0) / a).alias("fx"), ((F.col("y") - f0) / e).alias("fy"))
    p = p.withColumns({"bx": F.floor("fx").cast("int"), "by": F.floor("fy").cast("int")})
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    q = p.withColumn("o", F.explode(corners)).select("id", (F.col("by") + F.col("o.j")).alias("r"), (F.col("bx") + F.col("o.i")).alias("c"), ((1 - F.abs(F.col("fx") - F.col("bx") - F.col("o.i"))) * (1 - F.abs(F.col("fy") - F.col("by") - F.col("o.j")))).alias("wt"))
    s = q.join(dem, ["r", "c"]).groupBy("id").agg(F.sum(F.col("wt") * F.col("z")).alias("elev"), F.count("*").alias("k"))
    return p.select("id").join(s.filter("k = 4").drop("k"), "id", "left")
