"""Neighbourhood filters over raster blocks: each block of cells with a halo is one numpy array in one task.

A cell is sent to its block and to those whose halo it lies in (four at most while
the halo is narrower than a block), so what moves is the raster once and its
seams, not one row for each cell of each window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 512


def blocks(cells: DataFrame, h: int, w: int, halo: int, size: int = SIZE) -> DataFrame:
    """(br, bc, r, c, z): cells under every block whose halo holds them; cells without a value are not sent."""
    if halo > size:
        size = halo
    span = lambda axis, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(axis) - halo) / size)), F.least(F.lit((n - 1) // size), F.floor((F.col(axis) + halo) / size))))
    d = cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("z").cast("double").alias("z"))
    return d.withColumn("br", span("r", h)).withColumn("bc", span("c", w)).select(F.col("br").cast("int").alias("br"), F.col("bc").cast("int").alias("bc"), "r", "c", "z")


def apply(cells: DataFrame, h: int, w: int, halo: int, kernel: Callable[[np.ndarray], np.ndarray], size: int = SIZE) -> DataFrame:
    """(r, c, z): ``kernel`` of a block padded by ``halo`` (NaN: no value; at the raster's edge mirrored) to an array of its shape, of which the core is kept where it has a value."""
    size = max(size, halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["br"].iloc[0]) * size, int(pdf["bc"].iloc[0]) * size
        r1, c1 = min(h, r0 + size), min(w, c0 + size)
        top, left, low, right = max(0, r0 - halo), max(0, c0 - halo), min(h, r1 + halo), min(w, c1 + halo)
        a = np.full((low - top, right - left), np.nan)
        a[pdf["r"].to_numpy() - top, pdf["c"].to_numpy() - left] = pdf["z"].to_numpy()
        # where the halo would leave the raster it is mirrored
        edges = ((halo - (r0 - top), halo - (low - r1)), (halo - (c0 - left), halo - (right - c1)))
        out = kernel(np.pad(a, edges, "symmetric"))[halo : halo + r1 - r0, halo : halo + c1 - c0]
        r, c = np.nonzero(~np.isnan(out))
        return pd.DataFrame({"r": (r + r0).astype("int32"), "c": (c + c0).astype("int32"), "z": out[r, c]})

    return blocks(cells, h, w, halo, size).groupBy("br", "bc").applyInPandas(run, "r int, c int, z double")


def rank_filter(dem: DataFrame, size: int, percentile: float, h: int, w: int) -> DataFrame:
    """The window's value of rank floor(size^2 p / 100) (p = 100: the largest), windows mirrored at the edge; a window without values gives none."""
    lo, hi = -(size // 2), size - 1 - size // 2
    p = percentile + 100 if percentile < 0 else percentile
    rank = size * size - 1 if p == 100 else int(size * size * p / 100)
    halo = size // 2

    def kernel(a: np.ndarray) -> np.ndarray:
        filled = np.where(np.isnan(a), np.inf, a)
        inner_h, inner_w = a.shape[0] - 2 * halo, a.shape[1] - 2 * halo
        out = np.full(a.shape, np.nan)
        for r in range(0, inner_h, 64):  # bands, so that windows are not all held at once
            band = filled[r : min(inner_h, r + 64) + 2 * halo]
            win = np.lib.stride_tricks.sliding_window_view(band, (size, size))[: min(64, inner_h - r), :inner_w]
            z = np.partition(win.reshape(*win.shape[:2], -1), rank, axis=2)[..., rank]
            out[halo + r : halo + r + z.shape[0], halo : halo + inner_w] = np.where(np.isinf(z), np.nan, z)
        return out

    assert -lo == halo and hi <= halo
    return apply(dem, h, w, halo, kernel)


def _smooth(a: np.ndarray, kern: np.ndarray, narrow: bool) -> np.ndarray:
    n = len(kern) // 2
    for axis in (0, 1):
        size = a.shape[axis]
        total = np.zeros(a.shape)
        for i, k in enumerate(kern):
            shift = i - n
            src = [slice(None)] * 2
            dst = [slice(None)] * 2
            src[axis], dst[axis] = slice(max(0, shift), size + min(0, shift)), slice(max(0, -shift), size - max(0, shift))
            total[tuple(dst)] += k * a[tuple(src)]
        a = total.astype(np.float32).astype(float) if narrow else total
    return a


def gaussian(dem: DataFrame, sigma: float, h: int, w: int, narrow: bool = False) -> DataFrame:
    """Separable smoothing, rows then columns, radius floor(4 sigma + 0.5), mirrored; sigma <= 0 changes nothing.

    ``narrow`` rounds to float32 on the way in and after each axis.
    """
    if sigma <= 0:
        return dem
    n = int(4 * sigma + 0.5)
    kern = np.array([math.exp(-0.5 * (i / sigma) ** 2) for i in range(-n, n + 1)])
    kern /= kern.sum()

    def kernel(a: np.ndarray) -> np.ndarray:
        return _smooth(a.astype(np.float32).astype(float) if narrow else a, kern, narrow)

    return apply(dem, h, w, n, kernel)


def morph(mask: DataFrame, n: int, h: int, w: int, grow: bool, size: int = 128) -> DataFrame:
    """(poly, r, c): masks dilated or eroded n times by the cross, block by block with a halo of n; beyond the grid is false.

    A block is one small array of one polygon, so a large polygon is many tasks, and a cell moves once and for its seams.
    """
    if n == 0:
        return mask.select("poly", "r", "c")
    size = max(size, n)
    reach = n if grow else 0  # erosion leaves cells only where there were some
    span = lambda axis, most: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(axis) - n) / size)), F.least(F.lit((most - 1) // size), F.floor((F.col(axis) + n) / size))))
    d = mask.select("poly", "r", "c").withColumn("br", span("r", h)).withColumn("bc", span("c", w))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tarn.operators import kernels

        r0, c0 = int(pdf["br"].iloc[0]) * size, int(pdf["bc"].iloc[0]) * size
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        # the part of the block, and its halo, where the mask can be or come
        top, left = max(r0 - n, int(r.min()) - reach), max(c0 - n, int(c.min()) - reach)
        low, right = min(r0 + size + n, int(r.max()) + reach + 1), min(c0 + size + n, int(c.max()) + reach + 1)
        a = np.zeros((low - top, right - left), bool)
        a[r - top, c - left] = True
        if grow:
            a = kernels.dilate(a, n)
        else:
            for _ in range(n):
                a = kernels.erode(a)
        rr, cc = np.nonzero(a)
        rr, cc = rr + top, cc + left
        keep = (rr >= r0) & (rr < min(h, r0 + size)) & (cc >= c0) & (cc < min(w, c0 + size))
        return pd.DataFrame({"poly": pdf["poly"].iloc[0], "r": rr[keep].astype("int32"), "c": cc[keep].astype("int32")})

    kind = mask.schema["poly"].dataType.simpleString()
    return d.groupBy("poly", "br", "bc").applyInPandas(run, f"poly {kind}, r int, c int")
