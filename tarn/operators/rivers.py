"""Rivers: one grouped-map task for each polygon on its own window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster

PAD = 2


def _window(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
    shape = int(pdf["r"].max()) - r0 + 1, int(pdf["c"].max()) - c0 + 1
    mask, dem = np.zeros(shape, bool), np.full(shape, np.nan)
    at = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0
    mask[at] = pdf["inside"].to_numpy(bool)
    dem[at] = pdf["z"].to_numpy(float, na_value=np.nan)
    return mask, dem, r0, c0


def windows(mask: DataFrame, dem: DataFrame, pad: int = PAD, grid: tuple[int, int] | None = None) -> DataFrame:
    """(poly, r, c, inside, z) of each polygon's bounding window, within a raster of ``grid`` (rows, columns) where that is given."""
    box = mask.groupBy("poly").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.min("c").alias("x"), F.max("c").alias("y"))
    if grid:
        box = box.select("poly", F.greatest("a", F.lit(pad)).alias("a"), F.least("b", F.lit(grid[0] - 1 - pad)).alias("b"), F.greatest("x", F.lit(pad)).alias("x"), F.least("y", F.lit(grid[1] - 1 - pad)).alias("y"))
    cells = box.select("poly", F.explode(F.sequence(F.col("a") - pad, F.col("b") + pad)).alias("r"), "x", "y").select("poly", "r", F.explode(F.sequence(F.col("x") - pad, F.col("y") + pad)).alias("c"))
    return cells.join(mask.withColumn("inside", F.lit(True)), ["poly", "r", "c"], "left").join(dem, ["r", "c"], "left").select("poly", "r", "c", F.coalesce("inside", F.lit(False)).alias("inside"), F.col("z").cast("double").alias("z"))


def _grouped(mask: DataFrame, dem: DataFrame, f, out: str, grid: tuple[int, int] | None = None) -> DataFrame:
    return windows(mask, dem, grid=grid).groupBy("poly").applyInPandas(f, out)


def surface(mask: DataFrame, dem: DataFrame, pixel: float = 1.0, grid: tuple[int, int] | None = None) -> DataFrame:
    """(poly, r, c, z) of river polygons."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        from tarn.operators.kernels import river_surface

        m, d, r0, c0 = _window(pdf)
        z = river_surface(m, d, pixel)
        r, c = np.nonzero(np.isfinite(z))
        return pd.DataFrame({"poly": pdf["poly"].iloc[0], "r": (r + r0).astype("int32"), "c": (c + c0).astype("int32"), "z": z[r, c].astype("float32")})

    return _grouped(mask, dem, solve, "poly long, r int, c int, z float", grid)


def skeleton(mask: DataFrame, dem: DataFrame) -> DataFrame:
    """(poly, seq, r, c, half_width, tr, tc, junction): ordered stations."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tarn.operators import kernels as k

        m, d, r0, c0 = _window(pdf)
        s = np.array(k.order_skeleton(k.medial_axis(m), d), int).reshape(-1, 2)
        t = k.tangents(s)
        half = np.maximum(2.0, k.edt(m)[s[:, 0], s[:, 1]])
        return pd.DataFrame({"poly": pdf["poly"].iloc[0], "seq": np.arange(len(s), dtype="int32"), "r": (s[:, 0] + r0).astype("int32"), "c": (s[:, 1] + c0).astype("int32"), "half_width": half, "tr": t[:, 0], "tc": t[:, 1], "junction": k.junctions(s, t)})

    return _grouped(mask, dem, run, "poly long, seq int, r int, c int, half_width double, tr double, tc double, junction boolean")


def harmonic(cells: DataFrame) -> DataFrame:
    """(poly, r, c, z): cells (poly, r, c, pin) filled by the Laplace equation; ``pin`` is null where free."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tarn.operators.kernels import harmonic as fill

        r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
        r, c = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0
        mask = np.zeros((r.max() + 1, c.max() + 1), bool)
        value = np.full(mask.shape, np.nan)
        mask[r, c] = True
        value[r, c] = pdf["pin"].to_numpy(float, na_value=np.nan)
        z = fill(mask, np.isfinite(value), value)
        return pd.DataFrame({"poly": pdf["poly"], "r": pdf["r"], "c": pdf["c"], "z": z[r, c]})

    return cells.groupBy("poly").applyInPandas(run, "poly long, r int, c int, z double")


def degree(skel: DataFrame) -> DataFrame:
    """(poly, r, c, degree): set 8-neighbours of each cell."""
    o = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    n = skel.withColumn("o", F.explode(o)).select("poly", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    n = n.groupBy("poly", "r", "c").agg(F.count("*").alias("degree"))
    return skel.join(n, ["poly", "r", "c"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def boundary(mask: DataFrame) -> DataFrame:
    return raster.ring(mask)
