"""Overlay, floor lift, skirt and composition of a water surface with the terrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import raster

SKIRT = 5


def overlay(cells: DataFrame) -> DataFrame:
    """(poly, still, r, c, z) -> (r, c, z): still water over rivers, later polygons over earlier ones."""
    return cells.groupBy("r", "c").agg(F.max_by("z", F.struct("still", "poly")).alias("z"))


def floor_lift(cells: DataFrame) -> DataFrame:
    """Cells (dem, surface, write, river, lake) with ``after``: dem where written, below dem, and neither lake nor overbank (river with dem above the surface)."""
    over = F.col("river") & F.coalesce(F.col("dem") > F.col("surface"), F.lit(False))
    lift = F.col("write") & F.coalesce(F.col("surface") < F.col("dem"), F.lit(False)) & ~F.col("lake") & ~over
    return cells.withColumns({"overbank": over, "lifted": lift, "after": F.when(lift, F.col("dem")).otherwise(F.col("surface"))})


def compose(dem: DataFrame, surface: DataFrame, with_dem: bool = True) -> DataFrame:
    """(r, c, z): the surface where there is one, else the terrain or nothing."""
    j = dem.select("r", "c", F.col("z").alias("d")).join(surface.select("r", "c", F.col("z").alias("s")), ["r", "c"], "full")
    return j.select("r", "c", (F.coalesce("s", "d") if with_dem else F.col("s")).alias("z"))


def metrics(dem: DataFrame, surface: DataFrame, with_dem: bool = True, mask: DataFrame | None = None) -> DataFrame:
    """Counts over the terrain's cells: ``write`` water cells with a surface, ``water_fill`` water cells left to the terrain,
    ``background`` other cells with terrain, ``water_nodata`` and ``nodata`` water and all cells left empty.

    ``mask`` (r, c) are the water cells; without it those of the surface are. Only terrain cells that are written count as filled.
    """
    water = (surface if mask is None else mask).select("r", "c", F.lit(True).alias("m"))
    j = dem.select("r", "c", F.col("z").alias("d")).join(surface.select("r", "c", F.col("z").alias("s")), ["r", "c"], "left").join(water, ["r", "c"], "left")
    m, write = F.coalesce("m", F.lit(False)), F.coalesce(F.col("m"), F.lit(False)) & F.col("s").isNotNull()
    ground = F.col("d").isNotNull() & F.lit(with_dem)
    empty = ~write & ~ground
    return j.agg(F.count_if(write).alias("write"), F.count_if(m & ~write & ground).alias("water_fill"), F.count_if(~m & ground).alias("background"), F.count_if(m & empty).alias("water_nodata"), F.count_if(empty).alias("nodata"))


def _disc(n: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= n * n])


def nearest(targets: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """(r, c, d2, z): the nearest seed (r, c, z) by Euclidean distance of each target that has one within ``reach``, ties by row, then column.

    A target that is no seed has its nearest seed on the seeds' shore, so only the shore is spread over its disc:
    a bounded fan-out, no cross join.
    """
    s = seeds.select("r", "c", "z")
    shore = raster.ring(s.select(F.lit(0).alias("poly"), "r", "c")).select("r", "c")
    own = targets.select("r", "c").join(s, ["r", "c"]).select("r", "c", F.lit(0).alias("d2"), "z")
    far = s.join(shore, ["r", "c"], "left_semi").select(F.col("r").alias("sr"), F.col("c").alias("sc"), "z", F.explode(_disc(reach)).alias("o"))
    far = far.select((F.col("sr") + F.col("o.i")).alias("r"), (F.col("sc") + F.col("o.j")).alias("c"), (F.col("o.i") * F.col("o.i") + F.col("o.j") * F.col("o.j")).alias("d2"), "sr", "sc", "z")
    far = far.join(targets.select("r", "c").join(s, ["r", "c"], "left_anti"), ["r", "c"], "left_semi")
    far = far.groupBy("r", "c").agg(F.min_by(F.struct("d2", "z"), F.struct("d2", "sr", "sc")).alias("m")).select("r", "c", "m.d2", "m.z")
    return own.unionByName(far)


def skirt(surface: DataFrame, dem: DataFrame, h: int, w: int, n: int = SKIRT) -> DataFrame:
    """(r, c, z, band): the surface, a flat band of its nearest level within n steps, and a ramp down to the terrain within 2n. n = 0 changes nothing."""
    core = surface.select("r", "c", F.col("z").cast("float").alias("z"))
    if n == 0:
        return core.withColumn("band", F.lit("water"))
    m = core.select(F.lit(0).alias("poly"), "r", "c")
    wide, flat = raster.dilate(m, 2 * n, h, w).drop("poly"), raster.dilate(m, n, h, w).drop("poly").withColumn("flat", F.lit(True))
    near = nearest(wide, core, 2 * n).join(flat, ["r", "c"], "left").join(dem.select("r", "c", F.col("z").cast("float").alias("d")), ["r", "c"], "left")
    t = (F.least(F.lit(float(n)), F.greatest(F.lit(0.0), (F.sqrt("d2").cast("float") - F.lit(float(n))).cast("float"))).cast("float") / F.lit(float(n + 1))).cast("float")
    blend = ((F.col("z") * (F.lit(1.0) - t).cast("float")).cast("float") + (F.col("d") * t).cast("float")).cast("float")
    z = F.when(F.col("d2") == 0, F.col("z")).when(F.col("flat") | F.col("d").isNull(), F.col("z")).otherwise(F.greatest(blend, F.col("z")))
    band = F.when(F.col("d2") == 0, "water").when(F.col("flat"), "flat").otherwise("ramp")
    return near.select("r", "c", z.alias("z"), band.alias("band"))


def skirt_counts(skirted: DataFrame) -> DataFrame:
    """Cells that the flat band and the ramp added."""
    return skirted.agg(F.count_if(F.col("band") == "flat").alias("flat"), F.count_if(F.col("band") == "ramp").alias("ramp"))
