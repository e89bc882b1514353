"""Still water: medians, levels and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order, raster

ROUNDS, SAME = 5, 1e-6


def trimmed_median(values: Column, rounds: int = ROUNDS) -> Column:
    """Median of an array; then, up to ``rounds`` times, the median of all values no larger than it; stops when it moves less than 1e-6."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)))
    mid = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor((F.size(a) + 2) / 2).cast("int"))) / 2
    # each step's median stands in a one-element array, so that it is computed once
    step = lambda st, _: F.when(st["done"], st).otherwise(F.transform(F.array(mid(F.filter(s, lambda v: v <= st["z"]))), lambda z: F.struct(z.alias("z"), (F.abs(z - st["z"]) < SAME).alias("done")))[0])
    start = F.struct(mid(s).alias("z"), F.lit(False).alias("done"))
    return F.when(F.size(s) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda st: st["z"]))


def levels(mask: DataFrame, dem: DataFrame, group: DataFrame | None = None) -> DataFrame:
    """(poly, n_ring, ring_z, n_inside, inside_z, z, source): trimmed median of the shore ring, else the interior median. ``group`` (poly, grp) pools the polygons of a component."""
    cells = mask.join(dem, ["r", "c"])
    edge = raster.ring(mask).join(dem, ["r", "c"])
    if group is not None:
        cells, edge = (x.join(group, "poly").withColumn("poly", F.col("grp")).drop("grp") for x in (cells, edge))
    a = edge.groupBy("poly").agg(F.count("z").alias("n_ring"), trimmed_median(F.collect_list("z")).alias("ring_z"))
    b = cells.groupBy("poly").agg(F.count("z").alias("n_inside"), F.median("z").alias("inside_z"))
    out = mask.select("poly").distinct() if group is None else group.select(F.col("grp").alias("poly")).distinct()
    out = out.join(a, "poly", "left").join(b, "poly", "left").withColumns({"n_ring": F.coalesce("n_ring", F.lit(0)), "n_inside": F.coalesce("n_inside", F.lit(0))})
    return out.withColumns({"z": F.coalesce("ring_z", "inside_z"), "source": F.when(F.col("ring_z").isNotNull(), "ring").when(F.col("inside_z").isNotNull(), "interior").otherwise("none")})


def component_groups(polys: DataFrame) -> DataFrame:
    """(poly, grp) of (poly, component): those of a component share it; one without is a group of its own, numbered -1, -2, ... in the order of polygons."""
    alone = order.numbered(polys.filter("component IS NULL").select("poly"), "poly", "k").select("poly", (-F.col("k")).cast("long").alias("grp"))
    return polys.filter("component IS NOT NULL").select("poly", F.col("component").cast("long").alias("grp")).unionByName(alone)


def flatten(mask: DataFrame, level: DataFrame) -> DataFrame:
    """(r, c, z): each cell at the level of its last polygon that has one."""
    return mask.join(level.filter("z IS NOT NULL").select("poly", F.col("z").cast("float").alias("z")), "poly").groupBy("r", "c").agg(F.max_by("z", "poly").alias("z"))


def summary(mask: DataFrame, level: DataFrame) -> DataFrame:
    """Lake, filled and skipped polygons, filled pixels (overlaps counted for each polygon)."""
    n = mask.groupBy("poly").agg(F.count("*").alias("n"))
    return level.join(n, "poly").agg(F.count("*").alias("lakes"), F.count("z").alias("filled"), F.count_if(F.col("z").isNull()).alias("skipped"), F.coalesce(F.sum(F.when(F.col("z").isNotNull(), F.col("n"))), F.lit(0)).alias("pixels"))
