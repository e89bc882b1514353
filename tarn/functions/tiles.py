"""Quadkeys and tile arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 22


def quadkey(x: Column, y: Column, z: Column) -> Column:
    """Digits from the highest bit; a digit is xbit + 2 ybit."""
    bit = lambda v, i: (F.call_function("shiftright", v, i) % 2)
    return F.array_join(F.transform(F.sequence(z - 1, F.lit(0), F.lit(-1)), lambda i: (bit(x, i) + 2 * bit(y, i)).cast("string")), "")


def valid(key: Column) -> Column:
    return key.rlike(f"^[0-3]{{1,{MOST}}}$")


def base4(key: Column) -> Column:
    """The key as a number; null for what is no key."""
    return F.when(valid(key), F.conv(key, 4, 10).cast("long"))


def tile(key: Column) -> Column:
    """struct(x, y, z); null for what is no key."""
    digits = F.transform(F.split(key, ""), lambda d: d.cast("long"))
    fold = lambda pick: F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 2 + pick(d))
    return F.when(valid(key), F.struct(fold(lambda d: d % 2).alias("x"), fold(lambda d: F.floor(d / 2)).alias("y"), F.length(key).alias("z")))


def fault(key: Column) -> Column:
    """Why a text is no key: empty, longer than allowed, or its first bad digit and place; null for a key."""
    bad = F.regexp_instr(key, F.lit("[^0-3]"))
    digit = F.concat(F.lit("bad digit "), F.substring(key, bad, F.lit(1)), F.lit(" at "), (bad - 1).cast("string"))
    return F.when(F.coalesce(F.length(key), F.lit(0)) == 0, "empty").when(F.length(key) > MOST, F.concat(F.lit("length "), F.length(key).cast("string"), F.lit(f" over {MOST}"))).when(bad > 0, digit)


def children(keys: DataFrame, zoom: int, key_col: str = "quadkey", strict: bool = False) -> DataFrame:
    """All descendants at ``zoom`` of keys no deeper than it, a key at ``zoom`` being its own; deeper keys and texts that are no keys
    give none, or with ``strict`` an error when they are met."""
    k = F.lit(zoom) - F.length(key_col)
    fits = valid(F.col(key_col)) & (F.length(key_col) <= zoom)
    if strict:
        fits = F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("no key at or above zoom "), F.lit(str(zoom)), F.lit(": "), F.coalesce(F.col(key_col), F.lit("null")))).cast("boolean"))
    rows = keys.filter(fits)
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(4), k).cast("long") - 1))
    rows = rows.withColumn("__i", n)
    return rows.withColumn("child", F.concat(F.col(key_col), F.when(k > 0, F.lpad(F.conv(F.col("__i").cast("string"), 10, 4), k, "0")).otherwise(""))).drop("__i")


def counters(tiles: DataFrame, wet: DataFrame) -> DataFrame:
    """Tiles in all, those that a polygon meets (tile in ``wet``) and the dry ones."""
    j = tiles.select("tile").join(wet.select("tile").distinct().withColumn("wet", F.lit(True)), "tile", "left")
    return j.agg(F.count("*").alias("total"), F.count("wet").alias("water"), F.count_if(F.col("wet").isNull()).alias("dry"))


def plan(spark, width: int, height: int, size: int = 8192, pad: int = 64) -> DataFrame:
    """Tiles (tile, col0, row0, w, h) and their padded windows (pc0, pr0, pw, ph) of a raster."""
    across = -(-width // size)
    t = spark.range(across * -(-height // size)).select(F.col("id").alias("tile"), (F.col("id") % across * size).cast("int").alias("col0"), (F.floor(F.col("id") / across) * size).cast("int").alias("row0"))
    t = t.withColumns({"w": F.least(F.lit(size), width - F.col("col0")), "h": F.least(F.lit(size), height - F.col("row0")), "pc0": F.greatest(F.lit(0), F.col("col0") - pad), "pr0": F.greatest(F.lit(0), F.col("row0") - pad)})
    return t.withColumns({"pw": F.least(F.lit(width), F.col("col0") + F.col("w") + pad) - F.col("pc0"), "ph": F.least(F.lit(height), F.col("row0") + F.col("h") + pad) - F.col("pr0")})


def overlaps(boxes: DataFrame, spark, width: int, height: int, size: int = 8192) -> DataFrame:
    """(poly, tile) of pixel boxes (c0, r0, c1, r1; closed): tile numbers by arithmetic, so no theta join."""
    across, down = -(-width // size), -(-height // size)
    cell = lambda v, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(v / size))).cast("int")
    b = boxes.filter((F.col("c1") >= 0) & (F.col("r1") >= 0) & (F.col("c0") <= width) & (F.col("r0") <= height))
    b = b.withColumn("tx", F.explode(F.sequence(cell(F.col("c0"), across), cell(F.col("c1"), across)))).withColumn("ty", F.explode(F.sequence(cell(F.col("r0"), down), cell(F.col("r1"), down))))
    return b.select("poly", (F.col("ty").cast("long") * across + F.col("tx")).alias("tile"))
