"""Positions and running sums over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def bucketed(df: DataFrame, key: str, out: str = "__bucket", buckets: int = BUCKETS) -> DataFrame:
    """``df`` with a bucket that rises with the numeric column ``key``: cut at quantiles, so buckets hold about as many rows each.

    Rows with one key share a bucket; nulls come first. The cuts are ``buckets`` numbers at most.
    """
    at = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), at, 10 * buckets)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return df.withColumn(out, F.lit(0))
    x = F.col(key).cast("double")
    # binary search by halving: log2(cuts) steps in one expression
    steps = max(1, len(cuts).bit_length())
    table = F.array(*[F.lit(float(c)) for c in cuts])
    step = lambda s, _: F.when(s["a"] >= s["b"], s).when(F.element_at(table, (F.floor((s["a"] + s["b"]) / 2) + 1).cast("int")) < x, F.struct((F.floor((s["a"] + s["b"]) / 2) + 1).cast("int").alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), F.floor((s["a"] + s["b"]) / 2).cast("int").alias("b")))
    start = F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("b"))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, step, lambda s: s["a"])
    return df.withColumn(out, F.when(x.isNull(), -1).otherwise(place))


def running(df: DataFrame, key: str, order: list[Column], amount: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``amount`` (long) up to each row, itself included, in the order (``key``, ``order``).

    Sums of buckets are few and joined back; only the rows of a bucket are sorted together.
    """
    d = bucketed(df, key).withColumn("__amount", amount.cast("long"))
    sums = d.groupBy("__bucket").agg(F.sum("__amount").alias("__sum"))  # BUCKETS + 1 rows at most
    before = F.sum("__sum").over(Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    inner = Window.partitionBy("__bucket").orderBy(F.col(key), *order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn(out, F.sum("__amount").over(inner)).join(F.broadcast(sums), "__bucket")
    return d.withColumn(out, F.col(out) + F.col("__before")).drop("__bucket", "__amount", "__before")


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with the position of each row in the order of ``key``, from 1."""
    return running(df, key, [], F.lit(1), out)
