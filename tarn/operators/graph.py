"""Graphs as edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder


def _written(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "hops")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hops(nodes: DataFrame, edges: DataFrame, outlets: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops): least steps from an outlet over undirected edges (a, b); -1 out of reach, with ``most`` also beyond that many steps.

    One join a level: the new frontier is what the last one meets and no level has met, so cycles end.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "next").filter("node <> next").distinct()
    found = [_written(outlets.select("node").distinct().withColumn("hops", F.lit(0)))]
    while most is None or len(found) <= most:
        seen = reduce(DataFrame.union, found)
        step = found[-1].join(both, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        step = _written(step.withColumn("hops", F.lit(len(found))))
        if step.isEmpty():
            break
        found.append(step)
    return nodes.select("node").join(reduce(DataFrame.union, found), "node", "left").withColumn("hops", F.coalesce("hops", F.lit(-1)))
