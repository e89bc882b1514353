"""Tiles as they are asked for: a folder of requests as a stream, each batch through the tiled job.

A request is a JSON line (tile, asked timestamp). The checkpoint remembers the files that were done, so a restart goes on
where it stopped; a batch's result is one folder named by its number, written over when the batch is repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "tile long, asked timestamp"


def requests(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_a_batch).json(folder)


def serve(asked: DataFrame, work: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> None:
    """Run ``work`` on the distinct tiles of each batch and write its result; ends when all requests there are have been served."""

    def batch(df: DataFrame, number: int) -> None:
        tiles = df.select("tile").distinct()
        if not tiles.isEmpty():
            work(tiles).write.mode("overwrite").parquet(f"{output}/batch={number}")

    asked.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def load(asked: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Requests and distinct tiles (estimated) by event-time window; requests later than ``late`` are left out."""
    return asked.withWatermark("asked", late).groupBy(F.window("asked", window)).agg(F.count("*").alias("requests"), F.approx_count_distinct("tile").alias("tiles"))
