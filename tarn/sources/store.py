"""Small files through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Write a file at a path that Spark knows, local or not."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(data)
    finally:
        stream.close()
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
