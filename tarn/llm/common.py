"""Shared pieces: table access, scratch tables, text expressions, distributed ranks."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_TOKEN = r"[^\x20\x09-\x0D]+"

BROADCAST_BYTES = 32 << 20

_written: list[tuple[SparkSession, str, DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where that is unset (tests) a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tarn-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written.append((spark, path, out))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` whose every use has itself been written."""
    for i in [i for i, (_, _, df) in enumerate(_written) if any(df is t for t in tables)][::-1]:
        spark, path, _ = _written.pop(i)
        _delete(spark, path)


def mark() -> int:
    """A place in the order of written tables, for :func:`free_since`."""
    return len(_written)


def free_since(place: int, *kept: DataFrame) -> None:
    """Delete the tables written since ``place`` other than ``kept``; the caller has written all that was made of them."""
    free(*[df for _, _, df in _written[place:] if not any(df is k for k in kept)])


def sweep(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that Spark deletes the shuffle files of plans whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Delete the tables written by :func:`materialize`; call it once results are stored."""
    while _written:
        spark, path, _ = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; the folder then goes with the cluster's own clean-up
            return


def if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, marked for broadcast where its rows, of ``row_bytes`` each, stay below ``BROADCAST_BYTES``; else as it is, for a sorted join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


atexit.register(release)


def tree_sum(states: DataFrame, width: int, add, fan: int = 64) -> DataFrame:
    """(block, part, data): blocks of the states of ``width`` tasks, summed by ``add(block, [data, ...])`` in a tree, ``fan`` at a time.

    ``states`` has (block int, data binary), a few rows for each task.
    """
    import pyarrow as pa

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        block, part = group.column("block")[0].as_py(), group.column("part")[0].as_py()
        return pa.table({"block": pa.array([block], pa.int32()), "part": pa.array([part // fan], pa.int32()), "data": pa.array([add(block, [x.as_py() for x in group.column("data")])], pa.binary())})

    out = states.select("block", F.spark_partition_id().alias("part"), "data")
    while width:
        out = out.groupBy("block", F.expr(f"part div {fan}")).applyInArrow(merge, "block int, part int, data binary")
        width = 0 if width <= fan else -(-width // fan)
    return out


def give_back() -> None:
    """Return a Python worker's free memory to the system: workers live on from stage to stage beside their executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: whatever they were called, no name that an operator adds can clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def shuffle_key(seed: str, *cols: Column) -> Column:
    """A seeded uniform key of 32 hex digits; nulls have a spelling of their own."""
    return F.md5(F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]).cast("binary"))


def unit_bucket(hex_key: Column, buckets: int) -> Column:
    """Bucket of a hex key, monotone in the key."""
    return F.floor(F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("long") * F.lit(int(buckets)) / F.lit(2**32)).cast("long")


def bucket_count(rows: int, per_bucket: int = 256, most: int = 65536) -> int:
    """Buckets that split even one key holding all ``rows`` into sortable pieces; ``most`` bounds the prefix table's rows per key."""
    return max(1, min(most, -(-rows // per_bucket)))


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], amount: Column, out: str, total: str | None = None) -> DataFrame:
    """Exclusive running sum of ``amount`` per ``keys`` in the order (bucket, order), without one task per key.

    Sums per (keys, bucket) are small; their prefix sums are joined back, and
    only the rows of a bucket are sorted together. ``total`` adds the key's sum.
    Null keys form a group of their own.
    """
    safe = {k: f"__k_{k}" for k in keys}
    d = df.withColumns({**{s: F.coalesce(F.col(k).cast("string"), F.lit("\x00null")) for k, s in safe.items()}, "__amount": amount.cast("long")})
    by = [*safe.values(), bucket]
    sums = d.groupBy(*by).agg(F.sum("__amount").alias("__sum"))
    w = Window.partitionBy(*safe.values()) if keys else Window.partitionBy()
    sums = sums.withColumn("__before", F.sum("__sum").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)))
    if total:
        sums = sums.withColumn(total, F.sum("__sum").over(w))
    inner = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__within", F.sum("__amount").over(inner))
    d = d.join(sums.drop("__sum"), by)
    d = d.withColumn(out, F.coalesce(F.col("__before"), F.lit(0)) + F.coalesce(F.col("__within"), F.lit(0)))
    return d.drop(*safe.values(), "__amount", "__before", "__within")
