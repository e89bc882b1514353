"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of a source are put in a seeded random order; row r of a source with n rows
gets the fraction (r + 1/2) / n; all rows are ordered by that fraction and the
order is cut into shards whose row counts differ by one at most (law ``rows``).
Any stretch of the order, so any shard, holds each source in proportion, to
within a row or so for each source.

Both ranks are exact and distributed: rows fall into narrow buckets of the
order, bucket sums give offsets, and only a bucket's rows are sorted together,
so a source with a third of all rows is spread over many tasks. Texts are never
shuffled. Defined results: null text has size 1 and the checksum of the empty
string; null is a source of its own; ties of the random order go by its columns, and
rows equal in all of them are placed one by one in any order; very long texts only
count by their size; an empty table gives no rows. Extra columns of
:func:`shard_rows` are carried; one with the name of a result column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, materialize, numbered, running_total, shuffle_key, table, unit_bucket

SEED = "shard-1"


def interleave(rows: DataFrame, n_rows: int, strata: str, seed: str, tie: list[str]) -> DataFrame:
    """``rows`` with ``place``, the 0-based position in the interleaved order.

    ``tie`` names the columns that make the seeded order reproducible.
    """
    b = bucket_count(n_rows)
    keyed = rows.withColumn("__key", shuffle_key(seed, *[F.col(c) for c in tie])).withColumn("__b", unit_bucket(F.col("__key"), b))
    order = [F.col("__key"), *[F.col(c) for c in tie]]
    ranked = running_total(keyed, [strata], "__b", order, F.lit(1), "__rank", total="__size")
    ranked = ranked.withColumn("__frac", (F.col("__rank") + F.lit(0.5)) / F.col("__size")).withColumn("__b", F.floor(F.col("__frac") * F.lit(b)).cast("long"))
    order = [F.col("__frac"), F.col(strata).asc_nulls_last(), F.col("__rank")]
    return running_total(ranked, [], "__b", order, F.lit(1), "place").drop("__b", "__key", "__rank", "__size", "__frac")


def cut(place: Column, n_rows: int, shards: int) -> tuple[Column, Column]:
    """(shard, slot) of a position: shard k holds positions [ceil(k n / s), ceil((k + 1) n / s))."""
    shard = F.floor(place * F.lit(shards) / F.lit(max(1, n_rows)))
    return shard.cast("int"), (place - F.floor((shard * F.lit(n_rows) + F.lit(shards - 1)) / F.lit(shards))).cast("long")


def shard_rows(rows: DataFrame, strata: str = "source", tie: list[str] | None = None, shards: int = 8, seed: str = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``. Pass narrow rows: every column travels through the shuffles."""
    n, names, d = rows.count(), rows.columns, numbered(rows)
    new = dict(zip(names, d.columns))
    placed = interleave(d, n, new[strata], seed, [new[c] for c in tie or names if c != strata])
    shard, slot = cut(F.col("place"), n, shards)
    return placed.select(*[F.col(new[c]).alias(c) for c in names if c not in ("shard", "slot")], shard.alias("shard"), slot.alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialize(rows, "shard-rows")
    out = shard_rows(rows, "source", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
