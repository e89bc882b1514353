"""Exact deduplication by progressive refinement, in DataFrame operations only.

Level 1 groups by byte length, level 2 by a hash of the normalised prefix,
level 3 by SHA-256 of the whole normalised text. A level is asked only of rows
whose group at the level before held more than one row; all others are done.
Group sizes are counted with map-side partial aggregates and joined back, so a
text that fills a third of the table is never one task's group.

The query's contract asks for every text's SHA-256, so there :func:`fingerprints`
takes it in the one pass. :func:`exact_dedup`, the pipeline stage, reads lengths
and prefixes first and hashes whole texts only of groups that survive both.

Defined results: null text counts as empty; texts that differ only in the case
of A-Z are equal; among equal texts the largest ``doc_id`` stays, and where that
row itself is repeated one row for each repetition is reported with the same
values (``kept`` is true for each of them), while :func:`exact_dedup` leaves one of
them; a null ``doc_id`` never wins against a number, and a group with none but
null ids has a null ``keep_id`` and keeps its rows (:func:`exact_dedup`: one);
very long texts are hashed whole; an empty table gives no rows. Extra columns,
whatever their names, are carried by :func:`exact_dedup` and dropped by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, if_small, materialize, numbered, table

PREFIX = 64


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, ``n`` bytes, ``head`` prefix hash, ``full`` SHA-256 of the normalised text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.octet_length(text).cast("long").alias("n"),
        F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX))).alias("head"),
        F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256)).alias("full"),
    )


def equal_groups(marks: DataFrame) -> DataFrame:
    """Groups of more than one equal text: (n, head, full) with ``keep`` and ``size``."""
    lengths = marks.groupBy("n").agg(F.count("*").alias("c")).filter("c > 1").select("n")
    level1 = marks.join(lengths, "n", "left_semi")
    heads = level1.groupBy("n", "head").agg(F.count("*").alias("c")).filter("c > 1").select("n", "head")
    level2 = level1.join(heads, ["n", "head"], "left_semi")
    return level2.groupBy("n", "head", "full").agg(F.max("id").alias("keep"), F.count("*").alias("size")).filter("size > 1")


def assign(marks: DataFrame) -> DataFrame:
    """Every row of ``marks`` with ``keep_id``, ``group_size`` and ``kept``."""
    groups = materialize(equal_groups(marks), "equal-groups")
    out = marks.join(groups, ["n", "head", "full"], "left")
    size = F.coalesce(F.col("size"), F.lit(1))
    keep = F.when(size > 1, F.col("keep")).otherwise(F.col("id"))
    return out.select("id", keep.alias("keep_id"), size.cast("long").alias("group_size"), (F.col("id").eqNullSafe(keep)).alias("kept"), F.lower(F.hex("full")).alias("text_sha256"))


def survivors(docs: DataFrame, spot: list) -> DataFrame:
    """(n, head) of more than one row of ``docs``, by two refinements on narrow rows; ``spot`` are the expressions of both."""
    marks = materialize(docs.select(spot[0].alias("n"), spot[1].alias("head")), "spots")
    lengths = marks.groupBy("n").agg(F.count("*").alias("c")).filter("c > 1").select("n")
    heads = marks.join(lengths, "n", "left_semi").groupBy("n", "head").agg(F.count("*").alias("c")).filter("c > 1")
    return materialize(heads.select("n", "head"), "heads")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Full hashes are taken of rows whose (length, prefix) is not alone; these keys
    are broadcast while they are small, and beyond that every text is hashed in
    place, as moving texts costs more than hashing them. Of the rows only
    narrow ones are grouped; those that go are joined back by id, length and prefix.
    An id that stands on several rows of one length and prefix is rare and decided
    by the hash as well.
    """
    names = docs.columns
    key, word = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    d = numbered(docs)
    text = F.coalesce(word, F.lit(""))
    n, head, full = F.octet_length(text).cast("long"), F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX))), F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))
    heads = survivors(d, [n, head])
    small = if_small(heads, 48)
    rows = d.select(key.cast("long").alias("id"), text.alias("text"), n.alias("n"), head.alias("head"))
    if small is not heads:
        rows = rows.join(small, ["n", "head"], "left_semi")
    marks = materialize(rows.select("id", "n", "head", F.unhex(F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)).alias("full")), "marks")
    groups = marks.groupBy("n", "head", "full").agg(F.max("id").alias("keep"), F.count("*").alias("size")).filter("size > 1")
    # rows of one id, length and prefix: which of them go
    spots = marks.join(groups, ["n", "head", "full"], "left").withColumn("goes", F.col("size").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep")))
    spots = materialize(spots.groupBy("id", "n", "head").agg(F.count("*").alias("c"), F.bool_or("goes").alias("goes")).filter("goes OR c > 1"), "spots-that-go")
    goes = if_small(spots.select(F.col("id").alias("i"), F.col("n").alias("l"), F.col("head").alias("h"), (F.col("c") > 1).alias("again")), 64)
    same = key.cast("long").eqNullSafe(F.col("i")) & (n == F.col("l")) & (head == F.col("h"))
    out = d.join(goes, same, "left_anti")
    again = spots.filter("c > 1")
    if not again.isEmpty():
        twice = d.join(goes.filter("again"), same, "left_semi").withColumn("full", full)
        best = marks.groupBy("full").agg(F.max("id").alias("best"))
        twice = twice.join(best, "full").filter(key.cast("long").eqNullSafe(F.col("best")))
        out = out.unionByName(twice.dropDuplicates(["full"]).select(*d.columns))
    return out.toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = materialize(fingerprints(table(spark, sf_dir, "documents")), "marks")
    return assign(marks).withColumnRenamed("id", "doc_id")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
), g AS (SELECT h, max(doc_id) AS keep, count(*) AS size FROM d GROUP BY h)
SELECT d.doc_id, g.keep AS keep_id, CAST(g.size AS BIGINT) AS group_size, d.doc_id = g.keep AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""
