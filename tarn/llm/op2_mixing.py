"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are put in a seeded random order and the stream of
their words is cut into blocks of equal length. Point i of the golden-ratio
sequence, frac((i + 1) * 0.618...), is looked up in the cumulative weights and gives slot i
to a source; a source's slots are ranked, and rank r takes block r mod (number
of blocks), so a source is passed as often as its target asks. Slots and blocks
meet in a join on (source, block). The weights are the slots each source needs;
a source's surplus slots are dropped and missing ones (a few, the sequence's
discrepancy) appended, and its last slot is cut at the target, so every source
gets its target to the word. The schedule decides the order: ``slot`` is the first
place of the mixture at which words of the document come, so a reader that goes
by slot meets the sources interleaved at their weights all along.

A block's length is the given one, or 1/64 of the source where that is less, so
small sources keep many slots. Ranks and offsets come from bucketed prefix sums;
no source is one task. The sources' table holds a row for each source.

Defined results: null text has size 0, takes 0 and has no slot; null is the last
source; sources of size 0 have target 0; ties (equal keys of the random order) go
by id, size and text checksum; repeated rows are placed one by one; a very long
text is passed in part where its source's cut falls into it; extra columns,
whatever their names, are dropped by the query and carried by :func:`mix_rows`; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_TOKEN, bucket_count, if_small, materialize, numbered, running_total, shuffle_key, table, unit_bucket

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK = 2048
SLOTS_LEAST = 64
SEED = "mix-1"
GOLDEN = 0.6180339887498949
NULL_SOURCE = "\x00null"


def count_words(text: Column) -> Column:
    """Number of runs of non-space characters; null counts 0."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_TOKEN, "x"), " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> + target. Water filling in one pass: a source is at its bound
    (``MOST_PASSES`` times its size) if bound / weight is below the level that the sources from it onwards would share.
    """
    everything = Window.partitionBy()
    by_code = everything.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("k", F.row_number().over(by_code))
    s = s.withColumns({"weight": F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("k") - 1) % len(WEIGHTS) + 1).cast("int")), "bound": (F.lit(MOST_PASSES) * F.col("source_size")).cast("double")})
    up = everything.orderBy((F.col("bound") / F.col("weight")).asc(), "k")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onwards = up.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    s = s.withColumn("level", level).withColumn("capped", F.col("bound") <= F.col("level") * F.col("weight"))
    shared = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("bound") / F.col("weight"), F.col("k"), F.col("level")))).over(everything)
    s = s.withColumn("share", F.coalesce(first["level"], shared))
    return s.withColumn("target", F.when(F.col("capped") | F.col("share").isNull(), F.col("bound")).otherwise(F.col("share") * F.col("weight"))).select("source", "source_size", "target")


def plan_sources(sizes: DataFrame, block: int) -> DataFrame:
    """Adds the block length, blocks of a pass, words to take and slots needed."""
    s = sizes.withColumn("take", F.least(F.round("target").cast("long"), F.lit(MOST_PASSES) * F.col("source_size")))
    s = s.withColumn("length", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / SLOTS_LEAST))).cast("long"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0)
    s = s.withColumn("passes", full.cast("long")).withColumn("left", (F.col("take") - F.col("passes") * F.col("source_size")).cast("long"))
    return s.withColumn("need", (F.col("passes") * F.col("blocks") + F.ceil(F.col("left") / F.col("length"))).cast("long"))


def schedule(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(slot, source, rank, part): the slots in order, each source's ranked from 0, as many as it needs."""
    w = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    edges = sources.filter("need > 0").withColumn("upto", F.sum("need").over(w)).select(F.coalesce("source", F.lit(NULL_SOURCE)).alias("s"), "need", "upto")
    total = sources.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], "slot long, s string, rank long")
    edges = materialize(edges, "mix-edges")
    # the cumulative weights: a row for each source, met through the buckets of the unit interval
    cells, whole = 4096, F.lit(float(total))
    i = spark.range(total).withColumnRenamed("id", "slot")
    x = (F.col("slot") + 1) * F.lit(GOLDEN)
    i = i.withColumn("x", (x - F.floor(x)) * whole).withColumn("cell", F.floor(F.col("x") * F.lit(cells) / whole))
    spans = edges.withColumn("from", F.col("upto") - F.col("need")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * F.lit(cells) / whole), F.floor(F.col("upto") * F.lit(cells) / whole))))
    i = i.join(if_small(spans, 96), "cell").filter("x >= from AND x < upto").select("slot", "s", "need")
    i = i.withColumn("b", F.floor(F.col("slot") * F.lit(bucket_count(total)) / F.lit(total)).cast("long"))
    ranked = running_total(i, ["s"], "b", [F.col("slot")], F.lit(1), "rank").filter("rank < need").select("slot", "s", "rank")
    got = ranked.groupBy("s").agg(F.count("*").alias("got"))
    short = edges.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    late = short.select("s", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    return ranked.unionByName(late.select((F.lit(total) + F.col("rank")).alias("slot"), "s", "rank"))


def mix(sized: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """``sized`` (doc_id, source, size, tie) with source_size, target, taken and slot.

    ``tie`` tells rows with one doc_id apart (a text checksum).
    """
    spark = sized.sparkSession
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(plan_sources(targets(sizes), block), "mix-sources")
    visits = materialize(schedule(spark, sources), "mix-schedule")
    key = F.coalesce(F.col("source"), F.lit(NULL_SOURCE))
    plan_side = if_small(sources.withColumn("s", key), 128)
    # words that the slots take of each block: whole visits and the cut last slot
    seen = visits.join(plan_side.select("s", "blocks", "need", "left", "length"), "s")
    block_no = F.when(F.col("blocks") > 0, F.col("rank") % F.col("blocks"))
    cut_here = (F.col("rank") == F.col("need") - 1) & (F.col("left") > 0) & (F.col("left") % F.col("length") != 0)
    seen = seen.select("s", block_no.alias("block"), F.when(cut_here, F.col("left") % F.col("length")).alias("part"))
    seen = seen.groupBy("s", "block").agg(F.count_if(F.col("part").isNull()).alias("whole"), F.max("part").alias("part"))
    n = sized.count()
    rows = sized.withColumn("__key", shuffle_key(seed, F.col("doc_id"), F.col("size"), F.col("tie"))).withColumn("__b", unit_bucket(F.col("__key"), bucket_count(n)))
    placed = running_total(rows, ["source"], "__b", [F.col("__key"), F.col("doc_id"), F.col("size"), F.col("tie")], F.col("size"), "start").withColumn("s", key)
    placed = placed.join(plan_side.select("s", "source_size", "target", "length"), "s")
    placed = placed.select("doc_id", "size", "tie", "s", "source_size", "target", "length", "start", F.monotonically_increasing_id().alias("row"))
    placed = materialize(placed, "mix-placed")
    first, last = F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("length"))
    pieces = placed.filter("size > 0").select("row", "s", "start", "size", "length", F.explode(F.sequence(first, last)).alias("block"))
    got = pieces.join(seen, ["s", "block"])
    lo, hi, at = F.col("start"), F.col("start") + F.col("size"), F.col("block") * F.col("length")
    inside = lambda upto: F.greatest(F.lit(0), F.least(hi, upto) - F.greatest(lo, at))
    got = got.withColumn("words", F.col("whole") * inside(at + F.col("length")) + F.when(F.col("part").isNotNull(), inside(at + F.col("part"))).otherwise(0))
    got = got.groupBy("row").agg(F.sum("words").cast("long").alias("taken"))
    out = placed.join(got, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    out = out.withColumn("rank", F.when(F.col("taken") > 0, first)).join(visits, ["s", "rank"], "left")
    return out.select("doc_id", "tie", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), "target", "taken", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", count_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"))
    return mix(materialize(sized, "mix-sized")).drop("tie")


SQL = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s0
), s2 AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS bound FROM s1
), s3 AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
     - coalesce(sum(bound) OVER (ORDER BY bound / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
     / sum(weight) OVER (ORDER BY bound / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2
), s4 AS (
  SELECT *, (SELECT x.level FROM s3 x WHERE x.bound > x.level * x.weight ORDER BY x.bound / x.weight, x.k LIMIT 1) AS share FROM s3
), s5 AS (
  SELECT source, source_size, CASE WHEN bound <= level * weight OR share IS NULL THEN bound ELSE share * weight END AS target FROM s4
), s6 AS (SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS take FROM s5
), p AS (
  SELECT d.*, s6.source_size, s6.target, s6.take,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat('mix-1', chr(31), d.doc_id, chr(31), d.size, chr(31), d.tie)), d.doc_id, d.size, d.tie
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
), b AS (
  SELECT source, greatest(1, least(2048, source_size // 64)) AS length, source_size, take FROM s6 WHERE source_size > 0
), e0 AS (
  SELECT source, length, (take // source_size) * CAST(ceil(source_size::DOUBLE / length) AS BIGINT) + CAST(ceil((take % source_size)::DOUBLE / length) AS BIGINT) AS need FROM b
), e AS (
  SELECT *, sum(need) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(need) OVER () AS total FROM e0 WHERE need > 0
), g AS (
  SELECT i, (i + 1) * 0.6180339887498949::DOUBLE AS y FROM (SELECT unnest(range(0, CAST((SELECT max(total) FROM e) AS BIGINT))) AS i)
), h AS (
  SELECT e.source, e.need, e.total, e.length, g.i AS slot, row_number() OVER (PARTITION BY e.source ORDER BY g.i) - 1 AS rank
  FROM g JOIN e ON (g.y - floor(g.y)) * CAST(e.total AS DOUBLE) >= e.upto - e.need AND (g.y - floor(g.y)) * CAST(e.total AS DOUBLE) < e.upto
), v AS (
  SELECT source, rank, slot FROM h WHERE rank < need
  UNION ALL
  SELECT e.source, r.r, e.total + r.r FROM e LEFT JOIN (SELECT source, count(*) AS n FROM h GROUP BY source) c ON c.source IS NOT DISTINCT FROM e.source,
    LATERAL (SELECT unnest(range(CAST(least(coalesce(c.n, 0), e.need) AS BIGINT), CAST(e.need AS BIGINT))) AS r) r
), q AS (
  SELECT doc_id, size, p.source, p.source_size, target, start // b.length AS first,
    CAST(CASE WHEN p.source_size = 0 THEN 0 ELSE size * (p.take // p.source_size) + greatest(0, least(start + size, p.take % p.source_size) - start) END AS BIGINT) AS taken
  FROM p LEFT JOIN b ON b.source IS NOT DISTINCT FROM p.source
)
SELECT q.doc_id, q.size, q.source_size, q.target, q.taken, CAST(v.slot AS BIGINT) AS slot
FROM q LEFT JOIN v ON v.source IS NOT DISTINCT FROM q.source AND v.rank = q.first AND q.taken > 0
"""


def mix_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` repeated or left out as the mixture passes them: a row stands as often as its words were taken, to the nearest whole.

    So a document of which a cut takes less than half goes, even where it is its source's only one.
    A row without words (which no mixture counts) stays once. Rows of equal id and text are one document:
    one of them stands as often as all were taken. All columns are carried, whatever their names.
    """
    names = docs.columns
    d = numbered(docs)
    key, source, text = (F.col(f"c{names.index(c)}") for c in (id_col, source_col, text_col))
    checksum = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    sized = materialize(d.select(key.cast("long").alias("doc_id"), source.alias("source"), count_words(text).alias("size"), checksum.alias("tie")), "mix-sized")
    mixed = mix(sized)
    wanted = mixed.groupBy("doc_id", "tie").agg(F.sum("taken").alias("taken"), F.first("size").alias("size"), F.count("*").alias("rows"))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.col("rows")).cast("int")
    wanted = materialize(wanted.select(F.col("doc_id").alias("i"), F.col("tie").alias("t"), times.alias("times"), "rows").filter("times > 0"), "mix-wanted")
    out = d.join(if_small(wanted, 96), (checksum == F.col("t")) & key.cast("long").eqNullSafe(F.col("i")))
    one = out.filter("rows = 1")
    if not wanted.filter("rows > 1").isEmpty():
        one = one.unionByName(out.filter("rows > 1").dropDuplicates(["i", "t"]))
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*d.columns).toDF(*names)
