"""Rasters, polygons and profiles derived from the driver's tables by integer arithmetic, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLASSES = ("lake", "river", "reservoir", "stream", "water", "glacier", "dock", "sea")
H, W = 40, 50


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem(spark, d, h=H, w=W) -> DataFrame:
    t = read(spark, d, "lineitem").select((F.col("l_partkey") % h).cast("int").alias("r"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % w).cast("int").alias("c"), "l_extendedprice")
    return t.groupBy("r", "c").agg(F.min("l_extendedprice").alias("z"))


def rect(spark, d) -> DataFrame:
    s = read(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("poly"),
        F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("s_nationkey") % 8 + 1).cast("int")).alias("fclass"),
        ((F.col("s_suppkey") * 13) % 43).cast("int").alias("c0"),
        ((F.col("s_suppkey") * 7) % 34).cast("int").alias("r0"),
        (3 + F.col("s_nationkey") % 5).cast("int").alias("w"),
        (3 + F.col("s_suppkey") % 4).cast("int").alias("h"),
    )


def profile(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("grp"), (F.row_number().over(w) - 1).cast("int").alias("seq"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"), F.col("value").alias("raw"))


def points(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 360 - 180).cast("double").alias("lon"), (F.col("p_partkey") % 160 - 80).cast("double").alias("lat"))


def tilekeys(spark, d) -> DataFrame:
    z = (1 + F.col("p_size") % 12).cast("int")
    n = F.expr("shiftleft(1L, 1 + p_size % 12)")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), z.alias("z"), (F.col("p_partkey") % n).alias("x"), ((F.col("p_partkey") * 31) % n).alias("y"))


RAW = ("River", " 河流 ", "lake （湖泊）", "NONE", "Reservoir", "nan", "海洋", "swamp", "", "通用水体", "水体", "Water (通用水体)", "船坞", "码头", "dock （船坞/码头）", "lake(湖泊)", " STREAM (溪流)", "冰川", "glacier  (冰川)")


def raw_features(spark, d) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("idx"), F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 200).cast("string")).alias("fid"), F.element_at(F.array(*map(F.lit, RAW)), (F.col("c_custkey") % len(RAW) + 1).cast("int")).alias("raw_class"))


def _case(values, on: str) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


DEM = f"dem AS (SELECT CAST(l_partkey % {H} AS INT) AS r, CAST((l_suppkey * 7 + l_linenumber) % {W} AS INT) AS c, min(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2)"
RECT = f"rect AS (SELECT s_suppkey AS poly, {_case(CLASSES, 's_nationkey % 8')} AS fclass, CAST((s_suppkey * 13) % 43 AS INT) AS c0, CAST((s_suppkey * 7) % 34 AS INT) AS r0, CAST(3 + s_nationkey % 5 AS INT) AS w, CAST(3 + s_suppkey % 4 AS INT) AS h FROM supplier)"
MASK = "mask AS (SELECT poly, CAST(r0 + i AS INT) AS r, CAST(c0 + j AS INT) AS c FROM (SELECT *, unnest(range(0, h)) AS i FROM rect), (SELECT poly AS p2, unnest(range(0, w)) AS j FROM rect) WHERE poly = p2)"
PROFILE = "profile AS (SELECT user_id AS grp, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq, CASE WHEN event_type <> 'error' THEN value END AS v, value AS raw FROM events)"
POINTS = "pt AS (SELECT p_partkey AS id, CAST(p_partkey % 360 - 180 AS DOUBLE) AS lon, CAST(p_partkey % 160 - 80 AS DOUBLE) AS lat FROM part)"
TILEKEYS = "tk AS (SELECT p_partkey AS id, CAST(1 + p_size % 12 AS INT) AS z, p_partkey % (1::BIGINT << (1 + p_size % 12)) AS x, (p_partkey * 31) % (1::BIGINT << (1 + p_size % 12)) AS y FROM part)"
RAWSQL = f"raw AS (SELECT c_custkey AS idx, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 200 AS VARCHAR) END AS fid, {_case(RAW, f'c_custkey % {len(RAW)}')} AS raw_class FROM customer)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
