import struct

import pytest
from pyspark.sql import functions as F

from tarn.operators import raster
from tarn.sources import shapefile

SCHEMA = "kind string, parts array<array<struct<x double, y double>>>, name string, depth double, wet boolean"


def square(x, y, n=2.0):
    x, y = float(x), float(y)
    return [(x, y), (x, y + n), (x + n, y + n), (x + n, y), (x, y)]


ROWS = [("polygon", [square(0, 0, 6), square(2, 2)], "See ä", 1.25, True), ("polygon", [square(10, 0)], None, -3.0, False), (None, None, "none", None, None), ("polygon", [square(20, 5)], "x" * 254, 1e300, True)]


@pytest.fixture
def layer(spark, tmp_path):
    shapefile.register(spark)
    path = str(tmp_path / "layer")
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.format("shapefile").option("prj", "WGS").mode("append").save(path)
    return path


def test_round_trip(spark, layer):
    for rows in (1, 3, 100):
        got = spark.read.format("shapefile").option("rows", rows).load(layer).orderBy("feature_idx").collect()
        assert [r.feature_idx for r in got] == [0, 1, 2, 3]
        assert [(r.kind, r.parts and [[tuple(p) for p in q] for q in r.parts], r.name, r.depth, r.wet) for r in got] == ROWS
    assert shapefile.projection(layer) == "WGS"


def test_box_skips_records_and_touching_counts(spark, layer):
    ids = lambda box: sorted(r.feature_idx for r in spark.read.format("shapefile").option("bbox", box).load(layer).collect())
    assert ids("6,6,10,9") == [0] and ids("6,0,10,1") == [0, 1] and ids("100,100,101,101") == []


def test_rings_rasterize_with_holes(spark, layer):
    rings = spark.read.format("shapefile").load(layer).filter("kind = 'polygon'").select(F.col("feature_idx").alias("poly"), F.explode("parts").alias("ring"))
    assert raster.rasterize(rings, 8, 8).filter("poly = 0").count() == 32


def test_overwrite_append_and_mixed_kinds(spark, layer):
    two = spark.createDataFrame(ROWS[1:2], SCHEMA).coalesce(1)
    two.write.format("shapefile").mode("append").save(layer)
    assert spark.read.format("shapefile").load(layer).count() == 5
    two.write.format("shapefile").mode("overwrite").save(layer)
    assert spark.read.format("shapefile").load(layer).count() == 1
    mixed = spark.createDataFrame([ROWS[1], ("line", [square(0, 0)], None, None, None)], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="one kind"):
        mixed.write.format("shapefile").mode("append").save(layer)
    long = spark.createDataFrame([("polygon", [square(0, 0)], "y" * 255, None, None)], SCHEMA)
    with pytest.raises(Exception, match="don't fit"):
        long.write.format("shapefile").mode("append").save(layer)
    assert spark.read.format("shapefile").load(layer).count() == 1


def test_points_with_height_and_bad_numbers():
    assert shapefile.decode(struct.pack("<i4d", 11, 1.0, 2.0, 3.0, 4.0)) == ("point", [[(1.0, 2.0)]])
    assert shapefile.attribute(b" **** ", "N", "utf-8") is None and shapefile.attribute(b" 7.50 ", "N", "utf-8") == 7.5
    assert shapefile.derive_path("/a/b.shp", "fclass", ".shp") == "/a/b_fclass.shp"
