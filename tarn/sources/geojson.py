"""GeoJSON features, read and written by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _twice_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring: negative clockwise."""
    return F.aggregate(F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b")), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])


def features(df: DataFrame) -> DataFrame:
    """(feature string): one GeoJSON feature a row; write it with ``.write.text`` as newline-delimited features.

    Columns ``kind`` and ``parts`` (see :mod:`.shapefile`) are the geometry, ``feature_idx`` is left out, others are
    properties, nulls included. A clockwise ring starts a polygon and rings after it that run the other way are its holes
    (the first ring starts one either way). Polygons are MultiPolygon, lines MultiLineString, points MultiPoint; a null
    kind has a null geometry. An empty table gives no rows.
    """
    xy = lambda p: F.array(p["x"], p["y"])
    lines = F.transform("parts", lambda part: F.transform(part, xy))
    none = F.array().cast("array<array<array<array<double>>>>")
    ring = lambda r: F.transform(r, xy)
    last = lambda acc, r: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(ring(r)))))
    polygons = F.aggregate("parts", none, lambda acc, r: F.when((F.size(acc) > 0) & (_twice_area(r) > 0), last(acc, r)).otherwise(F.concat(acc, F.array(F.array(ring(r))))))
    text = lambda kind, c: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(c), F.lit("}"))
    geometry = F.when(F.col("kind") == "polygon", text("MultiPolygon", polygons)).when(F.col("kind") == "line", text("MultiLineString", lines)).when(F.col("kind") == "point", text("MultiPoint", F.flatten(lines))).otherwise(F.lit("null"))
    names = [c for c in df.columns if c not in ("feature_idx", "kind", "parts")]
    properties = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}")).alias("feature"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(feature_idx, type, geometry, kind, parts, properties map<string,string>) of GeoJSON files: FeatureCollections, or a feature a line.

    Files are read by Spark's text reader. ``kind`` and ``parts`` are as in :mod:`.shapefile`; a geometry collection or a
    null geometry has null in both (see :func:`tarn.operators.layers.simple`). Property values are texts: of strings as they
    are, of others their JSON. ``feature_idx`` is the place in its file.
    """
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    whole = F.get_json_object("value", "$.type") == "FeatureCollection"
    listed = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    f = text.select("file", F.posexplode(F.when(whole, listed).otherwise(lines)).alias("feature_idx", "f"))
    f = f.select("file", F.col("feature_idx").cast("long").alias("feature_idx"), F.get_json_object("f", "$.geometry").alias("geometry"), F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"))
    return f.select("feature_idx", F.get_json_object("geometry", "$.type").alias("type"), "geometry", *parts_of("geometry"), "properties")


def parts_of(geometry: str) -> list[Column]:
    """``kind`` and ``parts`` of a column of GeoJSON geometries."""
    kind, c = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    deep = lambda n: F.from_json(c, "array<" * n + "double" + ">" * n)
    point = lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))
    line = lambda q: F.transform(q, point)
    lines = lambda q: F.transform(q, line)
    parts = F.when(kind == "Polygon", lines(deep(3))).when(kind == "MultiPolygon", F.flatten(F.transform(deep(4), lines))).when(kind == "LineString", F.array(line(deep(2)))).when(kind == "MultiLineString", lines(deep(3)))
    parts = parts.when(kind == "Point", F.array(F.array(point(deep(1))))).when(kind == "MultiPoint", F.transform(deep(2), lambda q: F.array(point(q))))
    name = F.when(kind.isin("Polygon", "MultiPolygon"), "polygon").when(kind.isin("LineString", "MultiLineString"), "line").when(kind.isin("Point", "MultiPoint"), "point")
    return [name.alias("kind"), parts.alias("parts")]
