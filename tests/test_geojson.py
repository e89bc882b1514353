import json

from tarn.sources import geojson

SCHEMA = "feature_idx long, kind string, parts array<array<struct<x double, y double>>>, name string, depth double"


def box(x, y, n, hole=False):
    ring = [(x, y), (x, y + n), (x + n, y + n), (x + n, y), (x, y)]
    return ring[::-1] if hole else ring


def test_features(spark):
    a, hole, b = box(0.0, 0.0, 6.0), box(2.0, 2.0, 2.0, True), box(9.0, 0.0, 1.0)
    rows = [(0, "polygon", [a, hole, b], 'quote " ä', 1.5), (1, "line", [a[:2], b[:3]], None, None), (2, "point", [[(1.0, 2.0)]], "p", 0.0), (3, None, None, "n", None), (4, "polygon", [hole], "first ring", None)]
    got = [json.loads(r.feature) for r in geojson.features(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()]
    flat = lambda part: [list(p) for p in part]
    assert [g["geometry"] and g["geometry"]["coordinates"] for g in got] == [[[flat(a), flat(hole)], [flat(b)]], [flat(a[:2]), flat(b[:3])], [[1.0, 2.0]], None, [[flat(hole)]]]
    assert [g["geometry"] and g["geometry"]["type"] for g in got] == ["MultiPolygon", "MultiLineString", "MultiPoint", None, "MultiPolygon"]
    assert [g["properties"] for g in got] == [{"name": r[3], "depth": r[4]} for r in rows]
    assert geojson.features(spark.createDataFrame([], SCHEMA)).count() == 0
