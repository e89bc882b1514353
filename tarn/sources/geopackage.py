"""GeoPackage layers, read through Spark's binary file reader and Python's sqlite.

A file is one row of the reader, opened in memory by the task that holds it, so it may lie in any store that
Spark reads. A box goes to the layer's R-tree where it has one, and is tested again on the geometry's own box.
"""

from __future__ import annotations

import json
import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the format: bytes of the envelope by its code; geometry names by number
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def opened(content: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(bytes(content))
    return db


def wkb(data: bytes, at: int = 0) -> tuple[dict, int]:
    """(GeoJSON geometry, next byte) of well-known binary; Z and M are dropped."""
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    extra = (1 if code & 0x80000000 else 0) + (1 if code & 0x40000000 else 0)
    if code & 0x20000000:
        at += 4
    code &= 0x0FFFFFFF
    extra += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
    name, size = NAMES[code % 1000], 16 + 8 * extra

    def count():
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    def points(n):
        nonlocal at
        out = [list(struct.unpack_from(order + "2d", data, at + i * size)) for i in range(n)]
        at += n * size
        return out

    if name == "Point":
        return {"type": name, "coordinates": points(1)[0]}, at
    if name == "LineString":
        return {"type": name, "coordinates": points(count())}, at
    if name == "Polygon":
        return {"type": name, "coordinates": [points(count()) for _ in range(count())]}, at
    members = []
    for _ in range(count()):
        g, at = wkb(data, at)
        members.append(g)
    if name == "GeometryCollection":
        return {"type": name, "geometries": members}, at
    return {"type": name, "coordinates": [g["coordinates"] for g in members]}, at


def geometry(blob: bytes | None) -> dict | None:
    """The geometry of a stored value; null for null and empty ones."""
    if blob is None or blob[3] & 0x10:
        return None
    return wkb(blob, 8 + ENVELOPE[blob[3] >> 1 & 7])[0]


def box_of(g: dict) -> tuple[float, float, float, float]:
    xs, ys = [], []

    def walk(c):
        if c and isinstance(c[0], (int, float)):
            xs.append(c[0])
            ys.append(c[1])
        else:
            for x in c:
                walk(x)

    for part in g.get("geometries", [g]):
        walk(part["coordinates"])
    return min(xs), min(ys), max(xs), max(ys)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def layers(spark: SparkSession, path: str) -> DataFrame:
    """(file, layer, epsg) of the feature layers; no geometry is decoded."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                db = opened(content)
                rows += [(file, t, e) for t, e in db.execute("SELECT c.table_name, s.organization_coordsys_id FROM gpkg_contents c JOIN gpkg_geometry_columns g ON g.table_name = c.table_name LEFT JOIN gpkg_spatial_ref_sys s ON s.srs_id = g.srs_id WHERE c.data_type = 'features' ORDER BY c.table_name")]
            yield pd.DataFrame(rows, columns=["file", "layer", "epsg"]).astype({"epsg": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, layer string, epsg int")


def read(spark: SparkSession, path: str, layer: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(feature_idx, type, geometry, kind, parts, properties, epsg) of a layer, columns as of :func:`tarn.sources.geojson.read`.

    ``bbox`` keeps features whose box meets it (closed; none without a geometry). A file without the layer gives no rows.
    """
    from .geojson import parts_of

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                db = opened(content)
                found = db.execute("SELECT g.column_name, s.organization_coordsys_id FROM gpkg_geometry_columns g LEFT JOIN gpkg_spatial_ref_sys s ON s.srs_id = g.srs_id WHERE g.table_name = ?", (layer,)).fetchone()
                if not found:
                    continue
                column, epsg = found
                query, values = f"SELECT rowid, * FROM {_quoted(layer)}", ()
                tree = f"rtree_{layer}_{column}"
                if bbox and db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (tree,)).fetchone():
                    # the tree's numbers are rounded outward, so it gives a few too many, never too few
                    query += f" WHERE rowid IN (SELECT id FROM {_quoted(tree)} WHERE minx <= ? AND maxx >= ? AND miny <= ? AND maxy >= ?)"
                    values = (bbox[2], bbox[0], bbox[3], bbox[1])
                cursor = db.execute(query + " ORDER BY rowid", values)
                names = [d[0] for d in cursor.description][1:]
                keys = {r[1] for r in db.execute(f"PRAGMA table_info({_quoted(layer)})") if r[5]}  # the feature's own number
                for rowid, *cells in cursor:
                    values_ = dict(zip(names, cells))
                    g = geometry(values_.pop(column))
                    if bbox:
                        if g is None:
                            continue
                        x0, y0, x1, y1 = box_of(g)
                        if x0 > bbox[2] or x1 < bbox[0] or y0 > bbox[3] or y1 < bbox[1]:
                            continue
                    texts = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in values_.items() if k not in keys and not isinstance(v, bytes)}
                    rows.append((rowid, g and json.dumps(g), json.dumps(texts), epsg))
            yield pd.DataFrame(rows, columns=["feature_idx", "geometry", "p", "epsg"]).astype({"feature_idx": "int64", "epsg": "Int32"})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "feature_idx long, geometry string, p string, epsg int")
    return raw.select("feature_idx", F.get_json_object("geometry", "$.type").alias("type"), "geometry", *parts_of("geometry"), F.from_json("p", "map<string,string>").alias("properties"), "epsg")


def build(layer: str, rows: list[tuple[int, list, dict]], epsg: int, tree: bool = True) -> bytes:
    """A file of one polygon layer: (id, rings, texts by name) a row, rings as lists of (x, y). With an R-tree unless told otherwise."""
    db = sqlite3.connect(":memory:")
    names = sorted({k for _, _, p in rows for k in p})
    db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT)")
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, '')", (f"EPSG:{epsg}", epsg, epsg))
    db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, NULL, NULL, NULL, NULL, ?)", (layer, layer, epsg))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, epsg))
    db.execute(f"CREATE TABLE {_quoted(layer)} (fid INTEGER PRIMARY KEY, geom BLOB" + "".join(f", {_quoted(n)} TEXT" for n in names) + ")")
    if tree:
        db.execute(f"CREATE VIRTUAL TABLE {_quoted(f'rtree_{layer}_geom')} USING rtree(id, minx, maxx, miny, maxy)")
    for i, rings, p in rows:
        body = struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *q) for q in r) for r in rings)
        db.execute(f"INSERT INTO {_quoted(layer)} VALUES (?, ?" + ", ?" * len(names) + ")", (i, b"GP\0\x01" + struct.pack("<i", epsg) + body, *[p.get(n) for n in names]))
        if tree:
            xs, ys = [q[0] for r in rings for q in r], [q[1] for r in rings for q in r]
            db.execute(f"INSERT INTO {_quoted(f'rtree_{layer}_geom')} VALUES (?, ?, ?, ?, ?)", (i, min(xs), max(xs), min(ys), max(ys)))
    db.commit()
    return db.serialize()
