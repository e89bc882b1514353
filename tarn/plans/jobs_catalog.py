"""Queries of sources, layers and composite jobs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import jobs
from ..functions import classes, crs
from ..operators import kernels, layers, profiles, raster
from ..session import shared_folder, ship
from ..sources import geojson, geopackage, geotiff, store
from . import bridge as b
from .catalog import MASKS, H, W, mask_of, query

T0 = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
NORTH_UP = (0.01, 0.0, 100.0, 0.0, -0.01, 30.0)
EPSG = 32650


def cell_blocks(s, d, size: int = 16) -> DataFrame:
    return geotiff.pack(b.dem(s, d), H, W, NORTH_UP, crs.GEOGRAPHIC, size)


@query("geotiff_round_trip", b.with_(b.DEM) + "SELECT r, c, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM dem")
def _(s, d):
    folder = shared_folder(ship(s), "tif")
    geotiff.write(geotiff.pack(b.dem(s, d), H, W, NORTH_UP, crs.GEOGRAPHIC, 64), folder)
    return geotiff.cells(geotiff.read(s, folder)).select("r", "c", F.col("z").cast("double").alias("z"))


@query("geotiff_window", b.with_(b.DEM) + "SELECT CAST(r - 7 AS INT) AS r, CAST(c - 11 AS INT) AS c, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM dem WHERE r BETWEEN 7 AND 26 AND c BETWEEN 11 AND 40")
def _(s, d):
    folder = shared_folder(ship(s), "tif")
    geotiff.write(geotiff.pack(b.dem(s, d), H, W, NORTH_UP, crs.GEOGRAPHIC, 64), folder)
    got = geotiff.cells(geotiff.read(s, folder, (11, 7, 30, 20), block=8))
    return got.select((F.col("r") - 7).alias("r"), (F.col("c") - 11).alias("c"), F.col("z").cast("double").alias("z"))


@query("geotiff_mosaic", b.with_(b.DEM) + "SELECT CAST(g.r AS INT) AS r, CAST(g.c AS INT) AS c, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM (SELECT * FROM (SELECT unnest(range(0, 20)) AS r), (SELECT unnest(range(0, 25)) AS c)) g JOIN dem ON dem.r = g.r * 2 AND dem.c = g.c * 2")
def _(s, d):
    folder = shared_folder(ship(s), "tif")
    geotiff.write(cell_blocks(s, d), folder)
    a, _, c, _, e, f = NORTH_UP
    half = (2 * a, 0.0, c + a / 4, 0.0, 2 * e, f + e / 4)
    return geotiff.sampled(geotiff.read(s, folder), half, W // 2, H // 2).select("r", "c", F.col("z").cast("double").alias("z"))


@query("geotiff_metadata", "SELECT 50 AS width, 40 AS height, 4326 AS epsg, 100.0::DOUBLE AS minx, 29.6::DOUBLE AS miny, 100.5::DOUBLE AS maxx, 30.0::DOUBLE AS maxy, -9999.0::DOUBLE AS nodata FROM region LIMIT 1")
def _(s, d):
    folder = shared_folder(ship(s), "tif")
    geotiff.write(geotiff.pack(b.dem(s, d), H, W, NORTH_UP, crs.GEOGRAPHIC, 64), folder)
    return geotiff.metadata(s, folder).select("width", "height", "epsg", *[F.round(c, 9).alias(c) for c in ("minx", "miny", "maxx", "maxy")], "nodata")


def package(s, d) -> str:
    """The rectangles as a file of one layer; a hundred features, so the driver builds it."""
    rows = b.rect(s, d).orderBy("poly").collect()
    ring = lambda r: [(r["c0"], r["r0"]), (r["c0"] + r["w"], r["r0"]), (r["c0"] + r["w"], r["r0"] + r["h"]), (r["c0"], r["r0"] + r["h"]), (r["c0"], r["r0"])]
    data = geopackage.build("water", [(r["poly"], [ring(r)], {"FClass": r["fclass"], "name": f"p{r['poly']}"}) for r in rows], EPSG)
    return store.put(ship(s), shared_folder(s, "layer") + "/water.gpkg", data)


@query("geopackage_bbox", b.with_(b.RECT) + "SELECT poly, fclass, 32650 AS epsg, CAST(w * h AS DOUBLE) AS area FROM rect WHERE c0 <= 20 AND c0 + w >= 10 AND r0 <= 15 AND r0 + h >= 5")
def _(s, d):
    g = geopackage.read(s, package(s, d), "water", (10.0, 5.0, 20.0, 15.0))
    p = jobs.inspect(g).select(F.col("feature_idx").alias("poly"), "fclass", "area")
    return p.join(g.select(F.col("feature_idx").alias("poly"), "epsg"), "poly")


@query("geopackage_layers", "SELECT 'water' AS layer, 32650 AS epsg FROM region LIMIT 1")
def _(s, d):
    return geopackage.layers(s, package(s, d)).select("layer", "epsg")


def collection(s, d) -> str:
    """Suppliers as features: a box, two boxes with a hole in the first, a line, or a collection of a box and a collection of a line and a box."""
    r = b.rect(s, d).orderBy("poly").collect()
    box = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    import json

    features = []
    for q in r:
        x, y, w, h = q["c0"], q["r0"], q["w"], q["h"]
        one, line = {"type": "Polygon", "coordinates": [box(x, y, w, h)]}, {"type": "LineString", "coordinates": [[x, y], [x + w, y], [x + w, y + h]]}
        two = {"type": "MultiPolygon", "coordinates": [[box(x, y, w, h), box(x + 1, y + 1, 1, 1)[::-1]], [box(x + 20, y, 2, 2)]]}
        nested = {"type": "GeometryCollection", "geometries": [one, {"type": "GeometryCollection", "geometries": [line, {"type": "Polygon", "coordinates": [box(x + 30, y, 1, 1)]}]}]}
        features.append({"type": "Feature", "geometry": [one, two, line, nested][q["poly"] % 4], "properties": {"FCLASS": q["fclass"].upper(), "id": q["poly"]}})
    text = json.dumps({"type": "FeatureCollection", "features": features})
    return store.put(ship(s), shared_folder(s, "layer") + "/water.geojson", text.encode())


FEATURES = "ft AS (SELECT row_number() OVER (ORDER BY poly) - 1 AS feature_idx, * FROM rect)"


@query("flatten_polygons", b.with_(b.RECT, FEATURES) + "SELECT feature_idx, part, fclass, CAST(area AS DOUBLE) AS area FROM (SELECT feature_idx, 0 AS part, fclass, CASE WHEN poly % 4 = 1 THEN w * h - 1 ELSE w * h END AS area FROM ft WHERE poly % 4 IN (0, 1) UNION ALL SELECT feature_idx, 1, fclass, 4 FROM ft WHERE poly % 4 = 1)")
def _(s, d):
    return jobs.inspect(geojson.read(s, collection(s, d))).select("feature_idx", "part", "fclass", "area")


@query("collection_polygons", b.with_(b.RECT, FEATURES) + "SELECT feature_idx, CAST(area AS DOUBLE) AS area FROM (SELECT feature_idx, CASE WHEN poly % 4 = 1 THEN w * h - 1 ELSE w * h END AS area FROM ft WHERE poly % 4 <> 2 UNION ALL SELECT feature_idx, 4 FROM ft WHERE poly % 4 = 1 UNION ALL SELECT feature_idx, 1 FROM ft WHERE poly % 4 = 3)")
def _(s, d):
    return jobs.inspect(layers.simple(geojson.read(s, collection(s, d)))).select("feature_idx", "area")


@query("collection_lines", b.with_(b.RECT, FEATURES) + "SELECT feature_idx, k, CAST(CASE k WHEN 0 THEN w ELSE h END AS DOUBLE) AS length FROM ft, (SELECT unnest([0, 1]) AS k) WHERE poly % 4 IN (2, 3)")
def _(s, d):
    seg = layers.segments(geojson.read(s, collection(s, d)))
    dx, dy = F.col("segment.b.x") - F.col("segment.a.x"), F.col("segment.b.y") - F.col("segment.a.y")
    return seg.select("feature_idx", "k", F.sqrt(dx * dx + dy * dy).alias("length"))


@query("attribute_lookup", b.with_(b.RECT, FEATURES) + "SELECT feature_idx, upper(fclass) AS raw, CAST(poly AS VARCHAR) AS id FROM ft")
def _(s, d):
    g = geojson.read(s, collection(s, d))
    return g.select("feature_idx", layers.attribute(F.col("properties"), "fclass").alias("raw"), layers.attribute(F.col("properties"), "ID").alias("id"))


@query("inspect_elevation", b.with_(b.DEM, b.RECT, "ct AS (SELECT poly, c0 + w / 2.0::DOUBLE AS x, r0 + h / 2.0::DOUBLE AS y FROM rect)", "j AS (SELECT poly, sum((1 - abs(x - dem.c)) * (1 - abs(y - dem.r)) * z) AS e, count(*) AS n FROM ct JOIN dem ON dem.c IN (floor(x), floor(x) + 1) AND dem.r IN (floor(y), floor(y) + 1) GROUP BY poly)") + "SELECT rect.poly, fclass, CAST(w * h AS DOUBLE) AS area, CASE WHEN n = 4 THEN round(e, 4) END AS elev FROM rect LEFT JOIN j USING (poly)")
def _(s, d):
    g = geopackage.read(s, package(s, d), "water")
    return jobs.inspect(g, b.dem(s, d), T0).select(F.col("feature_idx").alias("poly"), "fclass", "area", F.round("elev", 4).alias("elev"))


@query("classified_output", b.with_("raw AS (SELECT c_custkey AS feature_idx, c_mktsegment AS segment FROM customer)") + "SELECT feature_idx, segment, CAST(30000000 + row_number() OVER (ORDER BY feature_idx) - 1 AS VARCHAR) AS featureid, CASE feature_idx % 2 WHEN 0 THEN 'lake' ELSE 'river' END AS fclass FROM raw")
def _(s, d):
    c = b.read(s, d, "customer")
    layer = c.select(F.col("c_custkey").alias("feature_idx"), F.col("c_mktsegment").alias("segment"), F.lit("old").alias("FClass"))
    found = c.select(F.col("c_custkey").alias("feature_idx"), F.when(F.col("c_custkey") % 2 == 0, "lake").otherwise("river").alias("fclass"))
    return layers.classified(layer, found)


@query("padded_extent", b.with_(b.RECT) + "SELECT CAST(min(c0) - 2 AS DOUBLE) AS minx, CAST(min(r0) - 2 AS DOUBLE) AS miny, CAST(max(c0 + w) + 2 AS DOUBLE) AS maxx, CAST(max(r0 + h) + 2 AS DOUBLE) AS maxy FROM rect")
def _(s, d):
    box = jobs.extent(raster.rectangle_rings(b.rect(s, d)).select(F.array("ring").alias("rings")), pad=2.0)
    return s.createDataFrame([box], "minx double, miny double, maxx double, maxy double")


@query("window_crop", b.with_(b.DEM) + "SELECT CAST(r - 5 AS INT) AS r, CAST(c - 9 AS INT) AS c, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM dem WHERE r BETWEEN 5 AND 30 AND c BETWEEN 9 AND 44")
def _(s, d):
    return jobs.crop(cell_blocks(s, d), 9, 5, 36, 26).select("r", "c", F.col("z").cast("double").alias("z"))


def terrain(s, d) -> jobs.Raster:
    """The terrain as a north-up raster of one-metre pixels: row r spans H - r - 1 to H - r."""
    t = (1.0, 0.0, 0.0, 0.0, -1.0, float(H))
    return jobs.Raster(geotiff.pack(b.dem(s, d), H, W, t, EPSG, 16), W, H, t, EPSG)


def water_of(s, d) -> DataFrame:
    up = F.transform("ring", lambda p: F.struct(p["x"].alias("x"), (F.lit(float(H)) - p["y"]).alias("y")))
    rings = raster.rectangle_rings(b.rect(s, d)).select("poly", F.array(up).alias("rings"))
    return rings.join(b.rect(s, d).select("poly", "fclass"), "poly")


@query("hydro_surface")
def _(s, d):
    """The water surface by the tiled job, with the whole raster as one tile; tests hold it against the relational path, cell by cell."""
    out = jobs.hydro(water_of(s, d), EPSG, terrain(s, d), size=64, pad=0)
    return geotiff.cells(out).select("r", "c", F.round(F.col("z").cast("double"), 2).alias("z"))


@query("hydro_tiles")
def _(s, d):
    """The same in tiles of 16 with a padding of 8, each solved by itself and put together."""
    out = jobs.hydro(water_of(s, d), EPSG, terrain(s, d), size=16, pad=8)
    return geotiff.cells(out).select("r", "c", F.round(F.col("z").cast("double"), 2).alias("z"))


@query("mosaic_dry_tiles", b.with_(b.DEM, b.RECT) + "SELECT r, c, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM dem WHERE r < 16 AND c >= 16")
def _(s, d):
    """Tiles without water are the terrain: one small polygon in the first tile, the others put together again."""
    water = water_of(s, d).limit(0).unionByName(s.range(1).select(F.lit(1).cast("long").alias("poly"), F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((2.0, 38.0), (5.0, 38.0), (5.0, 35.0), (2.0, 35.0), (2.0, 38.0))])).alias("rings"), F.lit("lake").alias("fclass")))
    out = geotiff.cells(jobs.hydro(water, EPSG, terrain(s, d), size=16, pad=2, skirt=0))
    return out.filter("r < 16 AND c >= 16 AND z <> -9999").select("r", "c", F.col("z").cast("double").alias("z"))


TWO = "two AS (SELECT r, c, z, z + ((r * 7 + c * 3) % 9 - 4) * 1.5::DOUBLE AS q FROM dem)"


@query("difference_bands", b.with_(b.DEM, TWO, "x AS (SELECT abs(q - z) AS d FROM two)", "y AS (SELECT CASE WHEN d >= 5 THEN 4 WHEN d >= 1 THEN 3 WHEN d >= 0.1::DOUBLE THEN 2 WHEN d >= 0.01::DOUBLE THEN 1 ELSE 0 END AS band, d FROM x)") + "SELECT band, count(*) AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS most FROM y GROUP BY band")
def _(s, d):
    z = b.dem(s, d)
    q = z.select("r", "c", (F.col("z") + ((F.col("r") * 7 + F.col("c") * 3) % 9 - 4) * 1.5).alias("z"))
    return jobs.difference_bands(z, q).select("band", "n", F.round("mean", 6).alias("mean"), F.round("most", 6).alias("most"))


@query("domes", b.with_(b.DEM, TWO) + "SELECT a.r, a.c, round(a.q - a.z, 6) AS rise FROM two a WHERE a.q - a.z > 2 AND NOT EXISTS (SELECT 1 FROM two b WHERE abs(b.r - a.r) <= 2 AND abs(b.c - a.c) <= 2 AND b.q > a.q)")
def _(s, d):
    z = b.dem(s, d)
    q = z.select("r", "c", (F.col("z") + ((F.col("r") * 7 + F.col("c") * 3) % 9 - 4) * 1.5).alias("z"))
    return jobs.domes(q, z, 2.0).select("r", "c", F.round("rise", 6).alias("rise"))


@query("near_seams", b.with_(b.DEM) + "SELECT r, c, least(r % 16, 16 - r % 16, c % 16, 16 - c % 16) AS seam, least(r % 16, 16 - r % 16, c % 16, 16 - c % 16) <= 3 AS near FROM dem")
def _(s, d):
    return jobs.near_seams(b.dem(s, d).select("r", "c"), 16, 3)


@query("pick_sizes", b.with_(b.RECT, "a AS (SELECT poly AS id, w * h AS area, c0 + w / 2.0::DOUBLE AS cx, r0 + h / 2.0::DOUBLE AS cy FROM rect)", "l AS (SELECT cx AS x, cy AS y FROM a ORDER BY area DESC, id LIMIT 1)", "s AS (SELECT *, CASE WHEN area >= 30 THEN 'large' WHEN area >= 20 THEN 'medium' ELSE 'small' END AS band, (cx - x) * (cx - x) + (cy - y) * (cy - y) AS d2 FROM a, l)") + "SELECT band, id, CAST(area AS DOUBLE) AS area FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY d2, id) AS k FROM s) WHERE k = 1")
def _(s, d):
    r = b.rect(s, d).select(F.col("poly").alias("id"), (F.col("w") * F.col("h")).cast("double").alias("area"), (F.col("c0") + F.col("w") / 2).alias("cx"), (F.col("r0") + F.col("h") / 2).alias("cy"))
    return jobs.pick_sizes(r, [("large", 30, 1e9), ("medium", 20, 30), ("small", 0, 20)])


@query("ray_to_contour", b.with_(b.DEM, b.RECT, "st AS (SELECT poly, r0 AS r, c0 AS c, z FROM rect JOIN dem ON dem.r = r0 AND dem.c = c0)", "hit AS (SELECT st.poly, min(dem.c) AS c FROM st JOIN dem ON dem.r = st.r AND dem.c > st.c AND dem.c <= st.c + 10 AND dem.z > st.z + 5 GROUP BY st.poly)") + "SELECT st.poly, hit.c, h.z FROM st LEFT JOIN hit USING (poly) LEFT JOIN dem h ON h.r = st.r AND h.c = hit.c")
def _(s, d):
    return rays(b.rect(s, d).select("poly", F.col("r0").alias("r"), F.col("c0").alias("c")), b.dem(s, d), 5.0, 10)


def rays(starts: DataFrame, dem: DataFrame, above: float, most: int) -> DataFrame:
    """(poly, c, z): where rays to the east first meet ground ``above`` their start; each ray is a task on its own strip of cells."""
    strip = starts.withColumnRenamed("c", "c0").withColumn("c", F.explode(F.sequence(F.col("c0"), F.col("c0") + most))).join(dem, ["r", "c"])

    def run(pdf):
        import numpy as np
        import pandas as pd

        c0 = int(pdf["c0"].iloc[0])
        z = np.full((1, most + 1), np.nan)
        z[0, pdf["c"].to_numpy() - c0] = pdf["z"].to_numpy()
        hit = kernels.ray_to_contour(z, 0, 0, 0.0, 1.0, float(z[0, 0]), above, most) if np.isfinite(z[0, 0]) else None
        return pd.DataFrame({"poly": [pdf["poly"].iloc[0]], "c": pd.array([hit and hit[1] + c0], dtype="Int32"), "z": [hit[2] if hit else None]}).astype({"z": "float64"})

    return strip.groupBy("poly").applyInPandas(run, "poly long, c int, z double").select("poly", "c", F.when(F.col("c").isNotNull(), F.col("z")).alias("z"))


@query("first_occurrences", b.with_(b.PROFILE) + "SELECT grp, seq, CAST(floor(raw / 10) AS BIGINT) AS key FROM (SELECT *, row_number() OVER (PARTITION BY grp, floor(raw / 10) ORDER BY seq) AS k FROM profile) WHERE k = 1")
def _(s, d):
    keyed = b.profile(s, d).select("grp", "seq", F.floor(F.col("raw") / 10).alias("key"))
    return profiles.first_occurrences(keyed)


@query("finite_mean", b.with_(b.PROFILE) + "SELECT grp, round(avg(v), 6) AS mean FROM profile GROUP BY grp")
def _(s, d):
    return profiles.finite_mean(b.profile(s, d)).select("grp", F.round("mean", 6).alias("mean"))


@query("polygon_window", b.with_(*MASKS) + "SELECT poly, CAST(r - greatest(0, r0 - 1) AS INT) AS r, CAST(c - greatest(0, c0 - 1) AS INT) AS c FROM mask JOIN rect USING (poly)")
def _(s, d):
    box = b.rect(s, d).select("poly", F.greatest(F.lit(0), F.col("r0") - 1).alias("top"), F.greatest(F.lit(0), F.col("c0") - 1).alias("left"))
    return mask_of(s, d).join(box, "poly").select("poly", (F.col("r") - F.col("top")).alias("r"), (F.col("c") - F.col("left")).alias("c"))


@query("supported_classes", b.with_(b.RECT) + "SELECT poly, fclass FROM rect")
def _(s, d):
    return classes.require_supported(b.rect(s, d).select("poly", "fclass"))

