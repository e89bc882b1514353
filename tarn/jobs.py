"""The composite jobs: inspect, classify, edge and depth, water surface (one window or tiles), crops, diagnostics.

Rasters are given as blocks (:mod:`tarn.sources.geotiff`) or cells, layers as DataFrames
(:mod:`tarn.sources.geojson`, ``geopackage``, ``shapefile``). Nothing is collected but what a job decides by: extents,
counts, one header.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import classes, crs, geometry, tiles
from .operators import layers, overlap, raster, window
from .sources import geotiff

TILE, PAD, MOST_PIXELS = 8192, 64, 250_000_000
AOI_PAD = 100.0  # metres
WORKING = crs.MERCATOR


@dataclass
class Raster:
    """A terrain raster: blocks with row0, col0, h, w, data; its grid and code."""

    blocks: DataFrame
    width: int
    height: int
    transform: tuple
    epsg: int

    @classmethod
    def open(cls, spark, path: str, block: int = geotiff.BLOCK) -> Raster:
        """One file (a mosaic of several is first :func:`geotiff.sampled`)."""
        m = geotiff.metadata(spark, path).collect()
        if len(m) != 1:
            raise ValueError(f"{len(m)} rasters at {path}")
        if m[0]["epsg"] is None:
            raise ValueError("the terrain has no coordinate system")
        return cls(geotiff.read(spark, path, block=block), m[0]["width"], m[0]["height"], tuple(m[0]["transform"]), m[0]["epsg"])


def extent(shapes: DataFrame, rings: str = "rings", pad: float = 0.0) -> tuple[float, float, float, float] | None:
    """Box of all shapes, widened by ``pad``; None without any."""
    b = shapes.select(geometry.bounds(F.col(rings)).alias("b")).agg(F.min("b.minx"), F.min("b.miny"), F.max("b.maxx"), F.max("b.maxy")).first()
    return None if b[0] is None else (b[0] - pad, b[1] - pad, b[2] + pad, b[3] + pad)


def inspect(layer: DataFrame, dem: DataFrame | None = None, transform: tuple = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """(feature_idx, part, fclass, area, cx, cy, elev): each polygon with its centroid and the terrain there (cells ``dem``), coordinates as they are."""
    p = layers.flatten(layer).withColumn("m", overlap.shape_measures(F.col("rings")))
    p = p.select("feature_idx", "part", "fclass", F.abs("m.area").alias("area"), F.col("m.cx").alias("cx"), F.col("m.cy").alias("cy"))
    if dem is None:
        return p.withColumn("elev", F.lit(None).cast("double"))
    at = raster.bilinear(p.select(F.struct("feature_idx", "part").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y")), dem, transform)
    return p.join(at.select("id.feature_idx", "id.part", "elev"), ["feature_idx", "part"], "left")


def summary(inspected: DataFrame, layer: DataFrame) -> DataFrame:
    """One row: features, polygons, sampled, minx, miny, maxx, maxy, class counts."""
    box = layers.flatten(layer).select(geometry.bounds(F.col("rings")).alias("b")).agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))
    counts = inspected.agg(F.countDistinct("feature_idx").alias("features"), F.count("*").alias("polygons"), F.count("elev").alias("sampled"), F.countDistinct("fclass").alias("classes"))
    return counts.join(box)


def in_working(shapes: DataFrame, epsg: int, target: int = WORKING) -> DataFrame:
    return shapes.withColumn("rings", geometry.reproject(F.col("rings"), epsg, target))


def reference(layer: DataFrame, name: str, epsg: int, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(polygons, segments) of a reference layer in the working code that meet the area of interest ``box``; collections are taken apart."""
    meets = lambda b: (F.col(f"{b}.maxx") >= box[0]) & (F.col(f"{b}.minx") <= box[2]) & (F.col(f"{b}.maxy") >= box[1]) & (F.col(f"{b}.miny") <= box[3])
    areas = in_working(layers.flatten(layers.simple(layer), F.lit(None).cast("string")), epsg).withColumn("b", geometry.bounds(F.col("rings"))).filter(meets("b"))
    areas = areas.select(F.concat_ws(":", F.lit(name), "feature_idx", "part").alias("id"), F.lit(name).alias("layer"), "rings")
    lines = layers.segments(layer).withColumn("rings", F.array(F.array("segment.a", "segment.b")))
    lines = in_working(lines, epsg).withColumn("b", geometry.bounds(F.col("rings"))).filter(meets("b"))
    lines = lines.select(F.concat_ws(":", F.lit(name), "feature_idx", "line").alias("id"), F.lit(name).alias("layer"), F.struct(F.col("rings")[0][0].alias("a"), F.col("rings")[0][1].alias("b")).alias("segment"))
    return areas, lines


def fclass(water: DataFrame, epsg: int, references: dict[str, tuple[DataFrame, int]], cell: float = 2000.0, mode: str = "reference") -> DataFrame:
    """``water`` with featureid and class by the reference layers {name: (layer, code)}; a layer that is missing is empty."""
    if mode != "reference":
        raise NotImplementedError(f"mode {mode}")
    if water.isEmpty():
        raise ValueError("the water layer has no features")
    layers.require_areal(water)
    shapes = in_working(layers.flatten(water), epsg)
    box = extent(shapes, pad=AOI_PAD)
    areas = lines = None
    for name, (layer, code) in references.items():
        a, li = reference(layer, name, code, box)
        areas, lines = (a, li) if areas is None else (areas.unionByName(a), lines.unionByName(li))
    if areas is None:
        raise ValueError("there is no reference layer")
    whole = shapes.groupBy("feature_idx").agg(F.flatten(F.array_sort(F.collect_list(F.struct("part", "rings")))["rings"]).alias("rings"))  # parts of one feature
    found = overlap.classify(whole.select(F.col("feature_idx").alias("id"), "rings"), areas, lines, cell)
    return layers.classified(water, found.select(F.col("id").alias("feature_idx"), "fclass"))


def edge_depth(water: DataFrame, class_col: str = "fclass", overrides: dict | None = None) -> DataFrame:
    """``water`` with edgeexpand and depth; an unsupported class is an error that names all of them."""
    return classes.enrich(classes.require_supported(water, class_col), class_col, overrides)


def tile_jobs(dem: Raster, size: int = TILE, pad: int = PAD) -> DataFrame:
    return tiles.plan(dem.blocks.sparkSession, dem.width, dem.height, size, pad)


def _tile_polygons(water: DataFrame, dem: Raster, epsg: int, size: int) -> DataFrame:
    """(poly, tile) of the tiles that polygons' boxes meet in the terrain's code."""
    a, _, c, _, e, f = dem.transform
    own = in_working(water, epsg, dem.epsg).select("poly", geometry.bounds(F.col("rings")).alias("b"))
    px = own.select("poly", ((F.col("b.minx") - c) / a).alias("x0"), ((F.col("b.maxx") - c) / a).alias("x1"), ((F.col("b.miny") - f) / e).alias("y0"), ((F.col("b.maxy") - f) / e).alias("y1"))
    px = px.select("poly", F.floor(F.least("x0", "x1")).alias("c0"), F.ceil(F.greatest("x0", "x1")).alias("c1"), F.floor(F.least("y0", "y1")).alias("r0"), F.ceil(F.greatest("y0", "y1")).alias("r1"))
    return tiles.overlaps(px, dem.blocks.sparkSession, dem.width, dem.height, size)


def hydro(water: DataFrame, epsg: int, dem: Raster, with_dem: bool = True, all_touched: bool = True, skirt: int = 5, size: int = TILE, pad: int = PAD, working: int | None = None, max_error: float = window.MAX_ERROR) -> DataFrame:
    """Blocks (row0, col0, h, w, data) of the composed water surface, one for each tile of the terrain.

    ``water``: (poly, rings, fclass) in the order of ``poly``. A tile with water is one task: its padded terrain and
    the polygons that meet it (:func:`window.process`). Dry tiles are the terrain, or no data. A polygon that spans tiles
    is solved in each, so results depend on the tile size; with one tile that is the whole window.
    """
    if size * size > MOST_PIXELS:
        raise ValueError("a tile has too many pixels")
    box = extent(water)
    if box is None:
        raise ValueError("the water layer has no polygons")
    target = working or crs.working_epsg(dem.epsg, box, epsg)
    t, source = dem.transform, dem.epsg
    plan = tile_jobs(dem, size, pad)
    # terrain: each block under the padded tiles that it meets
    j = dem.blocks.select("row0", "col0", "h", "w", "data").withColumnRenamed("h", "bh").withColumnRenamed("w", "bw")
    across = -(-dem.width // size)
    span = lambda lo, n, most: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((lo - pad) / size)), F.least(F.lit(-(-most // size) - 1), F.floor((lo + n - 1 + pad) / size))))
    j = j.withColumn("ty", span(F.col("row0"), F.col("bh"), dem.height)).withColumn("tx", span(F.col("col0"), F.col("bw"), dem.width))
    parts = j.select((F.col("ty") * across + F.col("tx")).alias("tile"), "row0", "col0", "bh", "bw", "data")
    shapes = in_working(water, epsg, target).select("poly", "rings", classes.is_still_water(F.col("fclass")).alias("still"))
    met = _tile_polygons(water, dem, epsg, size).join(shapes, "poly").select("tile", F.struct("poly", "still", "rings").alias("shape"))

    def run(key, left, right):
        import pandas as pd

        tile = key[0]
        q0, r0 = tile % across * size, tile // across * size
        w, h = min(size, dem_w - q0), min(size, dem_h - r0)
        pc, pr = max(0, q0 - pad), max(0, r0 - pad)
        pw, ph = min(dem_w, q0 + w + pad) - pc, min(dem_h, r0 + h + pad) - pr
        ground = np.full((ph, pw), np.nan, np.float32)
        for br, bc, bh, bw, data in left[left["data"].notna()][["row0", "col0", "bh", "bw", "data"]].itertuples(index=False):
            br, bc, bh, bw = int(br), int(bc), int(bh), int(bw)
            top, low, lo, hi = max(pr, br), min(pr + ph, br + bh), max(pc, bc), min(pc + pw, bc + bw)
            if top < low and lo < hi:
                ground[top - pr : low - pr, lo - pc : hi - pc] = np.frombuffer(data, np.float32).reshape(bh, bw)[top - br : low - br, lo - bc : hi - bc]
        core = (slice(r0 - pr, r0 - pr + h), slice(q0 - pc, q0 - pc + w))
        if len(right):
            found = sorted(right["shape"], key=lambda s: s["poly"])
            rings = [[np.array([(p["x"], p["y"]) for p in ring]) for ring in s["rings"]] for s in found]
            out = window.process(ground, crs.window_transform(t, pc, pr), source, target, rings, [s["still"] for s in found], all_touched, with_dem, skirt, max_error)[core]
        else:
            out = np.where(np.isfinite(ground[core]) & with_dem, ground[core], np.float32(window.NODATA))
        return pd.DataFrame({"row0": [r0], "col0": [q0], "h": [h], "w": [w], "data": [np.ascontiguousarray(out, np.float32).tobytes()]})

    dem_w, dem_h = dem.width, dem.height
    # every tile has a group even where the terrain has no block
    none = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in ("row0", "col0", "bh", "bw", "data")]
    parts = parts.unionByName(plan.select(F.col("tile").cast("long"), *none))
    return parts.groupBy("tile").cogroup(met.groupBy("tile")).applyInPandas(run, "row0 int, col0 int, h int, w int, data binary")


def crop(blocks: DataFrame, col0: int, row0: int, w: int, h: int) -> DataFrame:
    """Cells (r, c, z) of a window of blocks, counted from its corner; blocks outside are not decoded."""
    near = blocks.filter((F.col("row0") < row0 + h) & (F.col("row0") + F.col("h") > row0) & (F.col("col0") < col0 + w) & (F.col("col0") + F.col("w") > col0))
    c = geotiff.cells(near).filter(F.col("r").between(row0, row0 + h - 1) & F.col("c").between(col0, col0 + w - 1))
    return c.select((F.col("r") - row0).alias("r"), (F.col("c") - col0).alias("c"), "z")


def pick_sizes(shapes: DataFrame, bands: list[tuple[str, float, float]]) -> DataFrame:
    """(band, id, area): of each area band (name, least, most) the polygon (id, area, cx, cy) nearest to the largest one of all, ties by id."""
    large = shapes.orderBy(F.desc("area"), "id").limit(1).select(F.col("cx").alias("x"), F.col("cy").alias("y"))
    case = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for n, a, b in bands])
    s = shapes.withColumn("q", F.explode(case)).filter((F.col("area") >= F.col("q.a")) & (F.col("area") < F.col("q.b")))
    d = s.join(F.broadcast(large)).withColumn("d2", (F.col("cx") - F.col("x")) * (F.col("cx") - F.col("x")) + (F.col("cy") - F.col("y")) * (F.col("cy") - F.col("y")))
    best = d.groupBy(F.col("q.band").alias("band")).agg(F.min_by(F.struct("id", "area"), F.struct("d2", "id")).alias("m"))
    return best.select("band", "m.id", "m.area")


def difference_bands(left: DataFrame, right: DataFrame, limits: tuple[float, ...] = (0.01, 0.1, 1.0, 5.0)) -> DataFrame:
    """(band, n, mean, most) of the absolute differences of two surfaces (r, c, z), by the first limit they stay below; band = count of limits for the rest."""
    j = left.select("r", "c", F.col("z").alias("a")).join(right.select("r", "c", F.col("z").alias("b")), ["r", "c"]).withColumn("d", F.abs(F.col("a") - F.col("b")))
    band = sum((F.when(F.col("d") >= x, 1).otherwise(0) for x in limits), F.lit(0))
    return j.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.max("d").alias("most"))


def domes(surface: DataFrame, dem: DataFrame, height: float) -> DataFrame:
    """(r, c, rise): cells where the surface stands over the terrain by more than ``height`` and is the highest of its 5 x 5 neighbourhood."""
    j = surface.select("r", "c", "z").join(dem.select("r", "c", F.col("z").alias("d")), ["r", "c"]).withColumn("rise", F.col("z") - F.col("d"))
    high = j.filter(F.col("rise") > height)
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i in range(-2, 3) for k in range(-2, 3)]))
    around = high.withColumn("o", o).select("r", "c", "rise", "z", (F.col("r") + F.col("o.i")).alias("nr"), (F.col("c") + F.col("o.k")).alias("nc"))
    top = around.join(surface.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("z").alias("nz")), ["nr", "nc"]).groupBy("r", "c", "rise", "z").agg(F.max("nz").alias("top"))
    return top.filter(F.col("z") >= F.col("top")).select("r", "c", "rise")


def near_seams(points: DataFrame, size: int = TILE, reach: int = 16) -> DataFrame:
    """``points`` (r, c, ...) with their distance to the nearest tile seam, and whether it is within ``reach``."""
    to = lambda v: F.least(F.pmod(v, F.lit(size)), size - F.pmod(v, F.lit(size)))
    d = F.least(to(F.col("r")), to(F.col("c")))
    return points.withColumns({"seam": d, "near": d <= reach})


def hydro_pixels(width: int, height: int) -> bool:
    """Whether a window is small enough to be worked whole."""
    return width * height <= MOST_PIXELS and math.isfinite(width * height)
