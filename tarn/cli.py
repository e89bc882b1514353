"""Command line: ``python -m tarn.cli inspect | fclass | edge-depth | hydro``."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs
from .functions import classes, crs
from .operators import layers
from .sources import geojson, geopackage, geotiff, store


def layer(spark: SparkSession, text: str) -> tuple[DataFrame, int]:
    """(layer, code) of ``file.geojson[@code]`` or ``file.gpkg#layer``."""
    if "#" in text:
        path, name = text.rsplit("#", 1)
        known = [r["epsg"] for r in geopackage.layers(spark, path).filter(F.col("layer") == name).collect()]
        if not known:
            raise SystemExit(f"no layer {name} in {path}")
        return geopackage.read(spark, path, name), known[0]
    path, _, code = text.partition("@")
    return geojson.read(spark, path), int(code or crs.GEOGRAPHIC)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarn", description=__doc__)
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("inspect", "describe a water layer and the terrain at its centroids"), ("fclass", "classify by reference layers"), ("edge-depth", "add edge and depth columns"), ("hydro", "compute the water surface")):
        s = sub.add_parser(name, help=help_)
        s.add_argument("--water", required=True, help="file.geojson[@code] or file.gpkg#layer")
        s.add_argument("--output", help="folder of the result")
        if name in ("inspect", "hydro"):
            s.add_argument("--dem", required=name == "hydro", help="GeoTIFF file")
        if name == "fclass":
            s.add_argument("--reference", action="append", default=[], required=True, metavar="CLASS=LAYER")
        if name == "edge-depth":
            s.add_argument("--set", action="append", default=[], metavar="CLASS:EDGE:DEPTH")
        if name == "hydro":
            s.add_argument("--no-dem", action="store_true", help="no data off the water, not the terrain")
            s.add_argument("--centre-rule", action="store_true", help="cells by their centre, not all that edges touch")
            s.add_argument("--skirt", type=int, default=5)
            s.add_argument("--tile", type=int, default=jobs.TILE)
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """The result of a command line; written to ``--output`` where that is given."""
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO)
    path = a.water.split("#")[0].split("@")[0]
    if not store.exists(spark, path):
        raise SystemExit(f"no such file: {path}")
    water, epsg = layer(spark, a.water)
    if a.command == "inspect":
        if a.dem:
            dem = jobs.Raster.open(spark, a.dem)
            out = jobs.inspect(water, geotiff.cells(dem.blocks), dem.transform)
        else:
            out = jobs.inspect(water)
        print(json.dumps(jobs.summary(out, water).first().asDict()))
    elif a.command == "fclass":
        out = jobs.fclass(water, epsg, {k: layer(spark, v) for k, v in (r.split("=", 1) for r in a.reference)})
    elif a.command == "edge-depth":
        over = {c: (e, d) for c, e, d in map(classes.parse_override, a.set)}
        out = jobs.edge_depth(water.withColumn("fclass", layers.attribute(F.col("properties"), "fclass")), "fclass", over)
    else:
        if not store.exists(spark, a.dem):
            raise SystemExit(f"no such file: {a.dem}")
        layers.require_water(water)
        dem = jobs.Raster.open(spark, a.dem)
        flat = layers.flatten(water).select((F.col("feature_idx") * 1_000_000 + F.col("part")).alias("poly"), "rings", "fclass")
        out = jobs.hydro(flat, epsg, dem, not a.no_dem, not a.centre_rule, a.skirt, a.tile)
        if a.output:
            t = dem.transform
            own = F.array(F.lit(t[0]), F.lit(0.0), F.lit(t[2]) + F.col("col0") * t[0], F.lit(0.0), F.lit(t[4]), F.lit(t[5]) + F.col("row0") * t[4])
            geotiff.write(out.withColumns({"transform": own, "epsg": F.lit(dem.epsg)}), a.output)
            return out
    if a.output:
        out.write.mode("error").json(a.output)
    return out


def main() -> None:
    from .session import ship

    run(ship(SparkSession.builder.getOrCreate()), __import__("sys").argv[1:])


if __name__ == "__main__":
    main()
