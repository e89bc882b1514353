import json
import os

import pytest
from pyspark.sql import functions as F

from tarn import cli, jobs, tasks
from tarn.functions import classes, tiles
from tarn.operators import features, graph, layers, order
from tarn.plans import catalog, jobs_catalog  # noqa: F401
from tarn.sources import geojson, geopackage, geotiff
from tarn.streaming import tile_feed

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
def test_tiled_surface_equals_the_relational_one(spark):
    z = {(r["r"], r["c"]): r["z"] for r in catalog.QUERIES["hydro_relational"](spark, SF).collect()}
    got = {(r["r"], r["c"]): r["z"] for r in catalog.QUERIES["hydro_surface"](spark, SF).collect()}
    # cells without terrain and water are no data in the job's raster and no row in the other
    assert {k: v for k, v in got.items() if v != -9999.0} == z


def test_positions_without_one_task(spark):
    rows = [(i * 7919 % 1000, i) for i in range(500)] + [(5, 1000), (5, 1001)]
    d = spark.createDataFrame(rows, "k int, v int")
    got = sorted((r["k"], r["v"], r["s"]) for r in order.running(d, "k", [F.col("v")], F.lit(2), "s").collect())
    assert [s for _, _, s in got] == [2 * (i + 1) for i in range(502)]
    assert order.numbered(d.filter("false"), "k", "n").count() == 0


def test_ids_are_compared_as_text(spark):
    d = spark.createDataFrame([(0, "030000000"), (1, None), (2, " a "), (3, "a"), (4, "30000001"), (5, "")], "idx long, fid string")
    got = {r["idx"]: r["featureid"] for r in features.repair_ids(d).collect()}
    assert got == {0: "030000000", 1: "30000000", 2: "a", 3: "30000002", 4: "30000001", 5: "30000003"}


def test_hops_end_on_cycles(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)], "a long, b long")
    nodes = spark.range(8).select(F.col("id").alias("node"))
    got = {r["node"]: r["hops"] for r in graph.hops(nodes, edges, spark.range(1).select(F.col("id").alias("node"))).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: -1, 5: -1, 6: -1, 7: -1}


def test_classes_are_guarded(spark):
    d = spark.createDataFrame([("lake",), ("pond",), (None,), ("水体",)], "fclass string")
    with pytest.raises(ValueError, match="<null>, pond, 水体"):
        jobs.edge_depth(d)
    with pytest.raises(ValueError):
        classes.parameters(spark, {"pond": (1.0, 2.0)})
    got = jobs.edge_depth(d.limit(1), overrides={"湖泊": (1.0, 2.0)}).first()
    assert (got["edgeexpand"], got["depth"]) == (1.0, 2.0)


def test_keys_below_the_zoom_are_an_error_when_strict(spark):
    k = spark.createDataFrame([("01",), ("0123",)], "quadkey string")
    assert tiles.children(k, 3).count() == 4
    with pytest.raises(Exception, match="no key at or above zoom 3"):
        tiles.children(k, 3, strict=True).collect()


def square(x, y, n):
    return [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]


@pytest.fixture()
def files(tmp_path):
    """A small scene in metres of zone 50: two water boxes, a lake reference, a river reference, a terrain."""
    import numpy as np

    x0, y0 = 500000.0, 3_000_000.0
    feature = lambda g, p: {"type": "Feature", "geometry": g, "properties": p}
    poly = lambda *rings: {"type": "Polygon", "coordinates": list(rings)}
    put = lambda name, fs: (tmp_path / name).write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    put("water.geojson", [feature(poly(square(x0 + 100, y0 + 100, 200)), {"name": "a", "fclass": "x"}), feature(poly(square(x0 + 500, y0 + 500, 200)), {"name": "b", "fclass": "x"})])
    put("lakes.geojson", [feature(poly(square(x0 + 50, y0 + 50, 400)), {})])
    put("rivers.geojson", [feature({"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[x0 + 450, y0 + 600], [x0 + 800, y0 + 610]]}]}, {})])
    z = (np.arange(100)[None, :] + np.arange(90)[:, None] * 0.5).astype(np.float32)
    (tmp_path / "dem.tif").write_bytes(geotiff.encode(z, (10.0, 0.0, x0, 0.0, -10.0, y0 + 900), 32650, -9999.0))
    return tmp_path


def test_command_line(spark, files, capsys):
    water = f"{files}/water.geojson@32650"
    out = cli.run(spark, ["inspect", "--water", water, "--dem", f"{files}/dem.tif"])
    told = json.loads(capsys.readouterr().out)
    assert told["features"] == 2 and told["sampled"] == 2 and told["maxx"] == 500700.0
    assert [round(r["area"]) for r in out.collect()] == [40000, 40000]
    got = cli.run(spark, ["fclass", "--water", water, "--reference", f"lake={files}/lakes.geojson@32650", "--reference", f"river={files}/rivers.geojson@32650"])
    assert sorted((r["feature_idx"], r["featureid"], r["fclass"]) for r in got.collect()) == [(0, "30000000", "lake"), (1, "30000001", "river")]
    with pytest.raises(ValueError, match="unsupported classes: x"):
        cli.run(spark, ["edge-depth", "--water", water])
    cli.run(spark, ["hydro", "--water", water, "--dem", f"{files}/dem.tif", "--output", f"{files}/out", "--tile", "64"])
    cells = geotiff.cells(geotiff.read(spark, f"{files}/out/*.tif"))
    assert cells.count() == 9000
    with pytest.raises(SystemExit):
        cli.run(spark, ["inspect", "--water", f"{files}/none.geojson"])


def test_chain_and_registry(spark, files):
    import time

    water, epsg = cli.layer(spark, f"{files}/water.geojson@32650")
    refs = {"lake": cli.layer(spark, f"{files}/lakes.geojson@32650"), "river": cli.layer(spark, f"{files}/rivers.geojson@32650")}
    dem = jobs.Raster.open(spark, f"{files}/dem.tif")
    registry = tasks.Registry()
    first = registry.submit("chain", lambda tell: {k: v.count() for k, v in tasks.run_chain(["edge-depth", "hydro"], water, epsg, refs, dem, tell=tell).items()})
    assert first["status"] == "pending"
    seen = [s["status"] for _, s in registry.events(first["id"], 0.05)]
    assert seen[-1] == "completed" and registry.report(first["id"]) == {"fclass": 2, "edge-depth": 2, "hydro": 1}
    assert list(registry.events("none"))[0][0] == "error" and registry.snapshot("none") is None
    bad = registry.submit("chain", lambda tell: tasks.run_chain(["nothing"], water, epsg, refs))
    while registry.snapshot(bad["id"])["status"] not in tasks.ENDED:
        time.sleep(0.02)
    assert registry.snapshot(bad["id"])["status"] == "failed"
    with pytest.raises(KeyError):
        registry.report(bad["id"])


def test_missing_and_odd_layers(spark, files):
    empty = geojson.read(spark, f"{files}/water.geojson").filter("false")
    for call in (lambda: layers.require_water(empty), lambda: jobs.fclass(empty, 4326, {}), lambda: layers.require_water(geojson.read(spark, f"{files}/lakes.geojson")), lambda: layers.require_areal(geojson.read(spark, f"{files}/rivers.geojson"))):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(NotImplementedError):
        jobs.fclass(geojson.read(spark, f"{files}/water.geojson"), 32650, {}, mode="transition")
    (files / "x.gpkg").write_bytes(geopackage.build("a", [(1, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]], {"n": "x"})], 4326, tree=False))
    assert geopackage.read(spark, f"{files}/x.gpkg", "b").count() == 0
    assert geopackage.read(spark, f"{files}/x.gpkg", "a", (2.0, 2.0, 3.0, 3.0)).count() == 0
    assert geopackage.read(spark, f"{files}/x.gpkg", "a", (0.5, 0.0, 3.0, 3.0)).first()["properties"] == {"n": "x"}


def test_tile_feed_serves_each_request_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    (asked / "1.json").write_text('{"tile": 1, "asked": "2024-01-01T00:00:00"}\n{"tile": 2, "asked": "2024-01-01T00:00:30"}\n{"tile": 1, "asked": "2024-01-01T00:01:10"}\n')
    work = lambda t: t.withColumn("done", F.col("tile") * 10)
    serve = lambda: tile_feed.serve(tile_feed.requests(spark, str(asked)), work, f"{tmp_path}/out", f"{tmp_path}/state")
    serve()
    (asked / "2.json").write_text('{"tile": 3, "asked": "2024-01-01T00:02:00"}\n')
    serve()
    serve()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["done"] for r in got.collect()) == [10, 20, 30] and got.select("batch").distinct().count() == 2
    batch = spark.read.schema(tile_feed.REQUEST).json(str(asked))
    assert sorted((r["requests"], r["tiles"]) for r in tile_feed.load(batch).collect()) == [(1, 1), (1, 1), (2, 2)]
