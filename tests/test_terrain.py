from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import classes, tiles
from tarn.operators import features, kernels, lakes, raster
from tarn.plans import catalog

SF = "/root/testdata/sf0.01"


def test_multi_peak():
    z = kernels.multi_peak(np.array([100, 130, 90, 70, 110, 150, 80, 60, 40.0]))
    assert z.tolist() == [97.5] * 4 + [130, 130, 80, 60, 40]
    flat = np.array([50, 80, 120, 90, 60, 40, 20.0])
    assert kernels.multi_peak(flat).tolist() == flat.tolist()


def test_peaks():
    assert kernels.peaks(np.array([0, 1, 0, 2, 0, 3, 0.0]), 0.5) == [1, 3, 5]
    assert kernels.peaks(np.array([0, 2, 2, 2, 0, 1, 3, 3, 0.0]), 0.0) == [2, 6]


def test_harmonic_is_a_plane_and_keeps_the_maximum_principle():
    r, c = np.mgrid[:12, :16]
    plane = 100 + 0.5 * c + 0.2 * r
    edge = (r == 0) | (r == 11) | (c == 0) | (c == 15)
    assert abs(kernels.harmonic(np.ones((12, 16), bool), edge, plane) - plane).max() < 1e-6
    pin = (r == 5) & ((c == 2) | (c == 12))
    z = kernels.harmonic(np.ones((12, 16), bool), pin, plane)
    assert plane[pin].min() - 1e-9 <= z.min() and z.max() <= plane[pin].max() + 1e-9


def test_edt_against_brute_force():
    m = np.random.default_rng(6).random((9, 11)) < 0.8
    off = np.argwhere(~m)
    want = np.array([[np.sqrt(((off - (i, j)) ** 2).sum(1).min()) for j in range(11)] for i in range(9)])
    assert abs(kernels.edt(m) - want).max() < 1e-12


def test_medial_axis_is_thin_and_inside():
    m = np.zeros((14, 30), bool)
    m[4:10, 2:28] = True
    s = kernels.medial_axis(m)
    assert s.sum() == 32 and not (s & ~m).any()


def test_trimmed_median(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [])], "k int, v array<double>")
    assert [r[0] for r in df.orderBy("k").select(lakes.trimmed_median(F.col("v"))).collect()] == [1.0, None]


def test_id_repair(spark):
    df = spark.createDataFrame([(0, "7"), (1, None), (2, "7"), (3, "30000000")], "idx long, fid string")
    got = [r["featureid"] for r in features.repair_ids(df).orderBy("idx").collect()]
    assert got == ["7", "30000001", "30000002", "30000000"]


def test_aliases_and_quadkeys(spark):
    df = spark.createDataFrame([("River",), (" 河流 ",), ("lake （湖泊）",), ("nope",)], "x string")
    assert [r[0] for r in df.select(classes.normalize_alias(F.col("x"))).collect()] == ["river", "river", "lake", None]
    row = spark.createDataFrame([(3, 5, 3)], "x long, y long, z int").select(tiles.quadkey(F.col("x"), F.col("y"), F.col("z"))).first()
    assert row[0] == "213"
    assert spark.createDataFrame([("3210",)], "q string").select(tiles.base4(F.col("q"))).first()[0] == 228


def test_erosion_inside_mask_inside_dilation(spark):
    m = spark.createDataFrame([(1, r, c) for r in range(3, 8) for c in range(2, 9)], "poly int, r int, c int")
    e, d = raster.erode(m, 1), raster.dilate(m, 2, 12, 12)
    assert e.count() == 15 and e.subtract(m).isEmpty() and m.subtract(d).isEmpty()


@pytest.mark.parametrize(
    "x, first, height",
    [([0, 1, 0, 2, 0, 3, 0], [1, 3, 5], [1, 2, 3]), ([1, 3, 1, 1, 5, 1], [1, 4], [2, 4]), ([0, 2, 2, 2, 0, 1, 3, 3, 0], [1, 6], [2, 3]), ([0, 5, 3, 6, 0], [1, 3], [2, 6]), ([], [], []), ([1], [], []), ([2, 2, 2], [], [])],
)
def test_prominences(x, first, height):
    a, _, h = kernels.prominences(np.array(x, float))
    assert a.tolist() == first and h.tolist() == height


def test_prominences_agree_with_walks():
    rng = np.random.default_rng(5)
    for n in range(1, 60):
        x = rng.integers(0, 8, n).astype(float)
        a, b, h = kernels.prominences(x)
        for least in (0, 1, 3):
            assert [(p + q) // 2 for p, q, y in zip(a, b, h) if y >= least] == kernels.peaks(x, least)


def without(name, *filters):
    """The result of the query's SQL at sf0.01 with its row filters taken out of the text."""
    duckdb = pytest.importorskip("duckdb")
    sql = catalog.SQL[name]
    for f in filters:
        sql = sql.replace(f, "")
    con = duckdb.connect()
    for t in ("part", "orders", "customer", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(tuple(r) for r in con.execute(sql).fetchall())


@pytest.mark.parametrize("name, filters", [("edt_distance", [" WHERE poly < 12"]), ("isotonic_down", [" WHERE grp < 40"]), ("isotonic_up", [" WHERE grp < 40"])])
def test_all_polygons_and_series_are_kept(spark, name, filters):
    got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, SF).collect())
    assert got == without(name, *filters)
    assert len({r[0] for r in got}) == {"edt_distance": 100}.get(name, 150)


@pytest.mark.parametrize("name", ["bbox_join", "rect_overlap_ratio", "classify_priority"])
def test_all_areas_and_lines_are_joined(spark, name):
    got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, SF).collect())
    want = without(name, " WHERE p_size % 8 = 0", " WHERE o_orderkey % 40 = 0")
    assert len(got) == len(want) and all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=2e-6) if name == "rect_overlap_ratio" else a == b for a, b in zip(got, want))


def test_keys_of_all_zooms_have_their_children(spark):
    keys = catalog.QUERIES["quadkey_encode"](spark, SF).collect()
    want = Counter()
    for k in keys:
        if len(k["quadkey"]) <= 5:
            want.update((k["id"], k["quadkey"] + "".join(t)) for t in product("0123", repeat=5 - len(k["quadkey"])))
    assert {len(k["quadkey"]) for k in keys} == set(range(1, 13))
    assert Counter((r["id"], r["child"]) for r in catalog.QUERIES["quadkey_children"](spark, SF).collect()) == want
