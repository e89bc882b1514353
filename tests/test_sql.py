"""Queries against their SQL on small tables made for a case."""

from datetime import datetime

import pytest

from tarn.operators import features, overlap
from tarn.plans import catalog


def agrees(spark, folder, name, **tables):
    """The query's rows, which must be those of its SQL; tables as (rows, schema)."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).collect()), key=key)
    assert got == sorted((tuple(r) for r in con.execute(catalog.SQL[name]).fetchall()), key=key)
    return got


def test_hops_end_where_the_sql_ends(spark, tmp_path):
    chain = [0, 1]
    while len(chain) < 16:
        chain.append(next(k for k in (3 * chain[-1] + i for i in range(3)) if k % 11))
    got = agrees(spark, tmp_path, "bfs_outlet", part=([(k,) for k in chain], "p_partkey long"))
    assert [h for _, h in got] == [*range(13), -1, -1, -1]


@pytest.mark.parametrize("name", ["local_maxima", "prominence", "peaks_filtered"])
def test_equal_neighbours_are_no_peak(spark, tmp_path, name):
    series = {1: [10.0, 90.0, 90.0, 20.0, 70.0, 5.0, 80.0, 80.0, 80.0, 1.0, 60.0, 2.0], 2: [1.0, 50.0, None, 60.0, 3.0, 90.0, 4.0, None, 9.0], 3: [7.0, 7.0]}
    rows = [(100 * u + i, datetime(2020, 1, 1, 0, i), u, "view", v, "{}") for u, x in series.items() for i, v in enumerate(x)]
    got = agrees(spark, tmp_path, name, events=(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"))
    assert [r[:2] for r in got] == [(1, 4), (1, 10), (2, 5)]


COPIES = {
    "customer": ([(1200 * i,) for i in range(5)], "c_custkey long"),
    "part": ([(400 * i, 7) for i in range(4)], "p_partkey long, p_size int"),
    "orders": ([(1200 * i,) for i in range(3)], "o_orderkey long"),
    "supplier": ([(2924 * i, 2) for i in range(6)], "s_suppkey long, s_nationkey int"),
}


@pytest.mark.parametrize("name, rows", [("classify_priority", 5), ("classify_general", 5), ("bbox_join", 20), ("rect_overlap_ratio", 20), ("point_in_polygon", 24), ("overlap_area", 20), ("polygons_meet", 20), ("line_clip_length", 15)])
def test_equal_shapes_are_joined_once(spark, tmp_path, monkeypatch, name, rows):
    joins, join = [], features.box_join
    for module in (features, overlap):
        monkeypatch.setattr(module, "box_join", lambda *a: joins.append(join(*a)) or joins[-1])
    assert len(agrees(spark, tmp_path, name, **COPIES)) == rows
    assert [j.count() for j in joins] == [1] * (2 if name.startswith("classify") else 1)


def test_long_lists_clip_a_pair_of_shapes_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(features, "CHUNK", 2)
    joins, join = [], features.box_join
    monkeypatch.setattr(features, "box_join", lambda *a: joins.append(join(*a)) or joins[-1])
    more = {t: (rows + [(None, *rows[0][1:])], schema) for t, (rows, schema) in COPIES.items()}
    assert len(agrees(spark, tmp_path, "line_clip_length", **more)) == 15 + 3
    assert [j.count() for j in joins] == [1]


def test_lists_of_ids_are_parted_and_keep_nulls(spark, monkeypatch):
    monkeypatch.setattr(features, "CHUNK", 2)
    rows = [(i, 0.0) for i in range(5)] + [(None, 0.0), (None, 0.0), (7, 1.0), (7, 1.0), (None, None)]
    lists = features.alike(spark.createDataFrame(rows, "id long, x double"), "x")
    assert all(len(r.ids) <= 2 for r in lists.collect())
    got = features.apart(lists.selectExpr("x", "ids AS l_ids", "array(x) AS r_ids"), "id", "copy", "x").select("id", "x")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
