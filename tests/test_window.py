import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.functions import classes, crs
from tarn.operators import kernels, overlap, window
from tarn.sources import geopackage, geotiff


def ring(*points):
    return np.array([*points, points[0]], float)


def test_touched_cells():
    # a slanted edge passes through these cells; the triangle's centre cells are fewer
    tri = [ring((0.5, 0.5), (5.5, 2.2), (0.5, 3.5))]
    centre, touched = window.mask(tri, 5, 7, False), window.mask(tri, 5, 7, True)
    assert (touched | centre == touched).all()
    cells = {(int(r), int(c)) for r, c in zip(*np.nonzero(touched))}
    for t in np.linspace(0, 1, 2001):
        for (x0, y0), (x1, y1) in zip(tri[0][:-1], tri[0][1:]):
            x, y = x0 + (x1 - x0) * t, y0 + (y1 - y0) * t
            near = {(math.floor(y + b), math.floor(x + a)) for a in (-0.011, 0.011) for b in (-0.011, 0.011)}
            assert near & cells
    # edges on grid lines touch nothing beyond the centre rule
    box = [ring((1, 1), (4, 1), (4, 3), (1, 3))]
    assert (window.mask(box, 5, 7, True) == window.mask(box, 5, 7, False)).all()


@given(st.lists(st.tuples(st.floats(0, 12), st.floats(0, 9)), min_size=3, max_size=7))
@settings(max_examples=60, deadline=None)
def test_centre_mask_is_the_even_odd_rule(points):
    r = ring(*points)
    got = window.centre_mask([r], 9, 12)
    for i in range(9):
        for j in range(12):
            x, y = j + 0.5, i + 0.5
            crossings = [x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in zip(r[:-1], r[1:]) if (y0 <= y) != (y1 <= y)]
            if all(abs(c - x) > 1e-6 for c in crossings) and all(abs(p[1] - y) > 1e-9 for p in r):
                assert got[i, j] == (sum(c > x for c in crossings) % 2 == 1)


@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**32 - 1))
@settings(max_examples=80, deadline=None)
def test_nearest_clear_against_all_pairs(h, w, seed):
    mask = np.random.default_rng(seed).random((h, w)) < 0.8
    d, row, col = kernels.nearest_clear(mask)
    clear = np.argwhere(~mask)
    for r in range(h):
        for c in range(w):
            if not len(clear):
                assert np.isinf(d[r, c])
                continue
            want = min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in clear.tolist())
            assert (round(d[r, c] ** 2), row[r, c], col[r, c]) == want


def test_junctions_against_all_pairs():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 40, (200, 2))
    a = rng.random(200) * 6.3
    t = np.column_stack((np.cos(a), np.sin(a)))
    d2 = ((s[:, None] - s[None]) ** 2).sum(2)
    want = ((d2 <= 16) & (d2 > 0) & (np.abs(t @ t.T) < 0.5)).any(1)
    assert (kernels.junctions(s, t) == want).all()


def test_ray_to_contour():
    dem = np.array([[1.0, np.nan, 2.0, 5.0, 9.0]])
    assert kernels.ray_to_contour(dem, 0, 0, 0, 1, 1.0, 3.0) == (0, 3, 5.0)
    assert kernels.ray_to_contour(dem, 0, 0, 0, 1, 10.0) is None and kernels.ray_to_contour(dem, 0, 4, 0, -1, 9.0) is None


def test_gaussian_f32_rounds_between_axes():
    x = np.arange(30, dtype=np.float32).reshape(5, 6) ** 2
    wide = kernels.gaussian_f32(x, 1.0)
    assert (wide == wide.astype(np.float32)).all() and abs(wide.mean() - x.mean()) < 30
    assert (kernels.gaussian_f32(x, 0) == x).all()


@pytest.mark.parametrize("code", [3857, 32650, 32750])
def test_projections_there_and_back(code):
    lon, lat = np.linspace(114.5, 119.5, 11), np.linspace(-60, 70, 11)
    x, y = crs.project(lon, lat, 4326, code)
    a, b = crs.project(x, y, code, 4326)
    assert np.abs(a - lon).max() < 1e-9 and np.abs(b - lat).max() < 1e-9


def test_utm_at_known_places():
    # on the central meridian the easting is half a million metres; the equator's northing is 0 or ten million
    assert crs.project(117.0, 0.0, 4326, 32650)[0] == pytest.approx(500000, abs=1e-6)
    assert crs.project(117.0, 0.0, 4326, 32750)[1] == pytest.approx(1e7, abs=1e-6)
    # length of the meridian from the equator to 45 degrees on this ellipsoid, scaled
    assert crs.project(117.0, 45.0, 4326, 32650)[1] == pytest.approx(0.9996 * 4984944.378, abs=0.01)
    assert crs.utm_of(113.9, 22.5) == 32649 and crs.utm_of(-70, -30) == 32719
    with pytest.raises(ValueError):
        crs.utm_of(0, 85)
    with pytest.raises(ValueError):
        crs.project(0, 0, 4326, 2154)
    assert crs.working_epsg(32649, (0, 0, 1, 1), 4326) == 32649 and crs.working_epsg(4326, (110, 22, 111, 23), 4326) == 32649


def test_approximate_warp_stays_within_its_error():
    t = (1e-3, 0.0, 110.0, 0.0, -1e-3, 30.0)
    wt, w, h = crs.warp_grid(4326, 32649, t, 300, 200)
    rows = np.arange(h)
    exact = window._points(rows, w, wt, 32649, 4326, t, 0.0)
    near = window._points(rows, w, wt, 32649, 4326, t, 0.125)
    assert max(np.abs(a - b).max() for a, b in zip(exact, near)) < 0.125 and any((a != b).any() for a, b in zip(exact, near))


def test_reproject_copies_on_the_same_grid_and_minds_no_data():
    rng = np.random.default_rng(1)
    z = rng.random((20, 30))
    z[3, 4] = np.nan
    t = (10.0, 0.0, 500000.0, 0.0, -10.0, 3e6)
    assert np.allclose(window.reproject(z, t, 32650, t, 30, 20, 32650), z, equal_nan=True)
    half = (10.0, 0.0, 500005.0, 0.0, -10.0, 3e6)
    out = window.reproject(z, t, 32650, half, 29, 20, 32650)
    assert np.allclose(out[3, 3], z[3, 3]) and np.allclose(out[3, 4], z[3, 5])  # what has no value gets no weight
    assert np.allclose(out[5], (z[5, :-1] + z[5, 1:]) / 2)
    flat = window.reproject(np.full((40, 50), 7.0), (0.01, 0.0, 110.0, 0.0, -0.01, 30.0), 4326, *crs.warp_grid(4326, 32649, (0.01, 0.0, 110.0, 0.0, -0.01, 30.0), 50, 40), 32649)
    assert np.nanmax(np.abs(flat - 7)) < 1e-12 and np.isfinite(flat).mean() > 0.9


def test_common_area():
    square = lambda x, y, n: [{"x": a, "y": b} for a, b in ((x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y))]
    assert overlap.common_area([square(0, 0, 4)], [square(2, 1, 4)]) == pytest.approx(6)
    assert overlap.common_area([square(0, 0, 6), square(1, 1, 4)[::-1]], [square(0, 0, 6)]) == pytest.approx(20)  # a hole
    assert overlap.common_area([square(0, 0, 1)], [square(1, 0, 1)]) == 0
    rng = np.random.default_rng(3)
    for _ in range(20):
        star = lambda: [[{"x": float(x), "y": float(y)} for x, y in (lambda p: np.vstack((p, p[:1])))(np.column_stack([f(a) * r + 5 for f in (np.cos, np.sin)]))] for a, r in [(np.sort(rng.random(8) * 6.28), rng.random(8) * 4 + 1)]]
        a, b = star(), star()
        cells = [window.centre_mask([np.array([(p["x"], p["y"]) for p in s[0]]) * 40], 400, 400) for s in (a, b)]
        assert overlap.common_area(a, b) == pytest.approx((cells[0] & cells[1]).sum() / 1600, abs=0.2)


def tiled_file(order, predictor, kind):
    """A two-by-two-tile file built field by field."""
    rng = np.random.default_rng(7)
    z = (rng.random((20, 30)) * 1000).astype(kind)
    full = np.zeros((32, 32), kind)
    full[:20, :30] = z
    tiles = []
    for r in (0, 16):
        for c in (0, 16):
            x = full[r : r + 16, c : c + 16]
            if predictor == 2:
                x = np.diff(x, axis=1, prepend=x[:, :1] * 0).astype(kind)
                raw = x.astype(np.dtype(kind).newbyteorder(order)).tobytes()
            elif predictor == 3:
                b = x.astype(np.dtype(kind).newbyteorder(">")).view(np.uint8).reshape(16, 16, -1).transpose(0, 2, 1).reshape(16, -1)
                raw = np.diff(b, axis=1, prepend=np.zeros((16, 1), np.uint8)).astype(np.uint8).tobytes()
            else:
                raw = x.astype(np.dtype(kind).newbyteorder(order)).tobytes()
            tiles.append(zlib.compress(raw))
    size = np.dtype(kind).itemsize
    keys = [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32650]
    tags = [(256, "H", [30]), (257, "H", [20]), (258, "H", [size * 8]), (259, "H", [8]), (277, "H", [1]), (317, "H", [predictor]), (322, "H", [16]), (323, "H", [16]), (324, "I", None), (325, "I", [len(t) for t in tiles]), (339, "H", [3 if np.dtype(kind).kind == "f" else 1]), (33550, "d", [2.0, 2.0, 0.0]), (33922, "d", [0, 0, 0, 100.0, 900.0, 0]), (34735, "H", keys), (42113, "s", b"0\0")]
    code = {"H": 3, "I": 4, "d": 12, "s": 2}
    at = 8 + 2 + 12 * len(tags) + 4
    body, entries = b"", b""
    places = []
    for t in tiles:
        places.append(at + len(body))
        body += t
    for tag, letter, v in tags:
        v = places if v is None else v
        raw = v if letter == "s" else struct.pack(order + letter * len(v), *v)
        n = len(v)
        if len(raw) <= 4:
            entries += struct.pack(order + "HHI", tag, code[letter], n) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack(order + "HHII", tag, code[letter], n, at + len(body))
            body += raw
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + body, z


@pytest.mark.parametrize("order,predictor,kind", [("<", 1, "u2"), (">", 1, "f4"), ("<", 2, "u2"), (">", 2, "u4"), ("<", 3, "f4"), (">", 3, "f8")])
def test_geotiff_layouts(order, predictor, kind):
    data, z = tiled_file(order, predictor, kind)
    h = geotiff.header(data)
    assert (h.width, h.height, h.epsg, h.transform) == (30, 20, 32650, (2.0, 0.0, 100.0, 0.0, -2.0, 900.0))
    want = np.where(z == 0, np.nan, z.astype(np.float32))
    assert np.allclose(geotiff.window(data, h, 0, 0, 30, 20), want, equal_nan=True)
    part = geotiff.window(data, h, 12, 10, 25, 15)
    assert np.allclose(part[:10, :18], want[10:, 12:], equal_nan=True) and np.isnan(part[10:]).all() and np.isnan(part[:, 18:]).all()


def test_geotiff_written_and_read():
    z = np.random.default_rng(1).random((70, 33)).astype(np.float32)
    z[5, 5] = np.nan
    t = (0.5, 0.0, 10.0, 0.0, -0.5, 20.0)
    h = geotiff.header(data := geotiff.encode(z, t, 4326, -9999.0))
    assert h.epsg == 4326 and h.transform == t and h.nodata == -9999.0
    assert np.array_equal(geotiff.window(data, h, 0, 0, 33, 70), z, equal_nan=True)
    with pytest.raises(geotiff.GeoTiffError):
        geotiff.header(b"not a raster")


def test_well_known_binary():
    pack = struct.pack
    line = pack("<BIi", 1, 2, 2) + pack("<4d", 0, 1, 2, 3)
    assert geopackage.wkb(line)[0] == {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}
    z = pack(">BI3d", 0, 1001, 4, 5, 6)
    assert geopackage.wkb(z)[0] == {"type": "Point", "coordinates": [4, 5]}
    both = pack("<BIi", 1, 7, 2) + line + z
    assert [g["type"] for g in geopackage.wkb(both)[0]["geometries"]] == ["LineString", "Point"]
    assert geopackage.geometry(None) is None and geopackage.geometry(b"GP\0\x11" + bytes(4)) is None


def test_class_arguments():
    assert classes.parse_override("river:12.5:4") == ("river", 12.5, 4.0)
    for bad in ("river:1", "river:a:2", "a:1:2:3"):
        with pytest.raises(ValueError):
            classes.parse_override(bad)
    assert classes.alias_of(" 船坞 ") == "dock" and classes.alias_of("water （通用水体）") == "water"
    assert classes.alias_of("水体") is None and classes.alias_of("lake(湖泊)") is None
