"""Map projections as column expressions: spherical Mercator, UTM (Krueger series), zones, windows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

R = 6378137.0
FLAT = 1 / 298.257223563
K0, FALSE_E, FALSE_N = 0.9996, 500000.0, 10000000.0
_n = FLAT / (2 - FLAT)
A = R / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
# Krueger's coefficients to the sixth order in n
ALPHA = [
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180 - 127 * _n**5 / 288 + 7891 * _n**6 / 37800,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440 + 281 * _n**5 / 630 - 1983433 * _n**6 / 1935360,
    61 * _n**3 / 240 - 103 * _n**4 / 140 + 15061 * _n**5 / 26880 + 167603 * _n**6 / 181440,
    49561 * _n**4 / 161280 - 179 * _n**5 / 168 + 6601661 * _n**6 / 7257600,
    34729 * _n**5 / 80640 - 3418889 * _n**6 / 1995840,
    212378941 * _n**6 / 319334400,
]


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.lit(R) * F.radians(lon), F.lit(R) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """32600 or 32700 + zone; null outside latitudes -80 to 84."""
    zone = F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6) + 1))
    return F.when(lat.between(-80, 84), (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int"))


def utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the zone of :func:`utm_epsg`."""
    epsg = utm_epsg(lon, lat)
    centre = (epsg % 100) * 6 - 183
    e = math.sqrt(FLAT * (2 - FLAT))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    d = F.radians(lon - centre)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(FALSE_E) + F.lit(K0 * A) * x, F.lit(K0 * A) * y + F.when(lat < 0, FALSE_N).otherwise(0.0)


BETA = [
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360 - 81 * _n**5 / 512 + 96199 * _n**6 / 604800,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440 + 46 * _n**5 / 105 - 1118711 * _n**6 / 3870720,
    17 * _n**3 / 480 - 37 * _n**4 / 840 - 209 * _n**5 / 4480 + 5569 * _n**6 / 90720,
    4397 * _n**4 / 161280 - 11 * _n**5 / 504 - 830251 * _n**6 / 7257600,
    4583 * _n**5 / 161280 - 108847 * _n**6 / 3991680,
    20648693 * _n**6 / 638668800,
]
E = math.sqrt(FLAT * (2 - FLAT))
GEOGRAPHIC, MERCATOR = 4326, 3857


class _Columns:
    """The functions that the projections need, on columns."""

    sin, cos, tan, atan, atan2, sinh, cosh, asinh, atanh, sqrt, exp, log = (getattr(F, n) for n in "sin cos tan atan atan2 sinh cosh asinh atanh sqrt exp log".split())

    @staticmethod
    def let(f, *values):
        """The struct or column ``f`` makes of the values, each of which is computed once however often it is used."""
        bound = F.struct(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])
        return F.transform(F.array(bound), lambda b: f(*[b[f"v{i}"] for i in range(len(values))]))[0]

    @staticmethod
    def pair(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    @staticmethod
    def split(p):
        return p["x"], p["y"]


class _Arrays:
    """The same on numpy arrays and numbers."""

    @staticmethod
    def let(f, *values):
        return f(*values)

    @staticmethod
    def pair(x, y):
        return x, y

    @staticmethod
    def split(p):
        return p

    def __getattr__(self, name: str):
        import numpy as np

        return getattr(np, {"atan": "arctan", "atan2": "arctan2", "asinh": "arcsinh", "atanh": "arctanh"}.get(name, name))


def is_geographic(epsg: int) -> bool:
    return epsg == GEOGRAPHIC


def _zone(epsg: int) -> tuple[float, float]:
    """(central meridian, false northing) of a UTM code."""
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"unsupported EPSG code: {epsg}")
    return epsg % 100 * 6.0 - 183.0, 0.0 if epsg // 100 == 326 else FALSE_N


def _forward(m, epsg: int, lon, lat):
    rad = math.pi / 180
    if epsg == GEOGRAPHIC:
        return lon, lat
    if epsg == MERCATOR:
        return lon * (rad * R), m.log(m.tan(lat * (rad / 2) + math.pi / 4)) * R
    centre, north = _zone(epsg)

    def conformal(s, d):
        t = m.sinh(m.atanh(s) - m.atanh(s * E) * E)
        return m.pair(m.atan2(t, m.cos(d)), m.atanh(m.sin(d) / m.sqrt(t * t + 1)))

    def series(xi, eta):
        x, y = eta, xi
        for j, a in enumerate(ALPHA, 1):
            x = x + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a
            y = y + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a
        return m.pair(x * (K0 * A) + FALSE_E, y * (K0 * A) + north)

    return m.split(m.let(series, *m.split(m.let(conformal, m.sin(lat * rad), (lon - centre) * rad))))


def _backward(m, epsg: int, x, y):
    deg = 180 / math.pi
    if epsg == GEOGRAPHIC:
        return x, y
    if epsg == MERCATOR:
        return x * (deg / R), (m.atan(m.exp(y / R)) * 2 - math.pi / 2) * deg
    centre, north = _zone(epsg)

    def series(xi, eta):
        p, q = xi, eta
        for j, b in enumerate(BETA, 1):
            p = p - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b
            q = q - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b
        return m.pair(p, q)

    def newton(conformal, tau):
        root = m.sqrt(tau * tau + 1)
        return m.let(lambda c, t, r, s: m.let(lambda c, t, r, now: t + (c - now) / m.sqrt(now * now + 1) * (t * t * (1 - E * E) + 1) / (r * (1 - E * E)), c, t, r, t * m.sqrt(s * s + 1) - s * r), conformal, tau, root, m.sinh(m.atanh(tau / root * E) * E))

    def geodetic(p, q):
        # tangent of the conformal latitude, then of the geodetic one by Newton's steps
        conformal = m.sin(p) / m.sqrt(m.sinh(q) * m.sinh(q) + m.cos(p) * m.cos(p))
        tau = conformal
        for _ in range(3):
            tau = m.let(newton, conformal, tau)
        return m.pair(m.atan2(m.sinh(q), m.cos(p)) * deg + centre, m.atan(tau) * deg)

    return m.split(m.let(geodetic, *m.split(m.let(series, (y - north) / (K0 * A), (x - FALSE_E) / (K0 * A)))))


def project(x, y, source: int, target: int):
    """Coordinates of numpy arrays or numbers from one code (4326, 3857, UTM) to another; equal codes copy."""
    if source == target:
        return x, y
    m = _Arrays()
    return _forward(m, target, *_backward(m, source, x, y))


def project_columns(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """:func:`project` of columns."""
    if source == target:
        return x, y
    whole = _Columns.let(lambda lon, lat: _Columns.pair(*_forward(_Columns, target, lon, lat)), *_backward(_Columns, source, x, y))
    return whole["x"], whole["y"]


def utm_of(lon: float, lat: float) -> int:
    """The UTM code of a place."""
    if not -80 <= lat <= 84:
        raise ValueError(f"no UTM zone at latitude {lat}")
    return (32600 if lat >= 0 else 32700) + min(60, max(1, math.floor((lon + 180) / 6) + 1))


def working_epsg(dem_epsg: int | None, bounds: tuple[float, float, float, float], bounds_epsg: int) -> int:
    """The terrain's own code where it is projected, else UTM at the centre of the bounds."""
    if dem_epsg is not None and not is_geographic(dem_epsg):
        return dem_epsg
    x0, y0, x1, y1 = densified_bounds(*bounds, bounds_epsg, GEOGRAPHIC)
    return utm_of((x0 + x1) / 2, (y0 + y1) / 2)


def edge_points(minx, miny, maxx, maxy, intervals: int) -> list[tuple[float, float]]:
    """Points along the four edges, ``intervals`` spans each."""
    t = [k / intervals for k in range(intervals + 1)]
    across, up = [minx + (maxx - minx) * k for k in t], [miny + (maxy - miny) * k for k in t]
    return [(x, y) for x in across for y in (miny, maxy)] + [(x, y) for y in up for x in (minx, maxx)]


def densified_bounds(minx, miny, maxx, maxy, source: int, target: int, intervals: int = 22) -> tuple[float, float, float, float]:
    """Box around the projected edges of a box; 21 inner points on each edge."""
    if source == target:
        return minx, miny, maxx, maxy
    p = [project(x, y, source, target) for x, y in edge_points(minx, miny, maxx, maxy, intervals)]
    return min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p)


def densified_bounds_columns(minx: Column, miny: Column, maxx: Column, maxy: Column, source: int, target: int, intervals: int = 22) -> Column:
    """struct(minx, miny, maxx, maxy) of :func:`densified_bounds`."""
    t = [k / intervals for k in range(intervals + 1)]
    points = [(minx + (maxx - minx) * k, y) for k in t for y in (miny, maxy)] + [(x, miny + (maxy - miny) * k) for k in t for x in (minx, maxx)]
    p = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])

    def xy(q):
        x, y = project_columns(q["x"], q["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(F.array(F.transform(p, xy)), lambda q: F.struct(F.array_min(F.transform(q, lambda z: z["x"])).alias("minx"), F.array_min(F.transform(q, lambda z: z["y"])).alias("miny"), F.array_max(F.transform(q, lambda z: z["x"])).alias("maxx"), F.array_max(F.transform(q, lambda z: z["y"])).alias("maxy")))[0]


def area_of_interest(minx, miny, maxx, maxy, source: int, target: int) -> tuple[float, float, float, float]:
    """A box in a layer's own code: 16 spans an edge, widened by 1 % of its sides."""
    x0, y0, x1, y1 = densified_bounds(minx, miny, maxx, maxy, source, target, 16)
    dx, dy = (x1 - x0) * 0.01, (y1 - y0) * 0.01
    return x0 - dx, y0 - dy, x1 + dx, y1 + dy


def warp_grid(source: int, target: int, transform: tuple[float, ...], width: int, height: int) -> tuple[tuple[float, ...], int, int]:
    """(transform, width, height) of the grid that a raster is reprojected to.

    Pixels are square, their side the projected diagonal over the diagonal in pixels;
    the extent is that of 21 samples along each edge.
    """
    a, b, c, d, e, f = transform
    at = lambda col, row: project(a * col + b * row + c, d * col + e * row + f, source, target)
    (x0, y0), (x1, y1) = at(0, 0), at(width, height)
    side = math.hypot(x1 - x0, y1 - y0) / math.hypot(width, height)
    p = [at(x, y) for x, y in edge_points(0, 0, width, height, 20)]
    left, right, low, top = min(q[0] for q in p), max(q[0] for q in p), min(q[1] for q in p), max(q[1] for q in p)
    return (side, 0.0, left, 0.0, -side, top), math.floor((right - left) / side + 0.5), math.floor((top - low) / side + 0.5)


def window_transform(transform: tuple[float, ...], col0: int, row0: int) -> tuple[float, ...]:
    """Transform of a window of a north-up raster."""
    a, _, c, _, e, f = transform
    return a, 0.0, c + col0 * a, 0.0, e, f + row0 * e


def roi_window(minx, miny, maxx, maxy, transform: tuple[float, ...], width: int, height: int, pad_share: float = 0.05, pad_least: int = 64) -> tuple[int, int, int, int]:
    """(col0, row0, w, h) that covers a box, padded and clamped; an error where it misses the raster."""
    a, _, c, _, e, f = transform
    x0, x1 = sorted(((minx - c) / a, (maxx - c) / a))
    y0, y1 = sorted(((miny - f) / e, (maxy - f) / e))
    c0, c1, r0, r1 = math.floor(x0), math.ceil(x1), math.floor(y0), math.ceil(y1)
    pad = max(pad_least, int(pad_share * max(c1 - c0, r1 - r0)))
    c0, r0, c1, r1 = max(0, c0 - pad), max(0, r0 - pad), min(width, c1 + pad), min(height, r1 + pad)
    if c1 <= c0 or r1 <= r0:
        raise ValueError("the box lies outside the raster")
    return c0, r0, c1 - c0, r1 - r0


def roi_window_columns(minx: Column, miny: Column, maxx: Column, maxy: Column, transform: tuple[float, ...], width: int, height: int, pad_share: float = 0.05, pad_least: int = 64) -> Column:
    """struct(col0, row0, w, h) of :func:`roi_window`; null where the box misses the raster."""
    a, _, c, _, e, f = transform
    xs, ys = ((minx - c) / a, (maxx - c) / a), ((miny - f) / e, (maxy - f) / e)
    c0, c1, r0, r1 = F.floor(F.least(*xs)), F.ceil(F.greatest(*xs)), F.floor(F.least(*ys)), F.ceil(F.greatest(*ys))
    pad = F.greatest(F.lit(pad_least).cast("long"), F.floor(F.lit(pad_share) * F.greatest(c1 - c0, r1 - r0)))
    lo = [F.greatest(F.lit(0).cast("long"), x - pad) for x in (c0, r0)]
    hi = [F.least(F.lit(n).cast("long"), x + pad) for x, n in ((c1, width), (r1, height))]
    return F.when((hi[0] > lo[0]) & (hi[1] > lo[1]), F.struct(lo[0].cast("int").alias("col0"), lo[1].cast("int").alias("row0"), (hi[0] - lo[0]).cast("int").alias("w"), (hi[1] - lo[1]).cast("int").alias("h")))


def warp_grid_columns(source: int, target: int, a: Column, c: Column, e: Column, f: Column, width: Column, height: Column) -> Column:
    """struct(px, left, top, width, height) of :func:`warp_grid` for north-up rasters."""
    t = [k / 20 for k in range(21)]
    places = [(width * k, y) for k in t for y in (F.lit(0.0), height * 1.0)] + [(x, height * k) for k in t for x in (F.lit(0.0), width * 1.0)]
    at = lambda col, row: project_columns(a * col + c, e * row + f, source, target)
    (x0, y0), (x1, y1) = at(F.lit(0.0), F.lit(0.0)), at(width, height)
    side = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / F.sqrt(width * width + height * height)
    p = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in places])

    def xy(q):
        x, y = at(q["x"], q["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    box = F.transform(F.array(F.transform(p, xy)), lambda q: F.struct(F.array_min(F.transform(q, lambda z: z["x"])).alias("l"), F.array_max(F.transform(q, lambda z: z["x"])).alias("r"), F.array_min(F.transform(q, lambda z: z["y"])).alias("b"), F.array_max(F.transform(q, lambda z: z["y"])).alias("t")))
    out = F.transform(box, lambda q: F.struct(side.alias("px"), q["l"].alias("left"), q["t"].alias("top"), F.floor((q["r"] - q["l"]) / side + 0.5).cast("int").alias("width"), F.floor((q["t"] - q["b"]) / side + 0.5).cast("int").alias("height")))
    return out[0]
