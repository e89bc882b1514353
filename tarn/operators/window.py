"""A whole raster window at a time, in numpy: polygon masks, warping, lakes, rivers, lift, skirt, composition.

These are the blocks of the tiled job (:mod:`tarn.jobs`): a task holds one padded
tile and the polygons that meet it. Rings are lists of (n, 2) arrays; transforms
are (a, b, c, d, e, f) of north-up rasters.
"""

from __future__ import annotations

import math

import numpy as np

from ..functions import crs
from . import kernels

NODATA = -9999.0
NEAR, LEAST_STEP = 0.01, 1e-9  # of the walk along an edge: closeness to a grid line, smallest move
MAX_ERROR = 0.125  # pixels, of the approximate transformer
ROUNDS, SAME = 5, 1e-6


def pixel_rings(rings, transform) -> list[np.ndarray]:
    """Rings in pixel coordinates (column, row)."""
    a, _, c, _, e, f = transform
    return [np.column_stack(((np.asarray(r, float)[:, 0] - c) / a, (np.asarray(r, float)[:, 1] - f) / e)) for r in rings]


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """(n, 4) of x0, y0, x1, y1."""
    return np.concatenate([np.column_stack((r[:-1], r[1:])) for r in rings if len(r) > 1] or [np.zeros((0, 4))])


def centre_mask(rings: list[np.ndarray], h: int, w: int) -> np.ndarray:
    """Cells whose centre lies inside by the even-odd rule."""
    out = np.zeros((h, w), bool)
    e = _edges(rings)
    e = e[e[:, 1] != e[:, 3]]
    if not len(e):
        return out
    lo = np.maximum(0, np.ceil(np.minimum(e[:, 1], e[:, 3]) - 0.5)).astype(int)
    hi = np.minimum(h - 1, np.ceil(np.maximum(e[:, 1], e[:, 3]) - 0.5) - 1).astype(int)
    n = np.maximum(0, hi - lo + 1)
    i = np.repeat(np.arange(len(e)), n)
    r = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[i]
    x = e[i, 0] + (r + 0.5 - e[i, 1]) * (e[i, 2] - e[i, 0]) / (e[i, 3] - e[i, 1])
    by = np.lexsort((x, r))
    r, x = r[by], x[by]
    # crossings of a row pair up in order: flips at both ends of each pair
    at = np.clip(np.floor(x - 1e-12 + 0.5), 0, w).astype(int)
    flips = np.zeros((h, w + 1), np.int64)
    first = np.searchsorted(r, r)
    sign = np.where((np.arange(len(r)) - first) % 2 == 0, 1, -1)
    np.add.at(flips, (r, at), sign)
    return np.cumsum(flips, axis=1)[:, :w] > 0


def walk(x0: float, y0: float, x1: float, y1: float, h: int, w: int) -> list[tuple[int, int]]:
    """(row, column) of the cells that an edge touches, edges that run along grid lines aside."""
    if x0 > x1:
        x0, y0, x1, y1 = x1, y1, x0, y0
    along = lambda p, q: abs(p - round(p)) < NEAR and abs(q - round(q)) < NEAR
    cells = []
    if math.floor(x0) == math.floor(x1) or abs(x1 - x0) < NEAR:
        if not along(x0, x1):
            lo, hi = min(y0, y1), max(y0, y1)
            cells = [(r, math.floor(x1)) for r in range(math.floor(lo), math.floor(hi - NEAR) + 1)]
    elif math.floor(y0) == math.floor(y1) or abs(y1 - y0) < NEAR:
        if not along(y0, y1):
            cells = [(math.floor(y0), c) for c in range(math.floor(x0), math.floor(x1 - NEAR) + 1)]
    else:
        slope = (y1 - y0) / (x1 - x0)
        x, y = x0, y0
        if x < 0:
            x, y = 0.0, y - x * slope
        end = min(x1, float(w))
        while x < end:
            r, c = math.floor(y), math.floor(x)
            cells.append((r, c))
            step = math.floor(x + 1) - x
            if math.floor(y + step * slope) == r:
                x, y = x + step, y + step * slope
            else:
                rise = min(r - y, -LEAST_STEP) if slope < 0 else max(r + 1 - y, LEAST_STEP)
                x, y = x + rise / slope, y + rise
    return [(r, c) for r, c in cells if 0 <= r < h and 0 <= c < w]


def mask(rings: list[np.ndarray], h: int, w: int, all_touched: bool) -> np.ndarray:
    """Cells of a polygon in pixel coordinates, by the centre rule or with all that its edges touch."""
    out = centre_mask(rings, h, w)
    if all_touched:
        for x0, y0, x1, y1 in _edges(rings):
            for r, c in walk(x0, y0, x1, y1, h, w):
                out[r, c] = True
    return out


def window_of(rings: list[np.ndarray], h: int, w: int, pad: int) -> tuple[int, int, int, int] | None:
    """(row0, col0, rows, columns) of a polygon's padded window within the raster, None outside it."""
    p = np.concatenate(rings)
    c0, r0 = max(0, math.floor(p[:, 0].min()) - pad), max(0, math.floor(p[:, 1].min()) - pad)
    c1, r1 = min(w, math.ceil(p[:, 0].max()) + pad), min(h, math.ceil(p[:, 1].max()) + pad)
    return (r0, c0, r1 - r0, c1 - c0) if r1 > r0 and c1 > c0 else None


def _points(rows: np.ndarray, width: int, target_t, target: int, source: int, source_t, max_error: float) -> tuple[np.ndarray, np.ndarray]:
    """Source pixel coordinates of the centres of target rows; with ``max_error`` by pieces that are straight to that many pixels."""
    a, _, c, _, e, f = target_t
    sa, _, sc, _, se, sf = source_t

    def exact(col, row):
        x, y = crs.project(a * col + c, e * row + f, target, source)
        return (x - sc) / sa, (y - sf) / se

    col = np.arange(width) + 0.5
    if max_error <= 0 or width <= 5 or source == target:
        x, y = exact(np.broadcast_to(col, (len(rows), width)), np.broadcast_to(rows[:, None] + 0.5, (len(rows), width)))
        return np.array(x, float), np.array(y, float)
    x, y = np.empty((len(rows), width)), np.empty((len(rows), width))
    # pieces (row, from, to) of all rows, halved together until their middle is close enough
    todo = np.column_stack((np.arange(len(rows)), np.zeros(len(rows), int), np.full(len(rows), width)))
    while len(todo):
        i, lo, hi = todo.T
        short = hi - lo <= 5
        for r, p, q in todo[short]:
            x[r, p:q], y[r, p:q] = exact(col[p:q], np.full(q - p, rows[r] + 0.5))
        i, lo, hi = todo[~short].T
        if not len(i):
            break
        mid = lo + (hi - lo - 1) // 2
        (xs, ys), (xm, ym), (xe, ye) = (exact(col[k], rows[i] + 0.5) for k in (lo, mid, hi - 1))
        run = col[hi - 1] - col[lo]
        dx, dy = (xe - xs) / run, (ye - ys) / run
        error = np.abs(xs + dx * (col[mid] - col[lo]) - xm) + np.abs(ys + dy * (col[mid] - col[lo]) - ym)
        fine = error <= max_error
        for r, p, q, x_, y_, dx_, dy_ in zip(i[fine], lo[fine], hi[fine], xs[fine], ys[fine], dx[fine], dy[fine]):
            t = col[p:q] - col[p]
            x[r, p:q], y[r, p:q] = x_ + dx_ * t, y_ + dy_ * t
        i, lo, mid, hi = i[~fine], lo[~fine], mid[~fine], hi[~fine]
        todo = np.concatenate((np.column_stack((i, lo, mid)), np.column_stack((i, mid, hi))))
    return x, y


def reproject(data: np.ndarray, source_t, source: int, target_t, width: int, height: int, target: int, method: str = "bilinear", max_error: float = 0.0, band: int = 256) -> np.ndarray:
    """``data`` (NaN: no value) on another grid. Bilinear weights go to the neighbours that have a value; no value where none has or outside."""
    h, w = data.shape
    out = np.full((height, width), np.nan)
    for a in range(0, height, band):
        rows = np.arange(a, min(height, a + band))
        x, y = _points(rows, width, target_t, target, source, source_t, max_error)
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        if method == "nearest":
            r, c = np.where(inside, np.floor(y), 0).astype(int), np.where(inside, np.floor(x), 0).astype(int)
            out[rows] = np.where(inside, data[r, c], np.nan)
            continue
        fx, fy = np.where(inside, x - 0.5, 0.0), np.where(inside, y - 0.5, 0.0)
        c0, r0 = np.floor(fx).astype(int), np.floor(fy).astype(int)
        total, weight = np.zeros(x.shape), np.zeros(x.shape)
        for dr in (0, 1):
            for dc in (0, 1):
                r, c = r0 + dr, c0 + dc
                k = (1 - np.abs(fy - r)) * (1 - np.abs(fx - c))
                ok = inside & (r >= 0) & (r < h) & (c >= 0) & (c < w)
                v = data[np.where(ok, r, 0), np.where(ok, c, 0)]
                ok &= np.isfinite(v)
                total += np.where(ok, k * np.where(ok, v, 0.0), 0.0)
                weight += np.where(ok, k, 0.0)
        out[rows] = np.where(weight >= 1e-5, total / np.where(weight > 0, weight, 1.0), np.nan)
    return out


def lake_level(inside: np.ndarray, dem: np.ndarray) -> float:
    """Trimmed median of the shore ring, else the interior median, else NaN."""
    for cells in (inside & ~kernels.erode(inside), inside):
        v = dem[cells]
        v = v[np.isfinite(v)]
        if not len(v):
            continue
        z = float(np.median(v))
        for _ in range(ROUNDS if cells is not inside else 0):
            z, last = float(np.median(v[v <= z])), z
            if abs(z - last) < SAME:
                break
        return z
    return math.nan


def skirt(surface: np.ndarray, water: np.ndarray, dem: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(surface, water) widened by a flat band of n and a ramp of n more; float32 as stored."""
    seeds = water & np.isfinite(surface)
    if n == 0 or not seeds.any():
        return surface, water
    flat, wide = kernels.dilate(water, n), kernels.dilate(water, 2 * n)
    distance, row, col = kernels.nearest_clear(~seeds, 2 * n)
    level = surface[row, col]
    t = np.clip(distance.astype(np.float32) - np.float32(n), 0, np.float32(n)) / np.float32(n + 1)
    ground = dem.astype(np.float32)
    blend = np.where(np.isfinite(ground), np.maximum(level * (np.float32(1) - t) + ground * t, level), level)
    out = np.where(flat & ~water, level, np.where(wide & ~flat, blend, surface))
    return out.astype(np.float32), wide


def water_surface(transform, dem: np.ndarray, polygons: list, still: list[bool], all_touched: bool = True, skirt_pixels: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(surface float32, NaN off the water; water): rivers, lakes over them, later polygons over earlier ones, the bed lifted, a skirt."""
    h, w = dem.shape
    surface = np.full((h, w), np.nan, np.float32)
    river, lake = np.zeros((h, w), bool), np.zeros((h, w), bool)
    pixel = abs(transform[0])
    for kind in (False, True):
        for rings, is_still in zip(polygons, still):
            if is_still != kind:
                continue
            p = pixel_rings(rings, transform)
            at = window_of(p, h, w, 2)
            if at is None:
                continue
            r0, c0, rows, cols = at
            own = [q - np.array([c0, r0]) for q in p]
            part = mask(own, rows, cols, all_touched)
            here = (slice(r0, r0 + rows), slice(c0, c0 + cols))
            if kind:
                z = lake_level(centre_mask(own, rows, cols), dem[here])
                lake[here] |= part
                if math.isfinite(z):
                    surface[here][part] = np.float32(z)
            else:
                river[here] |= part
                if part.any():
                    z = kernels.river_surface(part, dem[here], pixel)
                    surface[here][np.isfinite(z)] = z[np.isfinite(z)]
    write = np.isfinite(surface)
    ground = dem.astype(np.float32)
    over = river & (ground > surface)
    lift = write & (surface < ground) & ~lake & ~over
    surface = np.where(lift, ground, surface)
    return skirt(surface, write, ground, skirt_pixels)


def process(dem: np.ndarray, transform, epsg: int, target: int, polygons: list, still: list[bool], all_touched: bool = True, with_dem: bool = True, skirt_pixels: int = 5, max_error: float = MAX_ERROR) -> np.ndarray:
    """The composed surface of a window: terrain to the working grid, water there, water and its mask back, exact terrain elsewhere.

    ``polygons`` are in the working code ``target``.
    """
    h, w = dem.shape
    work_t, work_w, work_h = crs.warp_grid(epsg, target, transform, w, h)
    same = epsg == target and (work_w, work_h) == (w, h) and np.allclose(work_t, transform, rtol=1e-12, atol=1e-9)
    ground = dem.astype(float) if same else reproject(dem.astype(float), transform, epsg, work_t, work_w, work_h, target, "bilinear", max_error).astype(np.float32).astype(float)
    surface, water = water_surface(work_t, ground, polygons, still, all_touched, skirt_pixels)
    surface = np.where(water, surface, np.nan)
    if not same:
        water = reproject(water.astype(float), work_t, target, transform, w, h, epsg, "nearest", max_error) >= 0.5
        surface = reproject(surface.astype(float), work_t, target, transform, w, h, epsg, "bilinear", max_error)
    rest = np.where(np.isfinite(dem) & with_dem, dem, NODATA)
    return np.where(water & np.isfinite(surface), surface, rest).astype(np.float32)
