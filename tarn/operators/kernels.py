"""Numpy kernels for what is sequential: medial axis, skeleton order, profile fits, cross-sections, harmonic fill.

Pure functions of arrays; grouped-map wrappers are in ``rivers``. NaN is a gap.
"""

from __future__ import annotations

from collections import deque

import numpy as np

NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def pava(y: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit."""
    means: list[float] = []
    sizes: list[int] = []
    for v in y:
        m, n = float(v), 1
        while means and means[-1] > m:
            k = sizes.pop()
            m = (means.pop() * k + m * n) / (n + k)
            n += k
        means.append(m)
        sizes.append(n)
    return np.repeat(means, sizes)


def monotone(v: np.ndarray, up: bool) -> np.ndarray:
    out = v.copy()
    ok = np.isfinite(v)
    if ok.sum() > 1:
        out[ok] = pava(v[ok]) if up else -pava(-v[ok])
    return out


def _select3(w: list[float]) -> float:
    """The middle of three by Hoare's quickselect around the first element.

    Comparisons with a gap are false, so where the gap stands decides what is returned.
    """
    w, lo, hi, k = list(w), 0, len(w) - 1, 1
    while lo < hi:
        pivot = w[lo]
        i, j = lo, hi
        while True:
            while w[j] > pivot:
                j -= 1
            while w[i] < pivot:
                i += 1
            if i >= j:
                break
            w[i], w[j] = w[j], w[i]
            i, j = i + 1, j - 1
        lo, hi = (lo, j) if k <= j else (j + 1, hi)
    return w[k]


def median3(v: np.ndarray) -> np.ndarray:
    p = np.concatenate((v[:1], v, v[-1:]))
    if np.isfinite(v).all():
        return np.median(np.stack([p[:-2], p[1:-1], p[2:]]), 0)
    return np.array([_select3(list(p[i : i + 3])) for i in range(len(v))])


def peaks(x: np.ndarray, least: float) -> list[int]:
    """Interior maxima (plateaus: floor of the middle) with prominence of ``least`` or more."""
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                p = (i + j) // 2
                base = []
                for step in (-1, 1):
                    q, low = p, x[p]
                    while 0 <= q < n and not x[q] > x[p]:
                        if x[q] < low:
                            low = x[q]
                        q += step
                    base.append(low)
                if x[p] - max(base) >= least:
                    out.append(p)
            i = j
        i += 1
    return out


def _lowest_before(x: np.ndarray) -> np.ndarray:
    """For each sample, the least one between the last higher sample before it (or the start) and itself."""
    low = x.copy()
    open_: list[int] = []  # samples that nothing since has reached
    for i in range(len(x)):
        while open_ and x[open_[-1]] <= x[i]:
            low[i] = min(low[i], low[open_.pop()])
        open_.append(i)
    return low


def prominences(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, prominence) of the interior maxima; first and last index bound a plateau."""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, int)
    end = np.r_[start[1:], len(x)][: len(start)] - 1
    run = x[start]
    k = 1 + np.flatnonzero((run[1:-1] > run[:-2]) & (run[1:-1] > run[2:])) if len(run) > 2 else np.empty(0, int)
    left, right = _lowest_before(x), _lowest_before(x[::-1])[::-1]
    return start[k], end[k], x[start[k]] - np.maximum(left[end[k]], right[start[k]])


def multi_peak(z: np.ndarray, least: float = 5.0, share: float = 0.05) -> np.ndarray:
    """Monotone pieces between the ends and the prominent peaks of the smoothed series."""
    ok = np.isfinite(z)
    if len(z) < 3 or ok.sum() < 3:
        return z.copy()
    found = peaks(median3(z), max(least, share * float(np.ptp(z[ok]))))
    if not found:
        return z.copy()
    anchors = sorted({0, len(z) - 1, *found})
    out = z.copy()
    top = set(found)
    for a, b in zip(anchors, anchors[1:]):
        if b - a + 1 < 3:
            continue
        seg = z[a : b + 1]
        if a in top and b in top:
            fin = np.isfinite(seg)
            if not fin.any():
                continue
            m = int(np.nanargmin(np.where(fin, seg, np.inf)))
            left, right = monotone(seg[: m + 1], False), monotone(seg[m:], True)
            out[a : b + 1] = np.concatenate((left[:-1], right))
        else:
            out[a : b + 1] = monotone(seg, b in top)
    return out


def nearest_clear(mask: np.ndarray, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, row, column) of the nearest unset cell of each cell, ties by row, then column; inf and -1 where all are set.
    With ``reach`` only cells that have one within that distance are answered rightly.

    Each column's nearest unset row by running extremes, then columns at growing offsets,
    as long as a closer one is possible.
    """
    h, w = mask.shape
    r = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, -1, r), axis=0)
    below = np.minimum.accumulate(np.where(mask, 2 * h + w, r)[::-1], axis=0)[::-1]
    up = (above >= 0) & ((r - above <= below - r) | (below >= h))
    row = np.where(up, above, below)
    some = row < h
    far = np.int64(1) << 32
    # one number for (squared distance, row, column): its least is the answer
    own = np.where(some, ((r - row) ** 2) * (h * w), far * (h * w)) + np.where(some, row, 0) * w
    best = own + np.arange(w)
    if not some.any():
        return np.full(mask.shape, np.inf), np.full(mask.shape, -1), np.full(mask.shape, -1)
    k = 1
    while k < w and k <= (w if reach is None else reach) and k * k * (h * w) <= best.max():
        step = np.int64(k * k) * (h * w)
        np.minimum(best[:, k:], own[:, :-k] + np.arange(w - k) + step, out=best[:, k:])
        np.minimum(best[:, :-k], own[:, k:] + np.arange(k, w) + step, out=best[:, :-k])
        k += 1
    return np.sqrt((best // (h * w)).astype(float)), best % (h * w) // w, best % w


def edt(mask: np.ndarray) -> np.ndarray:
    """Distance of set cells to the nearest unset one; inf where there is none."""
    return nearest_clear(mask)[0]


def dilate(mask: np.ndarray, n: int) -> np.ndarray:
    """Cross dilation, n times: the L1 ball."""
    for _ in range(n):
        p = np.pad(mask, 1)
        mask = mask | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return mask


def erode(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    return mask & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]


def _parts(bits: int) -> int:
    """8-connected components of a 3 x 3 pattern."""
    left = {i for i in range(9) if bits >> i & 1}
    n = 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            q = todo.pop()
            near = {k for k in left if abs(k // 3 - q // 3) <= 1 and abs(k % 3 - q % 3) <= 1}
            left -= near
            todo += near
    return n


_KEEP = np.array([bool(b >> 4 & 1) and (_parts(b) != _parts(b & ~16) or bin(b).count("1") < 3) for b in range(512)])


def medial_axis(mask: np.ndarray, tiebreak: np.ndarray | None = None) -> np.ndarray:
    """Skeleton: cells in order of (distance, openness, tiebreak) go unless the neighbourhood table keeps them."""
    h, w = mask.shape
    pad = np.pad(mask.astype(np.uint8), 1)
    hood = sum(pad[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w].astype(np.int64) << ((dr + 1) * 3 + dc + 1) for dr in (-1, 0, 1) for dc in (-1, 0, 1))
    r, c = np.nonzero(mask)
    if not len(r):
        return mask.copy()
    count = np.array([bin(x).count("1") for x in range(512)])[hood[r, c]]
    tie = np.arange(len(r)) if tiebreak is None else np.asarray(tiebreak)
    d = edt(mask)[r, c]
    wide = w + 2
    flat = bytearray(pad.tobytes())
    offsets = [dr * wide + dc for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    cells = ((r + 1) * wide + c + 1)[np.lexsort((tie, 9 - count, d))]
    keep = _KEEP.tolist()
    for p in cells.tolist():
        b = 0
        for k, o in enumerate(offsets):
            if flat[p + o]:
                b |= 1 << k
        if not keep[b]:
            flat[p] = 0
    return np.frombuffer(bytes(flat), np.uint8).reshape(h + 2, wide)[1:-1, 1:-1].astype(bool)


def order_skeleton(skel: np.ndarray, dem: np.ndarray) -> list[tuple[int, int]]:
    """Skeleton cells from the outlet (the lowest end) upstream, branch by branch."""
    cells = {(int(r), int(c)) for r, c in zip(*np.nonzero(skel))}
    if not cells:
        return []
    near = {p: [(p[0] + dr, p[1] + dc) for dr, dc in NEIGHBOURS if (p[0] + dr, p[1] + dc) in cells] for p in sorted(cells)}
    nodes = [p for p in near if len(near[p]) != 2]
    if not nodes:
        return sorted(near, key=lambda p: (dem[p], p))
    index = {p: i for i, p in enumerate(nodes)}
    branches: list[tuple[int, int, list]] = []
    visited: set = set()
    for node in nodes:
        for first in near[node]:
            if first in visited:
                continue
            path, prev, cur = [node, first], node, first
            visited.add(first)
            while cur not in index:
                prev, cur = cur, next(q for q in near[cur] if q != prev)  # degree 2
                path.append(cur)
                visited.add(cur)  # an end node too: no other branch starts into it
            if path[-1] in index:
                branches.append((index[node], index[path[-1]], path))
    ends = [p for p in nodes if len(near[p]) == 1] or nodes
    outlet = min(ends, key=lambda p: (dem[p] if np.isfinite(dem[p]) else np.inf, index[p]))
    links: dict[int, set[int]] = {i: set() for i in range(len(nodes))}
    for a, b, _ in branches:
        links[a].add(b)
        links[b].add(a)
    hops = {index[outlet]: 0}
    queue = deque(hops)
    while queue:
        a = queue.popleft()
        for b in sorted(links[a]):
            if b not in hops:
                hops[b] = hops[a] + 1
                queue.append(b)
    far = 999_999
    turned = []
    for a, b, path in branches:
        ha, hb = hops.get(a, far), hops.get(b, far)
        turned.append((min(ha, hb), path if ha <= hb else path[::-1]))
    out, seen = [], set()
    for _, path in sorted(turned, key=lambda t: t[0]):
        for p in path:
            if p not in seen:
                seen.add(p)
                out.append(p)
    return out + [p for p in near if p not in seen]


def tangents(stations: np.ndarray, context: int = 3) -> np.ndarray:
    """Unit directions over up to ``context`` stations each way, not across jumps (squared step over 2)."""
    n = len(stations)
    jump = np.concatenate(([False], ((np.diff(stations, axis=0) ** 2).sum(1) > 2))) if n else np.zeros(0, bool)
    run = np.cumsum(jump)
    i = np.arange(n)
    a, b = np.maximum(i - context, np.searchsorted(run, run)), np.minimum(i + context, np.searchsorted(run, run, side="right") - 1)
    d = (stations[b] - stations[a]).astype(float) if n else np.zeros((0, 2))
    norm = np.hypot(d[:, 0], d[:, 1])
    return np.where(norm[:, None] > 0, d / np.where(norm > 0, norm, 1)[:, None], np.array([0.0, 1.0]))


def junctions(stations: np.ndarray, tangent: np.ndarray, radius: float = 4.0, cosine: float = 0.5) -> np.ndarray:
    """Stations with another one in reach whose direction differs. Stations are filed by cells of the radius: only neighbours meet."""
    out = np.zeros(len(stations), bool)
    if not len(stations):
        return out
    cell = np.floor(stations / radius).astype(np.int64)
    cell -= cell.min(0) - 1
    wide = cell[:, 1].max() + 3
    key = cell[:, 0] * wide + cell[:, 1]
    by = np.argsort(key, kind="stable")
    filed = key[by]
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            a, b = (np.searchsorted(filed, key + dr * wide + dc, side=s) for s in ("left", "right"))
            i = np.repeat(np.arange(len(key)), b - a)
            j = by[np.arange(len(i)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[i]]
            d2 = ((stations[i] - stations[j]) ** 2).sum(1)
            hit = (d2 <= radius * radius) & (d2 > 0) & (np.abs((tangent[i] * tangent[j]).sum(1)) < cosine)
            out[i[hit]] = True
    return out


def cross_sections(stations, tangent, half_width, bank, dem, most: int = 500) -> np.ndarray:
    """Level of each station: the lower of the bank heights that a ray each way along the normal meets, else the terrain."""
    h, w = bank.shape
    out = np.empty(len(stations))
    for i, ((r, c), (tr, tc)) in enumerate(zip(stations, tangent)):
        own = dem[r, c]
        found = []
        if half_width[i] > 1:
            reach = int(min(most, max(2, np.ceil(1.5 * half_width[i]))))
            for sr, sc in ((-tc, tr), (tc, -tr)):
                for step in range(1, reach + 1):
                    y, x = int(np.rint(r + sr * step)), int(np.rint(c + sc * step))
                    if not (0 <= y < h and 0 <= x < w):
                        break
                    if bank[y, x]:
                        if np.isfinite(dem[y, x]):
                            found.append(dem[y, x])
                        break
        out[i] = min(found) if found else own
    return out


def ray_to_contour(dem: np.ndarray, r: float, c: float, dr: float, dc: float, level: float, above: float = 0.0, most: int = 500, step: float = 0.5) -> tuple[int, int, float] | None:
    """(row, column, height) of the first cell of a ray that stands over ``level`` + ``above``; cells without a value are passed, the edge ends it."""
    h, w = dem.shape
    for k in range(1, int(most / step) + 1):
        y, x = int(np.rint(r + dr * k * step)), int(np.rint(c + dc * k * step))
        if not (0 <= y < h and 0 <= x < w):
            return None
        if np.isfinite(dem[y, x]) and dem[y, x] > level + above:
            return y, x, float(dem[y, x])
    return None


def gaussian_f32(data: np.ndarray, sigma: float) -> np.ndarray:
    """Separable smoothing, reflected, with float32 rounding after each axis."""
    if sigma <= 0:
        return data.astype(float)
    n = int(4 * sigma + 0.5)
    k = np.arange(-n, n + 1)
    kern = np.exp(-0.5 * (k / sigma) ** 2)
    kern /= kern.sum()
    x = data.astype(np.float32)
    for axis in (0, 1):
        size = x.shape[axis]
        x = sum(kern[i] * np.take(x, reflect(np.arange(size) + k[i], size), axis).astype(float) for i in range(len(k))).astype(np.float32)
    return x.astype(float)


def _fill(v: np.ndarray) -> np.ndarray:
    for _ in range(2):
        ok = np.isfinite(v)
        at = np.maximum.accumulate(np.where(ok, np.arange(len(v)), -1))
        v = np.where(at >= 0, v[np.maximum(at, 0)], v)[::-1]
    return v


def reflect(i: np.ndarray, n: int) -> np.ndarray:
    m = np.mod(i, 2 * n)
    return np.where(m >= n, 2 * n - 1 - m, m)


def smooth_levels(stations: np.ndarray, z: np.ndarray, half_width: np.ndarray, shape: tuple[int, int], sigma: float = 3.0) -> np.ndarray:
    """Lowered to the 30th percentile of a window, then to a mask-aware Gaussian; both evaluated at stations only."""
    h, w = shape
    field = np.full(shape, np.inf)
    field[stations[:, 0], stations[:, 1]] = np.where(np.isfinite(z), z, np.inf)
    n = int(max(2, np.rint(np.median(half_width))))  # half widths are 2 at least
    k = np.arange(-n, n + 1)
    rank = int((2 * n + 1) ** 2 * 30 / 100)
    out = z.copy()
    for i, (r, c) in enumerate(stations):
        win = field[np.ix_(reflect(r + k, h), reflect(c + k, w))].ravel()
        p = np.partition(win, rank)[rank]
        if p < out[i]:
            out[i] = p
    g = int(4 * sigma + 0.5)
    k = np.arange(-g, g + 1)
    kern = np.exp(-0.5 * (k / sigma) ** 2)
    kern /= kern.sum()
    value, weight = np.zeros(shape), np.zeros(shape)
    ok = np.isfinite(out)
    value[stations[ok, 0], stations[ok, 1]] = out[ok]
    weight[stations[ok, 0], stations[ok, 1]] = 1.0
    low = out.copy()
    for i, (r, c) in enumerate(stations):
        at = np.ix_(reflect(r + k, h), reflect(c + k, w))
        den = float(np.float32((kern @ weight[at]).astype(np.float32).astype(float) @ kern))
        if den > 1e-3:
            s = (kern @ value[at] @ kern) / den
            if s < low[i]:
                low[i] = s
    return low


def harmonic(mask: np.ndarray, pin: np.ndarray, value: np.ndarray, tolerance: float = 1e-11, most: int = 20_000) -> np.ndarray:
    """Solve the 5-point Laplace equation on ``mask`` with pinned cells; no flux over the mask's edge.

    Matrix-free conjugate gradients with a diagonal preconditioner, started from the mean of
    the pins. Cells that no pin reaches are NaN.
    """
    domain = mask | pin
    reached, front = pin.copy(), pin.copy()
    while front.any():
        p = np.pad(front, 1)
        front = (p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]) & mask & ~reached
        reached |= front
    free = mask & ~pin & reached
    out = np.full(mask.shape, np.nan)
    out[pin] = value[pin]
    if not free.any():
        return out

    def around(x):
        p = np.pad(x, 1)
        return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]

    degree = np.where(free, around(domain.astype(float)), 1.0)
    b = np.where(free, around(np.where(pin, np.nan_to_num(value), 0.0)), 0.0)
    x = np.where(free, value[pin].mean(), 0.0)
    apply = lambda v: np.where(free, degree * v - around(v), 0.0)
    r = b - apply(x)
    z = r / degree
    p, rz = z.copy(), (r * z).sum()
    goal = tolerance * max(np.sqrt((b * b).sum()), 1e-30)
    for _ in range(most):
        if np.sqrt((r * r).sum()) <= goal:
            break
        ap = apply(p)
        a = rz / (p * ap).sum()
        x += a * p
        r -= a * ap
        z = r / degree
        rz, old = (r * z).sum(), rz
        p = z + rz / old * p
    else:
        raise ArithmeticError("the harmonic fill did not converge")
    out[free] = x[free]
    return out


def river_surface(mask: np.ndarray, dem: np.ndarray, pixel: float, tiebreak: np.ndarray | None = None) -> np.ndarray:
    """Water level of a river polygon's cells (NaN elsewhere)."""
    skel = medial_axis(mask, tiebreak)
    dist = edt(mask)
    stations = np.array(order_skeleton(skel, dem), int).reshape(-1, 2)
    out = np.full(mask.shape, np.nan)
    if not len(stations):
        return out
    at = stations[:, 0], stations[:, 1]
    half = np.maximum(2.0, dist[at])
    if len(stations) < 5:
        depth = float(np.clip(np.median(dist[at]) * pixel * 0.1, 1, 10))
        r, c = np.nonzero(mask)
        sk = np.argwhere(skel)
        near = sk[((r[:, None] - sk[:, 0]) ** 2 + (c[:, None] - sk[:, 1]) ** 2).argmin(1)]
        out[r, c] = dem[near[:, 0], near[:, 1]] + depth
        return out
    tangent = tangents(stations)
    z = multi_peak(cross_sections(stations, tangent, half, mask & ~erode(mask), dem))
    ok = np.isfinite(z)
    if ok.any() and not ok.all():
        z = _fill(z)
    z = smooth_levels(stations, z, half, mask.shape)
    use = ~junctions(stations, tangent) & mask[at] & np.isfinite(z)
    if not use.any():
        if np.isfinite(z).any():
            out[mask] = np.nanmean(z)
        return out
    pin, value = np.zeros(mask.shape, bool), np.zeros(mask.shape)
    pin[stations[use, 0], stations[use, 1]] = True
    value[stations[use, 0], stations[use, 1]] = z[use]
    return np.where(mask, harmonic(mask, pin, value), np.nan)
