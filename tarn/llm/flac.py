"""FLAC for 8-bit mono samples, many frames at a time in numpy.

Frames of a batch are coded and decoded in lockstep: step s handles sample s of
all frames at once. The encoder writes constant, verbatim, fixed (order 0 to 1)
and order-2 linear-predictor subframes with one Rice partition, whichever is
shortest, and a seek table that names every frame's sample and byte offset. The
decoder reads such streams (fixed orders 0 to 4, any predictor order), checks
each frame's CRC-8 and CRC-16 and the stream's MD5, and refuses what it doesn't know.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

BLOCK = 1024
RATE = 8000
CHUNK = 1024  # frames handled at once
PRECISION, SHIFT = 8, 5  # of the order-2 predictor's coefficients


class FlacError(ValueError):
    pass


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for x in range(256):
        c = x << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_x = np.arange(65536)
CLZ16 = np.where(_x > 0, 15 - np.floor(np.log2(np.maximum(_x, 1))), 16).astype(np.uint64)
del _x


def _crc(buf: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """CRC of the bytes [start, start + length) of ``buf``, all ranges in lockstep."""
    order = np.argsort(-length, kind="stable")
    at, n = start[order], length[order]
    crc = np.zeros(len(at), np.uint16)
    ends = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
    table = CRC16 if bits == 16 else CRC8
    for i, m in enumerate(ends):
        c = crc[:m]
        byte = buf[at[:m] + i]
        crc[:m] = (table[(c >> 8) ^ byte] ^ (c << 8)) if bits == 16 else table[(c ^ byte) & 0xFF]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8(n: int) -> bytes:
    """The frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x3F
    while n > limit:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        limit >>= 1
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *reversed(tail)])


def _header(number: int, n: int) -> bytes:
    size, extra = (0xA, b"") if n == 1024 else (0x6, bytes([n - 1])) if n <= 256 else (0x7, struct.pack(">H", n - 1))
    h = bytes([0xFF, 0xF8, size << 4 | 0x4, 0x02]) + _utf8(number) + extra
    c = 0
    for x in h:
        c = int(CRC8[c ^ x])
    return h + bytes([c])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _best_rice(u: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, parameter) of the shortest Rice code whose longest unary part is under 16."""
    best, param = np.full(len(u), 1 << 40, np.int64), np.zeros(len(u), np.int64)
    for k in range(8):
        bits = (u >> k).sum(1, dtype=np.int64) + n * (k + 1)
        better = (bits < best) & (most >> k < 16)
        best[better], param[better] = bits[better], k
    return best, param


def _encode_frames(x: np.ndarray, n: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames for the rows of ``x`` (int32 samples, row i has n[i], zeros after)."""
    rows, width = x.shape
    col = np.arange(width)
    valid = col < n[:, None]
    d1 = np.zeros_like(x)
    d1[:, 1:] = x[:, 1:] - x[:, :-1]
    # order 2: normal equations of each row, quantised
    xf = x.astype(np.float32)
    a0 = np.einsum("ij,ij->i", xf, xf)
    a1 = np.einsum("ij,ij->i", xf[:, 1:], xf[:, :-1])
    a2 = np.einsum("ij,ij->i", xf[:, 2:], xf[:, :-2]) if width > 2 else np.zeros(rows, np.float32)
    det = a0 * a0 - a1 * a1
    ok = det > 1e-6 * np.maximum(a0 * a0, 1)
    safe = np.where(ok, det, 1)
    lim = (1 << (PRECISION - 1)) - 1
    c1 = np.clip(np.rint(np.where(ok, (a0 * a1 - a1 * a2) / safe, 0) * (1 << SHIFT)), -lim, lim).astype(np.int32)
    c2 = np.clip(np.rint(np.where(ok, (a0 * a2 - a1 * a1) / safe, 0) * (1 << SHIFT)), -lim, lim).astype(np.int32)
    lp = np.zeros_like(x)
    lp[:, 2:] = x[:, 2:] - ((c1[:, None] * x[:, 1:-1] + c2[:, None] * x[:, :-2]) >> SHIFT)
    choices = []
    for r, order, extra in ((x, 0, 0), (d1, 1, 0), (lp, 2, 9 + 2 * PRECISION)):
        u = np.where(valid & (col >= order), _zigzag(r), 0)
        bits, k = _best_rice(u, n - order, u.max(1, initial=0))
        choices.append((u, order, k, bits + 8 + 8 * order + extra + 10))
    cost = np.stack([c[3] for c in choices] + [8 + 8 * n])
    kind = cost.argmin(0)
    same = (np.where(valid, x, x[:, :1]) == x[:, :1]).all(1)
    total = np.where(same, 16, cost[kind, np.arange(rows)])
    size = (total + 7) >> 3
    heads = [_header(int(m), int(k)) for m, k in zip(numbers, n)]
    hlen = np.array([len(h) for h in heads])
    flen = hlen + size + 2
    at = np.concatenate(([0], np.cumsum(flen)))
    out = np.zeros(at[-1], np.uint8)
    base = (at[:-1] + hlen) * 8

    def put(pos: np.ndarray, value: np.ndarray, bits) -> None:
        """OR fields of at most 17 bits, ending before bit pos + bits; no two overlap."""
        end = pos + bits - 1
        v = value.astype(np.int64) << (7 - (end & 7))
        b = end >> 3
        for j in range(3):
            part = (v >> (8 * j)) & 0xFF
            keep = part > 0
            if keep.any():
                out[:] |= np.bincount(b[keep] - j, part[keep], minlength=len(out)).astype(np.uint8)

    for h, a in zip(heads, at):
        out[a : a + len(h)] = np.frombuffer(h, np.uint8)
    first = x[:, 0] & 0xFF
    s = np.flatnonzero(same)
    out[(base[s] >> 3) + 1] = first[s]  # type 0: constant
    plain = np.flatnonzero(~same & (kind == 3))
    for i in plain:
        b = base[i] >> 3
        out[b] = 1 << 1
        out[b + 1 : b + 1 + n[i]] = (x[i, : n[i]] & 0xFF).astype(np.uint8)
    pos_all, val_all, len_all = [], [], []
    for which, (u, order, k, _) in enumerate(choices):
        f = np.flatnonzero(~same & (kind == which))
        if not len(f):
            continue
        typ = (8 + order) if which < 2 else (32 + order - 1)
        p = base[f].copy()
        fields = [(np.full(len(f), typ << 1), 8)] + [(x[f, j] & 0xFF, 8) for j in range(order)]
        if which == 2:
            fields += [(np.full(len(f), PRECISION - 1), 4), (np.full(len(f), SHIFT), 5), (c1[f] & (2**PRECISION - 1), PRECISION), (c2[f] & (2**PRECISION - 1), PRECISION)]
        fields += [(np.zeros(len(f), np.int64), 6), (k[f], 4)]
        for value, bits in fields:
            pos_all.append(p.copy())
            val_all.append(np.asarray(value, np.int64))
            len_all.append(np.full(len(f), bits))
            p += bits
        uf, kf = u[f], k[f][:, None]
        m = valid[f] & (col >= order)
        q = uf >> kf
        length = np.where(m, q + 1 + kf, 0)
        end = np.cumsum(length, 1) + p[:, None]
        kk = np.broadcast_to(kf, uf.shape)[m]
        pos_all.append(end[m] - 1 - kk)
        val_all.append((1 << kk) | (uf[m] & ((1 << kk) - 1)))
        len_all.append(kk + 1)
    if pos_all:
        put(np.concatenate(pos_all), np.concatenate(val_all), np.concatenate(len_all))
    crc = _crc(out, at[:-1], flen - 2, 16)
    out[at[1:] - 2], out[at[1:] - 1] = crc >> 8, crc & 0xFF
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def _groups(n: np.ndarray) -> list[np.ndarray]:
    """Rows of like width together, CHUNK at most."""
    kind = np.ceil(np.log2(np.maximum(n, 16))).astype(int)
    out = []
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        out += [rows[i : i + CHUNK] for i in range(0, len(rows), CHUNK)]
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each non-empty payload; byte b is the sample b - 128."""
    owner, number, start, count = [], [], [], []
    for i, p in enumerate(payloads):
        for j, a in enumerate(range(0, len(p), BLOCK)):
            owner.append(i)
            number.append(j)
            start.append(a)
            count.append(min(BLOCK, len(p) - a))
    n = np.array(count, np.int64)
    frames: list[bytes] = [b""] * len(n)
    for rows in _groups(n):
        x = np.zeros((len(rows), int(n[rows].max())), np.int32)
        for r, i in enumerate(rows):
            c = count[i]
            x[r, :c] = np.frombuffer(payloads[owner[i]], np.uint8, c, start[i])
            x[r, :c] -= 128
        for i, f in zip(rows, _encode_frames(x, n[rows], np.array(number)[rows])):
            frames[i] = f
    out, at = [], 0
    for p in payloads:
        own = -(-len(p) // BLOCK)
        mine = frames[at : at + own]
        counts = count[at : at + own]
        at += own
        sizes = [len(f) for f in mine]
        signed = np.frombuffer(p, np.uint8) ^ 0x80
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big") + hashlib.md5(signed.tobytes()).digest()
        seek, sample, offset = [], 0, 0
        for c, z in zip(counts, sizes):
            seek.append(struct.pack(">QQH", sample, offset, c))
            sample += c
            offset += z
        points = b"".join(seek)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(mine))
    return out


def seek_points(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """(samples, md5, [(first sample, byte offset, samples)], where frames begin)."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, last, total, md5, points = 4, False, None, b"", []
    while not last:
        kind, size = stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = bool(stream[at] & 0x80), stream[at + 4 : at + 4 + size]
        if kind == 0:
            bits = int.from_bytes(body[10:18], "big")
            if (bits >> 41) & 7 or (bits >> 36) & 31 != 7:
                raise FlacError("only 8-bit mono streams")
            total, md5 = bits & (2**36 - 1), body[18:34]
        elif kind == 3:
            points = [struct.unpack_from(">QQH", body, i) for i in range(0, size, 18)]
        at += 4 + size
    if total is None or sum(p[2] for p in points) != total:
        raise FlacError("the seek table doesn't name every frame")
    return total, md5, points, at


def _fields(words: np.ndarray, pos: np.ndarray, bits) -> np.ndarray:
    """The field of ``bits`` bits at each bit position."""
    w = words[pos >> 3] << (pos & 7).astype(np.uint64)
    return (w >> np.asarray(64 - np.asarray(bits), np.uint64)).astype(np.int64)


def _signed(v: np.ndarray, bits: int) -> np.ndarray:
    return np.where(v >= 1 << (bits - 1), v - (1 << bits), v)


def _decode_frames(buf: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Samples (rows, width) of the frames at ``start``, checked."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    if (_crc(padded, start, size, 16) != 0).any():
        raise FlacError("a frame's CRC-16 is wrong")
    if (padded[start] != 0xFF).any() or (padded[start + 1] != 0xF8).any():
        raise FlacError("no frame where the seek table says")
    lead = padded[start + 4]
    utf = np.where(lead < 0x80, 1, np.array([8 - int(x).bit_length() for x in range(256)])[lead ^ 0xFF])
    code = padded[start + 2] >> 4
    extra = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    hlen = 4 + utf + extra
    if (_crc(padded, start, hlen + 1, 8) != 0).any():
        raise FlacError("a frame header's CRC-8 is wrong")
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(buf) + 8]
    words = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    width = int(n.max())
    out = np.zeros((len(start), width), np.int32)
    pos = (start + hlen + 1) * 8
    head = _fields(words, pos, 8)
    pos = pos + 8
    kind = head >> 1
    if (head & 0x81).any():
        raise FlacError("wasted bits aren't read here")
    c = np.flatnonzero(kind == 0)
    out[c] = np.where(np.arange(width) < n[c, None], _signed(_fields(words, pos[c], 8), 8)[:, None], 0)
    for i in np.flatnonzero(kind == 1):
        b = pos[i] >> 3
        out[i, : n[i]] = padded[b : b + n[i]].view(np.int8)
    for t in np.unique(kind[kind > 1]):
        f = np.flatnonzero(kind == t)
        if 8 <= t <= 12:
            order = int(t - 8)
        elif t >= 32:
            order = int(t - 31)
        else:
            raise FlacError(f"unknown subframe type {t}")
        p = pos[f].copy()
        x = np.zeros((len(f), width), np.int64)
        for j in range(order):
            x[:, j] = _signed(_fields(words, p, 8), 8)
            p += 8
        coefs, shift = [], np.zeros(len(f), np.int64)
        if t >= 32:
            precision = _fields(words, p, 4) + 1
            shift = _fields(words, p + 4, 5)
            p += 9
            for _ in range(order):
                v = _fields(words, p, precision)
                coefs.append(np.where(v >= 1 << (precision - 1), v - (1 << precision), v))
                p += precision
        if (_fields(words, p, 6) != 0).any():
            raise FlacError("one Rice partition with 4-bit parameters is read here")
        k = _fields(words, p + 6, 4)
        if (k == 15).any():
            raise FlacError("escaped partitions aren't read here")
        p += 10
        # longest first, so that the frames still open are a prefix
        by = np.argsort(-n[f], kind="stable")
        p, ks, nf = p[by], k[by].astype(np.uint64), n[f][by]
        res = np.zeros((width, len(f)), np.int64)
        still = np.searchsorted(-nf, -np.arange(1, width + 1), side="right")
        one = np.uint64(1)
        for s in range(order, width):
            m = still[s]
            if not m:
                break
            a = p[:m]
            w = words[a >> 3] << (a & 7).astype(np.uint64)
            q = CLZ16[(w >> np.uint64(48)).astype(np.int64)]
            if (q == 16).any():  # a longer unary part: count it bit by bit, on past the word
                for i in np.flatnonzero(q == 16):
                    b = int(a[i])
                    while not (int(padded[b >> 3]) >> (7 - (b & 7))) & 1:
                        b += 1
                    q[i] = b - int(a[i])
                    w[i] = (words[b >> 3] << np.uint64(b & 7)) >> np.uint64(16)
                short = np.minimum(q, np.uint64(16))
            else:
                short = q
            kk = ks[:m]
            low = np.where(kk > 0, (w << (short + one)) >> (np.uint64(64) - np.maximum(kk, one)), 0).astype(np.uint64)
            res[s, :m] = ((q << kk) | low).astype(np.int64)
            p[:m] += (q + one + kk).astype(np.int64)
        res = (res >> 1) ^ -(res & 1)
        r = np.empty_like(x)
        r[by] = res.T
        if t < 32:
            r[:, :order] = x[:, :order]
            x = r if order == 0 else np.cumsum(r, 1) if order == 1 else _integrate(r, order)
        else:
            for s in range(order, width):
                pred = coefs[0] * x[:, s - 1]
                for j in range(1, order):
                    pred = pred + coefs[j] * x[:, s - 1 - j]
                x[:, s] = r[:, s] + (pred >> shift)
        out[f] = np.where(np.arange(width) < n[f, None], x, 0)
    return out


def _integrate(r: np.ndarray, order: int) -> np.ndarray:
    """Fixed predictor of order 2 to 4: r holds warm-up samples, then residuals."""
    coef = {2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}[order]
    x = r.copy()
    for s in range(order, r.shape[1]):
        x[:, s] = r[:, s] + sum(c * x[:, s - 1 - j] for j, c in enumerate(coef))
    return x


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams that carry a full seek table; raises :class:`FlacError` on any damage."""
    infos = [seek_points(s) for s in streams]
    buf = np.frombuffer(b"".join(streams), np.uint8)
    base = np.concatenate(([0], np.cumsum([len(s) for s in streams])))
    start, size, n = [], [], []
    for (_, _, points, at), b, s in zip(infos, base, streams):
        offsets = [at + p[1] for p in points] + [len(s)]
        start += [b + o for o in offsets[:-1]]
        size += [offsets[i + 1] - offsets[i] for i in range(len(points))]
        n += [p[2] for p in points]
    start, size, n = (np.array(v, np.int64) for v in (start, size, n))
    samples: list[bytes] = [b""] * len(n)
    for rows in _groups(n):
        order = rows[np.argsort(start[rows], kind="stable")]
        # only the bytes of these frames
        pieces = [buf[start[i] : start[i] + size[i]] for i in order]
        local = np.concatenate(([0], np.cumsum(size[order])))[:-1]
        x = _decode_frames(np.concatenate(pieces), local, size[order], n[order])
        raw = (x + 128).astype(np.uint8)
        for r, i in enumerate(order):
            samples[i] = raw[r, : n[i]].tobytes()
    out, at = [], 0
    for total, md5, points, _ in infos:
        p = b"".join(samples[at : at + len(points)])
        at += len(points)
        if hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest() != md5 or len(p) != total:
            raise FlacError("the stream's MD5 is wrong")
        out.append(p)
    return out
