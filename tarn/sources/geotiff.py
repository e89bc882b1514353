"""GeoTIFF rasters: headers, windows, blocks for Spark, and a float32 writer.

:func:`read` goes through Spark's binary file reader, so files may lie in any store that Spark reads; a folder of
files is a mosaic. Of a file only the strips or tiles that a window needs are decoded. Read: classic and
BigTIFF, strips or tiles, no compression, deflate or PackBits, predictors 2 and 3, the first band of
integers and floats. Other compressions are refused. Written: float32 strips, deflate, one band.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1024
# fixed values of the format: bytes and codes of the field types
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
SCALE, TIEPOINT, MATRIX, KEYS, NODATA_TEXT = 33550, 33922, 34264, 34735, 42113
RASTER_TYPE, GEOGRAPHIC_CODE, PROJECTED_CODE, POINT_RASTER = 1025, 2048, 3072, 2


class GeoTiffError(ValueError):
    pass


@dataclass
class Header:
    """What a file says of its raster; ``pieces`` are (offset, bytes) of its strips or tiles in order."""

    width: int
    height: int
    dtype: np.dtype
    samples: int
    planar: bool
    compression: int
    predictor: int
    piece_w: int
    piece_h: int
    pieces: list
    transform: tuple
    epsg: int | None
    nodata: float | None

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, _, c, _, e, f = self.transform
        return min(c, c + a * self.width), min(f, f + e * self.height), max(c, c + a * self.width), max(f, f + e * self.height)


def header(data: bytes) -> Header:
    """The first directory of a file."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None:
        raise GeoTiffError("not a TIFF file")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise GeoTiffError(f"unknown TIFF magic {magic}")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    tags: dict[int, tuple] = {}
    for i in range(n):
        p = at + i * (20 if big else 12)
        tag, kind = struct.unpack_from(order + "HH", data, p)
        count = struct.unpack_from(order + ("Q" if big else "I"), data, p + 4)[0]
        if kind not in TYPES:
            continue
        letter = TYPES[kind]
        size = count * struct.calcsize("<" + letter)
        p += 12 if big else 8
        if size > (8 if big else 4):
            p = struct.unpack_from(order + ("Q" if big else "I"), data, p)[0]
        tags[tag] = (bytes(data[p : p + count]),) if letter == "s" else struct.unpack_from(order + letter * count, data, p)
    one = lambda t, d=None: tags[t][0] if t in tags else d
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if kind is None or one(BITS, 1) % 8:
        raise GeoTiffError("unsupported sample format")
    if one(COMPRESSION, 1) not in (1, 8, 32946, 32773):
        raise GeoTiffError(f"unsupported compression {one(COMPRESSION)}")
    width, height, tiled = one(WIDTH), one(HEIGHT), TILES in tags
    offsets, sizes = tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES]
    keys = tags.get(KEYS, (1, 1, 0, 0))
    values = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    if MATRIX in tags:
        m = tags[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in tags and TIEPOINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[SCALE], tags[TIEPOINT]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    if values.get(RASTER_TYPE) == POINT_RASTER:  # the tie stands at a pixel's centre
        a, b, c, d, e, f = transform
        transform = (a, b, c - (a + b) / 2, d, e, f - (d + e) / 2)
    text = one(NODATA_TEXT, b"").rstrip(b"\0 ").decode("ascii", "replace")
    try:
        nodata = float(text) if text else None
    except ValueError:
        nodata = None
    epsg = values.get(PROJECTED_CODE) or values.get(GEOGRAPHIC_CODE)
    return Header(width, height, np.dtype(f"{order}{kind}{one(BITS) // 8}"), one(SAMPLES, 1), one(PLANAR, 1) == 2, one(COMPRESSION, 1), one(PREDICTOR, 1), one(TILE_W, width) if tiled else width, one(TILE_H) if tiled else min(height, one(ROWS, height)), list(zip(offsets, sizes)), transform, epsg if epsg and epsg != 32767 else None, nodata)


def _unpack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def _piece(data: bytes, h: Header, index: int, rows: int) -> np.ndarray:
    """(rows, piece_w) of the first band of a strip or tile; NaN for a piece that is not stored."""
    offset, size = h.pieces[index]
    bands = 1 if h.planar else h.samples
    if size == 0:
        return np.full((rows, h.piece_w), np.nan)
    raw = bytes(data[offset : offset + size])
    raw = zlib.decompress(raw) if h.compression in (8, 32946) else _unpack_bits(raw) if h.compression == 32773 else raw
    step = h.piece_w * bands
    if h.predictor == 3:  # bytes of a row by significance, each a difference to the one a sample before
        b = np.frombuffer(raw, np.uint8, rows * step * h.dtype.itemsize).reshape(rows, -1, bands)
        b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(rows, h.dtype.itemsize, step)
        x = np.ascontiguousarray(b.transpose(0, 2, 1)).view(h.dtype.newbyteorder(">")).reshape(rows, h.piece_w, bands)
    else:
        x = np.frombuffer(raw, h.dtype, rows * step).reshape(rows, h.piece_w, bands)
        if h.predictor == 2:
            x = np.cumsum(x.astype(h.dtype.newbyteorder("=")), axis=1, dtype=h.dtype.newbyteorder("="))
    return x[:, :, 0]


def window(data: bytes, h: Header, col0: int, row0: int, width: int, height: int) -> np.ndarray:
    """float32 cells of a window, NaN for no data and beyond the raster; only the pieces it meets are decoded."""
    out = np.full((height, width), np.nan, np.float32)
    across = -(-h.width // h.piece_w)
    for pr in range(max(0, row0) // h.piece_h, -(-min(h.height, row0 + height) // h.piece_h)):
        for pc in range(max(0, col0) // h.piece_w, -(-min(h.width, col0 + width) // h.piece_w)):
            top, left = pr * h.piece_h, pc * h.piece_w
            rows = h.piece_h if h.piece_w != h.width or across > 1 else min(h.piece_h, h.height - top)
            x = _piece(data, h, pr * across + pc, rows).astype(np.float32)
            r0, r1 = max(row0, top, 0), min(row0 + height, top + h.piece_h, h.height)
            c0, c1 = max(col0, left, 0), min(col0 + width, left + h.piece_w, h.width)
            if r0 < r1 and c0 < c1:
                out[r0 - row0 : r1 - row0, c0 - col0 : c1 - col0] = x[r0 - top : r1 - top, c0 - left : c1 - left]
    if h.nodata is not None and not math.isnan(h.nodata):
        out[out == np.float32(h.nodata)] = np.nan
    return out


def encode(cells: np.ndarray, transform: tuple, epsg: int | None, nodata: float | None = None, rows: int = 64) -> bytes:
    """A file of float32 ``cells``; NaN is written as ``nodata`` where there is one."""
    data = np.where(np.isnan(cells), np.float32(nodata), cells) if nodata is not None else cells
    data = np.ascontiguousarray(data, "<f4")
    height, width = data.shape
    strips = [zlib.compress(data[r : r + rows].tobytes(), 6) for r in range(0, height, rows)]
    a, _, c, _, e, f = transform
    keys = [1, 1, 0, 2 + (epsg is not None), 1024, 0, 1, 2 if epsg == 4326 else 1, RASTER_TYPE, 0, 1, 1]
    if epsg is not None:
        keys += [GEOGRAPHIC_CODE if epsg == 4326 else PROJECTED_CODE, 0, 1, epsg]
    at, places = 8, []
    for s in strips:
        places.append(at)
        at += len(s)
    tags = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [32]), (COMPRESSION, "H", [8]), (262, "H", [1]), (STRIPS, "I", places), (SAMPLES, "H", [1]), (ROWS, "I", [rows]), (STRIP_BYTES, "I", [len(s) for s in strips]), (PLANAR, "H", [1]), (FORMAT, "H", [3]), (SCALE, "d", [a, -e, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, c, f, 0.0]), (KEYS, "H", keys)]
    if nodata is not None:
        tags.append((NODATA_TEXT, "s", [f"{nodata:g}".encode() + b"\0"]))
    code = {v: k for k, v in TYPES.items()}
    body, at = b"", at + at % 2
    entries, extra_at = [], at + 2 + 12 * len(tags) + 4
    for tag, letter, values in tags:
        raw = values[0] if letter == "s" else struct.pack("<" + letter * len(values), *values)
        count = len(raw) if letter == "s" else len(values)
        if len(raw) <= 4:
            entries.append(struct.pack("<HHI", tag, code[letter], count) + raw.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, code[letter], count, extra_at + len(body)))
            body += raw + b"\0" * (len(raw) % 2)
    head = struct.pack("<2sHI", b"II", 42, at)
    blob = head + b"".join(strips)
    return blob.ljust(at, b"\0") + struct.pack("<H", len(tags)) + b"".join(entries) + struct.pack("<I", 0) + body


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, epsg, transform, nodata, minx, miny, maxx, maxy); no cell is decoded."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                h = header(content)
                rows.append((file, h.width, h.height, h.epsg, list(h.transform), h.nodata, *h.bounds))
            yield pd.DataFrame(rows, columns=["file", "width", "height", "epsg", "transform", "nodata", "minx", "miny", "maxx", "maxy"]).astype({"width": "int32", "height": "int32", "epsg": "Int32"})

    schema = "file string, width int, height int, epsg int, transform array<double>, nodata double, minx double, miny double, maxx double, maxy double"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read(spark: SparkSession, path: str, window_: tuple[int, int, int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """(file, row0, col0, h, w, transform, epsg, data): blocks of float32 cells (bytes, row by row) of each file, or of its window (col0, row0, w, h).

    No data is NaN, as is what a window has beyond the raster. ``transform`` is the block's own.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                h = header(content)
                c0, r0, w, n = window_ or (0, 0, h.width, h.height)
                a, _, c, _, e, f = h.transform
                for r in range(r0, r0 + n, block):
                    rows = []
                    for q in range(c0, c0 + w, block):
                        bw, bh = min(block, c0 + w - q), min(block, r0 + n - r)
                        rows.append((file, r, q, bh, bw, [a, 0.0, c + q * a, 0.0, e, f + r * e], h.epsg, window(content, h, q, r, bw, bh).tobytes()))
                    yield pd.DataFrame(rows, columns=["file", "row0", "col0", "h", "w", "transform", "epsg", "data"]).astype({"row0": "int32", "col0": "int32", "h": "int32", "w": "int32", "epsg": "Int32"})

    schema = "file string, row0 int, col0 int, h int, w int, transform array<double>, epsg int, data binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def cells(blocks: DataFrame) -> DataFrame:
    """(r, c, z) of blocks, cells without a value left out."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for r0, c0, h, w, data in zip(pdf["row0"], pdf["col0"], pdf["h"], pdf["w"], pdf["data"]):
                a = np.frombuffer(data, np.float32).reshape(h, w)
                r, c = np.nonzero(~np.isnan(a))
                yield pd.DataFrame({"r": (r + r0).astype("int32"), "c": (c + c0).astype("int32"), "z": a[r, c]})

    return blocks.select("row0", "col0", "h", "w", "data").mapInPandas(run, "r int, c int, z float")


def sampled(blocks: DataFrame, transform: tuple, width: int, height: int) -> DataFrame:
    """(r, c, z) of a grid over a mosaic: the cell of the mosaic that holds each pixel's upper left corner.

    Where files overlap the first by name wins. Corners go to their block by a join on coarse cells, not by a cross join.
    """
    a, _, c0, _, e, f0 = transform
    z = cells_xy(blocks)
    step = z.agg(F.min("a"), F.min("e")).first()
    if step[0] is None:
        return z.sparkSession.createDataFrame([], "r int, c int, z float")
    px, py = step[0], -step[1]
    grid = z.sparkSession.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    grid = grid.select("r", "c", (F.col("c") * a + c0).alias("x"), (F.col("r") * e + f0).alias("y"))
    key = lambda x, y: (F.floor(x / px + 1e-9), F.floor(-y / py + 1e-9))
    kx, ky = key(F.col("x"), F.col("y"))
    sx, sy = key(F.col("cx"), F.col("cy"))
    side = z.select("file", "z", "x0", "x1", "y0", "y1", sx.alias("kx"), sy.alias("ky"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    g = grid.withColumn("o", F.explode(near)).select("r", "c", "x", "y", (kx + F.col("o.i")).alias("kx"), (ky + F.col("o.j")).alias("ky"))
    j = g.join(side, ["kx", "ky"]).filter((F.col("x") >= F.col("x0") - 1e-9) & (F.col("x") < F.col("x1") - 1e-9) & (F.col("y") <= F.col("y1") + 1e-9) & (F.col("y") > F.col("y0") + 1e-9))
    return j.groupBy("r", "c").agg(F.min_by("z", "file").alias("z"))


def cells_xy(blocks: DataFrame) -> DataFrame:
    """Cells with their own place: file, z, box (x0, y0, x1, y1), centre (cx, cy), pixel (a, e)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for file, h, w, t, data in zip(pdf["file"], pdf["h"], pdf["w"], pdf["transform"], pdf["data"]):
                v = np.frombuffer(data, np.float32).reshape(h, w)
                r, c = np.nonzero(~np.isnan(v))
                a, _, x, _, e, y = t
                left, top = x + c * a, y + r * e
                yield pd.DataFrame({"file": file, "z": v[r, c], "x0": left, "x1": left + a, "y0": top + e, "y1": top, "cx": left + a / 2, "cy": top + e / 2, "a": a, "e": e})

    return blocks.select("file", "h", "w", "transform", "data").mapInPandas(run, "file string, z float, x0 double, x1 double, y0 double, y1 double, cx double, cy double, a double, e double")


def write(blocks: DataFrame, folder: str, nodata: float = -9999.0) -> None:
    """Blocks, each as one file ``<row0>_<col0>.tif`` of ``folder``: a mosaic that :func:`read` takes. Files go through Spark's file system."""
    spark = blocks.sparkSession

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(f"{r}_{c}.tif", encode(np.frombuffer(d, np.float32).reshape(h, w), tuple(t), None if pd.isna(e) else int(e), nodata)) for r, c, h, w, t, e, d in zip(pdf["row0"], pdf["col0"], pdf["h"], pdf["w"], pdf["transform"], pdf["epsg"], pdf["data"])]
            yield pd.DataFrame(out, columns=["name", "data"])

    files = blocks.select("row0", "col0", "h", "w", "transform", "epsg", "data").mapInPandas(run, "name string, data binary")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    for row in files.toLocalIterator():  # one block at a time passes the driver
        stream = fs.create(jvm.org.apache.hadoop.fs.Path(where, row["name"]), True)
        try:
            stream.write(bytes(row["data"]))
        finally:
            stream.close()


def pack(cells_: DataFrame, height: int, width: int, transform: tuple, epsg: int | None, block: int = BLOCK) -> DataFrame:
    """Blocks, as of :func:`read`, of cells (r, c, z); a cell without a row is NaN. Blocks without any cell are left out."""
    a, _, c0, _, e, f0 = transform

    def run(pdf):
        import pandas as pd

        r0, q0 = int(pdf["br"].iloc[0]) * block, int(pdf["bc"].iloc[0]) * block
        h, w = min(block, height - r0), min(block, width - q0)
        out = np.full((h, w), np.nan, np.float32)
        out[pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - q0] = pdf["z"].to_numpy()
        return pd.DataFrame({"file": [f"{r0}_{q0}"], "row0": [r0], "col0": [q0], "h": [h], "w": [w], "transform": [[a, 0.0, c0 + q0 * a, 0.0, e, f0 + r0 * e]], "epsg": pd.array([epsg], dtype="Int32"), "data": [out.tobytes()]})

    keyed = cells_.select("r", "c", "z", F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc"))
    return keyed.groupBy("br", "bc").applyInPandas(run, "file string, row0 int, col0 int, h int, w int, transform array<double>, epsg int, data binary")
