"""Shapefiles as a Spark data source: ``spark.read.format("shapefile")`` after :func:`register`.

Columns: ``feature_idx`` (place in the file), ``kind`` (point, line, polygon; null for a null shape), ``parts``
(rings, lines or single points in file order), then the attributes. The file's index lets partitions read their
own records only. Paths must be open to all executors as files.

Reading: ``load(path)`` of one ``.shp`` or of a folder of them. Options: ``rows`` for each partition;
``bbox`` "minx,miny,maxx,maxy", by which records are skipped before they are decoded (closed boxes; null shapes are skipped too).
Writing: the format holds one layer in a file, so each task writes one file into the folder ``path``; files appear
on commit. Option ``prj``: text of the sidecar. A string that doesn't fit a field (254 bytes) is an error, never cut.

Defined results: numbers are doubles; dates and texts are strings; blank attributes are null; a missing ``.dbf``
means no attributes; an attribute named as one of the three columns gets a ``_1`` after it; an empty layer has no rows.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
SHAPE = [StructField("feature_idx", LongType()), StructField("kind", StringType()), StructField("parts", ArrayType(ArrayType(POINT)))]
OWN = tuple(f.name for f in SHAPE)
# fixed values of the format: shape type modulo 10 (tens tell Z and M)
KINDS = {1: "point", 3: "line", 5: "polygon", 8: "point"}
CODES = {"point": 8, "line": 3, "polygon": 5}
TEXT_WIDTH, NUMBER_WIDTH = 254, 24


@dataclass
class Field:
    name: str
    kind: str
    start: int
    width: int

    @property
    def type(self):
        return {"N": DoubleType(), "F": DoubleType(), "L": BooleanType()}.get(self.kind, StringType())


def fields(shp: str) -> tuple[list[Field], int, int]:
    """(fields, header bytes, record bytes) of the attribute file beside ``shp``; no fields without one."""
    path = sidecar(shp, ".dbf")
    if path is None:
        return [], 0, 0
    with open(path, "rb") as f:
        head = f.read(32)
        size, width = struct.unpack("<HH", head[8:12])
        body, out, at = f.read(size - 32), [], 1
    used = {n.lower() for n in OWN}
    for i in range(0, len(body), 32):
        if body[i] == 0x0D:
            break
        name = base = body[i : i + 11].split(b"\0")[0].decode("utf-8", "replace").strip()
        k = 0
        while name.lower() in used:
            k += 1
            name = f"{base}_{k}"
        used.add(name.lower())
        out.append(Field(name, chr(body[i + 11]), at, body[i + 16]))
        at += body[i + 16]
    return out, size, width


def sidecar(shp: str, ext: str) -> str | None:
    for e in (ext, ext.upper()):
        if os.path.exists(shp[:-4] + e):
            return shp[:-4] + e
    return None


def projection(path: str) -> str | None:
    """Text of the ``.prj`` beside a layer."""
    at = sidecar(layers(path)[0], ".prj")
    return open(at, encoding="utf-8").read() if at else None


def layers(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if n.lower().endswith(".shp"))
    return [path]


def derive_path(base: str, suffix: str, ext: str) -> str:
    """``<stem>_<suffix>.<ext>`` beside ``base``."""
    return f"{os.path.splitext(base)[0]}_{suffix}.{ext.lstrip('.')}"


def attribute(raw: bytes, kind: str, encoding: str):
    text = raw.decode(encoding, "replace").strip(" \0")
    if not text:
        return None
    if kind in "NF":
        try:
            return float(text)
        except ValueError:  # asterisks of an overflow
            return None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return text


def decode(body: bytes, bbox: tuple[float, ...] | None = None):
    """(kind, parts) of a record's content; None if its box misses ``bbox``."""
    code = struct.unpack_from("<i", body)[0]
    kind = KINDS.get(code % 10)
    if kind is None:
        return None if bbox else (None, None)
    single = code % 10 == 1
    box = struct.unpack_from("<2d", body, 4) * 2 if single else struct.unpack_from("<4d", body, 4)
    if bbox and not (box[0] <= bbox[2] and box[2] >= bbox[0] and box[1] <= bbox[3] and box[3] >= bbox[1]):
        return None
    if single:
        return kind, [[box[:2]]]
    if kind == "point":
        n = struct.unpack_from("<i", body, 36)[0]
        v = struct.unpack_from(f"<{2 * n}d", body, 40)
        return kind, [[(x, y)] for x, y in zip(v[::2], v[1::2])]
    k, n = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{k}i", body, 44), n]
    v = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * k)
    points = list(zip(v[::2], v[1::2]))
    return kind, [points[a:b] for a, b in zip(starts, starts[1:])]


@dataclass
class Records(InputPartition):
    shp: str
    first: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths = layers(options["path"])
        self.rows = int(options.get("rows", 50_000))
        self.bbox = tuple(map(float, options["bbox"].split(","))) if options.get("bbox") else None
        self.names = [f.name for f in schema.fields]

    def partitions(self):
        out = []
        for shp in self.paths:
            n = (os.path.getsize(sidecar(shp, ".shx")) - 100) // 8
            out += [Records(shp, i, min(n, i + self.rows)) for i in range(0, n, self.rows)]
        return out or [Records("", 0, 0)]

    def read(self, partition):
        if partition.first == partition.end:
            return
        known, head, width = fields(partition.shp)
        wanted = [next((f for f in known if f.name.lower() == n.lower()), None) for n in self.names[len(OWN) :]]
        cpg, dbf = sidecar(partition.shp, ".cpg"), sidecar(partition.shp, ".dbf")
        encoding = (open(cpg).read().strip() if cpg else "") or "utf-8"
        count = partition.end - partition.first
        with open(sidecar(partition.shp, ".shx"), "rb") as f:
            f.seek(100 + 8 * partition.first)
            index = struct.unpack(f">{2 * count}i", f.read(8 * count))
        with open(partition.shp, "rb") as f, open(dbf or os.devnull, "rb") as a:
            a.seek(head + width * partition.first if dbf else 0)
            for i in range(count):
                row = a.read(width)
                f.seek(2 * index[2 * i] + 8)
                shape = decode(f.read(2 * index[2 * i + 1]), self.bbox)
                if shape:
                    yield (partition.first + i, *shape, *[attribute(row[w.start : w.start + w.width], w.kind, encoding) if w else None for w in wanted])


def encode(kind: str | None, parts) -> bytes:
    """A record's content."""
    points = [(p["x"], p["y"]) for part in parts or [] for p in part]
    if kind is None or not points:
        return struct.pack("<i", 0)
    if kind not in CODES:
        raise ValueError(f"not a kind of shape: {kind}")
    xs, ys = zip(*points)
    head = struct.pack("<i4d", CODES[kind], min(xs), min(ys), max(xs), max(ys))
    flat = struct.pack(f"<{2 * len(points)}d", *[c for p in points for c in p])
    if kind == "point":
        return head + struct.pack("<i", len(points)) + flat
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
    return head + struct.pack(f"<2i{len(starts)}i", len(starts), len(points), *starts) + flat


def cell(value, letter: str, width: int) -> bytes:
    if value is None:
        return b" " * width
    if letter == "L":
        return b"T" if value else b"F"
    raw = (repr(float(value)) if isinstance(value, float) else str(value)).encode()
    if len(raw) > width:
        raise ValueError(f"{len(raw)} bytes don't fit a field of {width}")
    return raw.rjust(width) if letter == "N" else raw.ljust(width)


@dataclass
class Written(WriterCommitMessage):
    stem: str | None


class Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.prj, self.overwrite = options["path"].removeprefix("file://"), options.get("prj"), overwrite
        missing = {"kind", "parts"} - set(schema.names)
        if missing:
            raise ValueError(f"columns missing: {sorted(missing)}")
        letter = lambda t: "C" if isinstance(t, StringType) else "L" if isinstance(t, BooleanType) else "N"
        self.columns = [(f.name, letter(f.dataType), {"C": TEXT_WIDTH, "L": 1, "N": NUMBER_WIDTH}[letter(f.dataType)]) for f in schema.fields if f.name not in OWN]
        long = [n for n, _, _ in self.columns if len(n.encode()) > 10]
        if long:
            raise ValueError(f"names over 10 bytes: {long}")
        self.staging = os.path.join(self.path, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator):
        stem, files, n, at, kinds = f"part-{uuid.uuid4().hex}", None, 0, 50, {0}
        box = [float("inf")] * 2 + [float("-inf")] * 2
        for row in iterator:
            if files is None:
                os.makedirs(self.staging, exist_ok=True)
                files = {e: open(os.path.join(self.staging, stem + e), "wb") for e in (".shp", ".shx", ".dbf")}
                for e, size in ((".shp", 100), (".shx", 100), (".dbf", 33 + 32 * len(self.columns))):
                    files[e].write(b"\0" * size)
            body = encode(row["kind"], row["parts"])
            code = struct.unpack_from("<i", body)[0]
            kinds.add(code)
            if len(kinds) > 2:
                raise ValueError("one layer holds one kind of shape")
            if code:
                b = struct.unpack_from("<4d", body, 4)
                box = [*map(min, box[:2], b[:2]), *map(max, box[2:], b[2:])]
            files[".shp"].write(struct.pack(">2i", n + 1, len(body) // 2) + body)
            files[".shx"].write(struct.pack(">2i", at, len(body) // 2))
            files[".dbf"].write(b" " + b"".join(cell(row[c], k, w) for c, k, w in self.columns))
            n, at = n + 1, at + 4 + len(body) // 2
        if files is None:
            return Written(None)
        box = box if box[0] <= box[2] else [0.0] * 4
        for e, words in ((".shp", at), (".shx", 50 + 4 * n)):
            files[e].seek(0)
            files[e].write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, max(kinds), *box, 0, 0, 0, 0))
        head = struct.pack("<4BIHH20x", 3, 100, 1, 1, n, 33 + 32 * len(self.columns), 1 + sum(w for _, _, w in self.columns))
        body = b"".join(c.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes((w, 0)) + b"\0" * 14 for c, k, w in self.columns)
        files[".dbf"].seek(0)
        files[".dbf"].write(head + body + b"\r")
        for f in files.values():
            f.close()
        for e, text in ((".cpg", "UTF-8"), (".prj", self.prj)):
            if text:
                with open(os.path.join(self.staging, stem + e), "w") as f:
                    f.write(text)
        return Written(stem)

    def commit(self, messages):
        os.makedirs(self.path, exist_ok=True)
        old = [n for n in os.listdir(self.path) if n.startswith("part-")] if self.overwrite else []
        for stem in (m.stem for m in messages if m and m.stem):
            for name in os.listdir(self.staging):
                if name.startswith(stem):
                    os.replace(os.path.join(self.staging, name), os.path.join(self.path, name))
        for n in old:
            os.remove(os.path.join(self.path, n))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.staging, ignore_errors=True)


class Shapefile(DataSource):
    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        seen = {}
        for shp in layers(self.options["path"]):
            for f in fields(shp)[0]:
                seen.setdefault(f.name.lower(), StructField(f.name, f.type))
        return StructType([*SHAPE, *seen.values()])

    def reader(self, schema):
        return Reader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Shapefile)
    return spark
