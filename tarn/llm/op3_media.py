"""Media columns: texts stored as FLAC streams, read back as PCM blocks.

:func:`store` turns a binary or text column into a FLAC column; :func:`pcm_blocks`
decodes such a column to one row per frame with its seekable sample and byte
offsets, after checking the frame checksums; :func:`features` stores, reads back
and describes in one pass, so the stream isn't moved between Python workers.
Everything is row by row: no shuffle. A task holds one Arrow batch and codes
about ``BATCH`` bytes of payload at a time; a longer text is coded by itself, in
slices of frames.

Defined results: null and empty texts become 64 zero bytes; equal texts give
equal values; repeated rows are handled one by one; an empty table gives no rows;
extra columns are kept by :func:`store` (one with the name of its result gives way)
and dropped by the query; a damaged stream raises ``FlacError``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac
from .common import numbered, table

UNIT = 64
BATCH = 2_000_000


def payload(text: bytes) -> bytes:
    """``text`` with zero bytes up to a positive multiple of UNIT."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def slices(sizes: list[int], most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``most`` bytes."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if sizes:
        yield a, len(sizes)


def describe(samples: bytes) -> str:
    """Frame-free features of signed 8-bit samples, exact integers first."""
    x = (np.frombuffer(samples, np.uint8).astype(np.int16) - 128).astype(np.int8)
    wide = x.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};sum={int(wide.sum())};energy={int((wide * wide).sum())};peak={int(np.abs(wide).max())};crossings={crossings}"


def _bytes(column: pa.Array, a: int, b: int) -> list[bytes]:
    return [x or b"" for x in column.slice(a, b - a).to_pylist()]


def store(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``docs`` with the FLAC stream of each text's payload."""
    own = [(i, f) for i, f in enumerate(docs.schema.fields) if f.name != media_col]
    names = [f"c{i}" for i, _ in own]
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in own) + ", media binary"

    def code(batches):
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in text]
            done = [flac.encode([payload(t) for t in _bytes(text, a, b)]) for a, b in slices(sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s for part in done for s in part], pa.binary())], [*names, "media"])

    text = F.col(f"c{docs.columns.index(text_col)}").cast("binary").alias("bytes")
    return numbered(docs).select(*names, text).mapInArrow(code, schema.removeprefix(", ")).toDF(*[f.name for _, f in own], media_col)


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: id, block, sample_offset, byte_offset (in the stream), n_samples, pcm (signed bytes)."""
    kind = media.schema[id_col].dataType.simpleString()

    def read(batches):
        for batch in batches:
            ids, streams = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                s = streams[i].as_py()
                if s is None:
                    continue
                samples = flac.decode([s])[0]
                _, _, points, at = flac.seek_points(s)
                signed = (np.frombuffer(samples, np.uint8) ^ 0x80).tobytes()
                n = len(points)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i].as_py()] * n, ids.type), pa.array(range(n), pa.int32()), pa.array([p[0] for p in points], pa.int64()), pa.array([at + p[1] for p in points], pa.int64()), pa.array([p[2] for p in points], pa.int32()), pa.array([signed[p[0] : p[0] + p[2]] for p in points], pa.binary())],
                    [id_col, "block", "sample_offset", "byte_offset", "n_samples", "pcm"],
                )

    return media.select(id_col, media_col).mapInArrow(read, f"`{id_col}` {kind}, block int, sample_offset long, byte_offset long, n_samples int, pcm binary")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: sizes and checksums of the payload as read back, of the stored stream, and the features."""

    def run(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in text]
            for a, b in slices(sizes):
                streams = flac.encode([payload(t) for t in _bytes(text, a, b)])
                back = flac.decode(streams)
                cols = [
                    pa.array(sizes[a:b], pa.int64()),
                    pa.array([len(p) for p in back], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                    pa.array([zlib.crc32(p[-UNIT:]) for p in back], pa.int64()),
                    pa.array([len(s) for s in streams], pa.int64()),
                    pa.array([hashlib.sha256(s).hexdigest() for s in streams]),
                    pa.array([describe(p) for p in back]),
                ]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("bytes"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(table(spark, sf_dir, "documents"))
