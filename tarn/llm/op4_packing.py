"""Best-fit packing by length histogram.

Documents are tokenised once; pieces (a document, or 2048-token parts of a longer
one, its first part the shorter) are written as narrow rows. Only the histogram
of piece lengths, 2048 numbers at most, reaches the driver, where best-fit
decreasing runs over counts: bins with equal room are interchangeable, so a step
places all pieces of a length into the tightest room that takes them. The plan
is a list of runs (length, first rank) -> (sequence, offset); pieces are ranked
within their length and take the slot of their rank. Ranks come from bucketed
prefix sums, so a length that a third of all pieces share is spread over tasks.

Defined results: a null or empty text is the end token alone (one piece of
length 1); repeated rows are packed one by one; ties between equal pieces are
broken by a seeded hash of id, piece and checksum; very long texts are tokenised
whole; extra columns, whatever their names, are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, materialize, running_total, shuffle_key, table, unit_bucket

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
SEED = "pack-1"


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY):
    """text -> ids. The vocabulary's rank file gives the same ids as its tokenizers file, three times as fast; that file names the added
    tokens and, with a warning, serves a text that the other engine refuses (none is known)."""
    import json
    import logging

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
    added = {t["content"]: t["id"] for t in json.load(open(public_tokenizers.path(f"{name}.json"), encoding="utf-8"))["added_tokens"]}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode(text, allowed_special="all") if any(t in text for t in added) else fast.encode_ordinary(text), np.uint32)
        except ValueError as error:
            logging.getLogger("tarn").warning("a text of %d characters goes to the tokenizers file: %s", len(text), error)
            slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity when there are several."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            who, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                t = text[i].as_py() or ""
                tokens = np.append(encode(t), np.uint32(END)).astype("<u4")
                for k, (s, n) in enumerate(cut_points(len(tokens), capacity)):
                    who.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(tokens[s : s + n].tobytes()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces a bin, first sequence, offset) of best-fit decreasing over a histogram.

    Within a run rank r stands in sequence first + (r - first rank) // pieces, after the earlier pieces of that bin.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, how many)
    runs, opened = [], 0
    for n in sorted(counts, reverse=True):
        left, rank = counts[n], 0
        while left:
            fits = [r for r in room if r >= n]
            if fits:
                r = min(fits)
                first, bins = room[r].pop()
                if not room[r]:
                    del room[r]
            else:
                r = capacity
                first, bins = opened, -(-left // (capacity // n))
                opened += bins
            each = r // n
            used = min(bins, -(-left // each))
            runs.append((n, rank, each, first, capacity - r))
            placed = min(left, used * each)
            if used < bins:
                room.setdefault(r, []).append((first + used, bins - used))
            full = placed // each
            if full and r - each * n:
                room.setdefault(r - each * n, []).append((first, full))
            if full < used:  # the last bin got fewer
                room.setdefault(r - (placed - full * each) * n, []).append((first + full, 1))
            left -= placed
            rank += placed
    return runs


def place(ranked: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Rows with ``length`` and ``rank`` take the slot of their rank: sequence_id and offset."""
    plan = np.array(sorted(runs), np.int64).reshape(-1, 5)
    lookup = plan[:, 0] << 44 | plan[:, 1]
    names = [f.name for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{n}` {ranked.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"

    def run(batches):
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            p = plan[np.searchsorted(lookup, n.astype(np.int64) << 44 | rank, side="right") - 1]
            k = rank - p[:, 1]
            rest = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(p[:, 3] + k // p[:, 2], pa.int64()), pa.array(p[:, 4] + k % p[:, 2] * n, pa.int64())], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` with their sequence and offset."""
    pieces = materialize(tokenize(docs, id_col, text_col, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    runs = best_fit(counts, capacity)
    keys = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    p = pieces.withColumn("__key", shuffle_key(SEED, *keys)).withColumn("__b", unit_bucket(F.col("__key"), bucket_count(sum(counts.values()))))
    ranked = running_total(p, ["length"], "__b", [F.col("__key"), *keys], F.lit(1), "rank").drop("__key", "__b")
    return place(ranked, runs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
