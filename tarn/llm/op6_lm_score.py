"""Language-model scoring: a word unigram base and online logistic context mixing.

1. Words and bytes are counted (by a dictionary of each batch's words, then by a partial and final sum).
2. One pass over the training texts: each task learns a mixing model online
   (:mod:`.mixing_model`) over its whole texts; the learners' tables are summed
   block by block in a tree (:func:`tarn.llm.common.tree_sum`). A model has one size whatever the
   corpus: five hashed tables of counts, which its contexts share.
3. Every text is coded by the model, bytes and end: score is its log10 probability,
   bits_per_byte the code length by byte; what a symbol costs is kept for the next
   one in the same case. In the same pass words with
   1 / ``HEAD`` of all tokens or more (so ``HEAD`` at most) are looked up in a
   broadcast table for the base; the others, none of which can be hot, are joined
   with the vocabulary and summed for each text.

Texts are lower-cased (A-Z). Training rows are those whose crc32 of the id's
text is not 2 modulo 7. Defined results: null and empty texts are the end token
alone; a null id counts as training; repeated rows are counted and scored one by
one; with no training rows c and N are 0 and each decision of the model has
probability 1/2; an empty table gives no rows; very long texts are read in pieces
and scored whole; extra columns, whatever their names, are ignored; scores are
rounded to 9 decimals. The model depends on how the table is dealt to tasks (not
on their order), as learning is online within a task.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, tree_sum
from .mixing_model import PAIRS, Coder, Learner, Model, added, pair_counts, pieces, runs

HEAD = 1 << 18
FLUSH = 300_000
SLICE, SLICE_BYTES = 1024, 1 << 22
# keys with a space are no words: " 65" is the symbol pair of that number, " e" the end
END_KEY = b" e"
_INSIDE = bytes(b not in b" \t\n\v\f\r" for b in range(256))  # by byte: 1 inside words


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _lower(value) -> bytes:
    return value.as_buffer().to_pybytes().lower() if value.is_valid else b""


def _sliced(batches, text: int = 0):
    """Slices of at most ``SLICE`` rows and, if they have several, about ``SLICE_BYTES`` bytes of texts (column ``text``)."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < b.num_rows:
            most = int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES, "right"))
            j = min(max(most, i + 1), i + SLICE)
            yield b.slice(i, j - i)
            i = j


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words of lower-cased texts, the number of each word in reading order, words of each text)."""
    joined = b" ".join((b"", *texts, b""))  # a space at both ends
    inside = np.frombuffer(joined.translate(_INSIDE), bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start = edges[::2]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(edges[1::2] - start, out=offsets[1:])
    data = np.frombuffer(joined, np.uint8)[inside]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return words.dictionary, words.indices.to_numpy(), np.diff(np.searchsorted(start, ends), prepend=0)


def _counted(words: pa.Array, *counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words, *(pa.array(c, pa.int64()) for c in counts)], ["word", "c", "total"])


def _merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Counts of the same word added."""
    words = pa.concat_arrays([p.column(0) for p in parts]).dictionary_encode()
    at, n = words.indices.to_numpy(), len(words.dictionary)
    return _counted(words.dictionary, *(np.bincount(at, np.concatenate([p.column(k) for p in parts]), n).astype(np.int64) for k in (1, 2)))


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, c, total): occurrences in training texts and in all; also of the end and, in training texts, of symbol pairs, by their keys."""

    def sent(b):
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), b.column(1), b.column(2)], b.schema.names)

    def run(batches):
        seen, ends, pairs = [], np.zeros(2, np.int64), np.zeros(PAIRS, np.int64)
        for batch in _sliced(batches):
            texts, held = [_lower(t) for t in batch.column(0)], np.array(batch.column(1).to_pylist(), bool)
            words, at, n = words_of(texts)
            seen.append(_counted(words, np.bincount(at[np.repeat(~held, n)], minlength=len(words)), np.bincount(at, minlength=len(words))))
            ends += (len(held) - held.sum(), len(held))
            pairs += pair_counts([t for t, h in zip(texts, held) if not h])
            if sum(b.num_rows for b in seen) > 2 * FLUSH:
                seen = [_merged(seen)]
                if seen[0].num_rows > FLUSH:
                    yield sent(seen.pop())
        if seen:
            yield sent(_merged(seen))
        if ends[1]:
            some = np.flatnonzero(pairs)
            keys = pa.array([END_KEY, *(b" %d" % i for i in some)], pa.binary())
            yield _counted(keys, np.append(ends[0], pairs[some]), np.append(ends[1], pairs[some]))

    part = docs.select(F.col(text_col).cast("binary").alias("t"), held_out(F.col(id_col)).alias("h")).mapInArrow(run, "word binary, c long, total long")
    return part.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def fit(docs: DataFrame, pairs: np.ndarray, id_col: str, text_col: str) -> Model:
    """The model of the training texts; what reaches the driver has the model's size."""

    coder = docs.sparkSession.sparkContext.broadcast(Coder(pairs))

    def learn(batches):
        learner = Learner(coder.value)
        for run in runs(p for b in _sliced(batches) for t in b.column(0) for p in pieces(_lower(t))):
            learner.learn(run)
        rows = list(learner.blocks())
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["block", "data"])

    train = docs.filter(~held_out(F.col(id_col))).select(F.col(text_col).cast("binary").alias("t"))
    states = tree_sum(train.mapInArrow(learn, "block int, data binary"), train.rdd.getNumPartitions(), added)
    return Model(coder.value, {r["block"]: bytes(r["data"]) for r in states.toLocalIterator()})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    vocabulary = materialize(count_words(docs, "id", "text").withColumn("special", F.position(F.lit(b" "), F.col("word")) > 0), "vocabulary")
    plain = vocabulary.filter("NOT special")
    special = {bytes(r["word"]): (r["c"], r["total"]) for r in vocabulary.filter("special").collect()}  # PAIRS + 1 keys at most
    sums = plain.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("total"), F.lit(0))).first()
    ends = special.get(END_KEY, (0, 0))[0]
    n, v = sums[0] + ends, sums[1] + (ends > 0)
    least = max(1, -(-sums[2] // head))
    pairs = np.zeros(PAIRS, np.int64)
    for key, (c, _) in special.items():
        if key != END_KEY:
            pairs[int(key)] = c
    model = spark.sparkContext.broadcast(fit(docs, pairs, "id", "text"))
    top = plain.filter(F.col("total") >= least).select("word", "c").toArrow()
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    known = spark.sparkContext.broadcast({w: base(c) for w, c in zip(top.column("word").to_pylist(), top.column("c").to_pylist())})
    schema = "row long, word binary, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bytes long"
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        get, never = known.value.get, base(0)
        for batch in _sliced(batches, 1):
            texts = [_lower(t) for t in batch.column(1)]
            words, at, n = words_of(texts)
            value = np.fromiter(map(get, words.to_numpy(zero_copy_only=False), repeat(math.nan)), float, len(words)).take(at)
            late, owner = np.isnan(value), np.repeat(np.arange(len(texts)), n)
            n_known = np.bincount(owner[~late & (value != never)], minlength=len(texts)) + int(ends > 0)
            b = np.bincount(owner, np.where(late, 0, value), len(texts)) + base(ends)
            i = batch.column(0)
            facts = [
                i,
                pa.array([b" %d" % x for x in i.to_pylist()], kinds[1]),  # the key is no word: it joins nothing
                pa.array(np.zeros(len(texts), np.int64)),
                batch.column(2),
                batch.column(3),
                pa.array(n + 1),
                pa.array(n_known),
                pa.array(b),
                pa.array(model.value.log10(texts)),
                pa.array([len(t) + 1 for t in texts], kinds[9]),
            ]
            yield pa.RecordBatch.from_arrays(facts, names)
            pair, times = np.unique(owner[late] * len(words) + at[late], return_counts=True)
            row, word = np.divmod(pair, max(1, len(words)))
            yield pa.RecordBatch.from_arrays([i.take(pa.array(row)), words.take(pa.array(word)).cast(kinds[1]), pa.array(times), *[pa.nulls(len(row), k) for k in kinds[3:]]], names)

    rows = docs.select(F.monotonically_increasing_id().alias("i"), F.col("text").cast("binary").alias("t"), F.col("id").cast("long").alias("d"), held_out(F.col("id")).alias("h"))
    rows = rows.mapInArrow(run, schema)
    tail = plain.filter(F.col("total") < least).select("word", "c")
    j = rows.join(tail, "word", "left")
    late = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    d = j.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, F.col("times")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base_score", F.col("times") * late)).alias("base_score"),
        F.max("score").alias("score"),
        F.max("bytes").alias("bytes"),
    )
    bits = -F.col("score") * F.lit(math.log2(10)) / F.col("bytes")
    return d.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.round("base_score", 9).alias("base_score"), F.round("score", 9).alias("score"), F.round(bits, 9).alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
