"""Toxicity by a learned lexicon, misspelling-tolerant, with context windows.

1. Terms: in a bounded sample of labelled training rows (``SAMPLE``, those with
   the smallest seeded hash), words and word beginnings are counted by label;
   those that mark toxic texts and hardly ever clean ones form the lexicon.
2. Every whole text is scanned with a trie of the lexicon intersected with
   Levenshtein automata (:mod:`.lexicon`). A hit inside quotation marks or beside
   a reporting word (``WINDOW`` words each way) counts ``QUOTED`` of a plain hit.
3. A logistic regression over the hit scores, fitted on the sample, gives the score.

Training rows are those whose crc32 of the id's text is not 0 modulo 5. Labels,
lang, source and ids are never inputs of a score. Scanning is row by row; what is
sent to executors is the lexicon and a few weights; the lexicon has at most the
terms that ``LEAST_TOXIC`` texts of the sample share, whatever the corpus.

Defined results: null and empty texts score as texts without hits; a null id is
held out by no rule (crc32 of null is null) and reported as not held out; repeated
rows are scored one by one, and equal texts alike; without labelled rows of both
kinds the lexicon is empty and every score is 0; ties in the sample's order go by id
and label; very long texts are scanned whole; an empty table gives no rows. Extra
columns are kept by :func:`score_texts`; one with the name of its result gives way.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, numbered, shuffle_key, table
from .lexicon import EXACT, FUZZY, STEM, Matcher

SAMPLE = 12_000
LEAST_TOXIC = 6  # toxic sample texts that a term must be in
PRECISION = 0.95
STEM_FROM, STEM_TO = 4, 8
WINDOW = 6
KNOWN = 60_000  # words whose match is remembered
QUOTED = 0.4
WORD = re.compile(r"[^\W_]+")
QUOTES = "\"“”„«»"
REPORTING = frozenset("said says wrote writes quoted quote called reported sagte schrieb zitat dit écrit cité dijo escribió cita".split())
FEATURES = 5


def held_out(doc_id: Column, k: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % k == 0, F.lit(False))


def _count_terms(batches):
    """(term, stem?, toxic texts, clean texts) for each batch."""
    for batch in batches:
        counts = (Counter(), Counter()), (Counter(), Counter())  # [stem?][toxic?]
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(WORD.findall((text or "").lower()))
            counts[0][toxic].update(words)
            counts[1][toxic].update({w[:k] for w in words for k in range(STEM_FROM, min(STEM_TO, len(w) - 1) + 1)})
        rows = [(t, bool(s), counts[s][1][t], counts[s][0][t]) for s in (0, 1) for t in set(counts[s][0]) | set(counts[s][1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["term", "stem", "toxic", "clean"])


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled training ids."""
    ids = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int"))
    ids = ids.orderBy(shuffle_key("toxic-1", F.col("doc_id")), "doc_id", "toxic").limit(most)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic")


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """(words, stems) that tell toxic sample texts from clean ones."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return [], []
    t = sample.mapInArrow(_count_terms, "term string, stem boolean, toxic long, clean long").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = F.col("toxic") / F.lit(n[1])
    precise = rate / (rate + (F.col("clean") + 0.5) / F.lit(n[0]))
    t = t.filter((F.col("toxic") >= LEAST_TOXIC) & (precise >= PRECISION))
    rows = sorted(t.collect(), key=lambda r: (-r["toxic"], r["stem"], r["term"]))  # a part of the sample's words
    words = {r["term"]: r["toxic"] for r in rows if not r["stem"]}
    stems: list[str] = []
    covered: set[str] = set()
    for r in sorted((r for r in rows if r["stem"]), key=lambda r: (len(r["term"]), -r["toxic"], r["term"])):
        s = r["term"]
        if any(s.startswith(x) for x in stems):
            continue
        below = [w for w in words if w.startswith(s)]
        # a beginning that one word explains is that word
        if below and max(words[w] for w in below) >= 0.6 * r["toxic"]:
            continue
        if len(below) < 3:
            continue
        stems.append(s)
        covered.update(below)
    return sorted((w for w in words if w not in covered and len(w) > 2), key=lambda w: (-words[w], w)), stems


@lru_cache(maxsize=1)
def _matcher(words: tuple[str, ...], stems: tuple[str, ...]) -> tuple[Matcher, dict[str, int]]:
    return Matcher(list(words), list(stems)), {}


def text_features(text: str, matcher: Matcher, known: dict[str, int]) -> list[float]:
    """[exact, fuzzy, stem] context-weighted hits (log), any plain hit, hits for each word (log)."""
    low = text.lower()
    words = WORD.findall(low)
    if len(known) > KNOWN:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = matcher.match(w)
    hits = [i for i, w in enumerate(words) if known[w]]
    score = [0.0, 0.0, 0.0, 0.0]
    if hits:
        starts = [m.start() for m in WORD.finditer(low)]
        for i in hits:
            a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            before, after = low[starts[a] : starts[i]], low[starts[i] + len(words[i]) : starts[b - 1] + len(words[b - 1])]
            quoted = (any(q in before for q in QUOTES) and any(q in after for q in QUOTES)) or any(w in REPORTING for w in words[a:b])
            score[known[words[i]] - 1] += QUOTED if quoted else 1.0
            score[3] = max(score[3], 0.0 if quoted else 1.0)
    n = score[0] + score[1] + score[2]
    return [*np.log1p(score[:3]), score[3], float(np.log1p(100 * n / max(1, len(words))))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights (bias first) by damped Newton steps; classes weigh as they come."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    pen = ridge * np.eye(len(w))
    pen[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pen + 1e-9 * np.eye(len(w)), a.T @ (y - p) - pen @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: words, stems, weights."""
    sample = materialize(training_sample(docs, labels, id_col, text_col), "toxic-sample")
    words, stems = learn_lexicon(sample)
    if not words and not stems:
        return {"words": [], "stems": [], "weights": None}
    rows = _features(sample, "text", words, stems).groupBy("toxic", "f").count().collect()  # distinct feature rows of the sample
    x = np.array([r["f"] for r in rows], float)
    y = np.array([r["toxic"] for r in rows], float)
    n = np.array([r["count"] for r in rows])
    order = np.lexsort((*x.T, y))
    return {"words": words, "stems": stems, "weights": _logistic(np.repeat(x[order], n[order], 0), np.repeat(y[order], n[order])).tolist()}


def _features(df: DataFrame, text_col: str, words: list[str], stems: list[str]) -> DataFrame:
    w, s = tuple(words), tuple(stems)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        matcher, known = _matcher(w, s)
        return pa.array([text_features(t or "", matcher, known) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return df.withColumn("f", features(F.col(text_col)))


def score_texts(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each text."""
    if model["weights"] is None:
        return docs.withColumn(out, F.lit(0.0))
    w, s, weights = tuple(model["words"]), tuple(model["stems"]), np.array(model["weights"])

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        matcher, known = _matcher(w, s)
        z = np.array([weights[0] + np.dot(weights[1:], text_features(t or "", matcher, known)) for t in texts.to_pylist()], float)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out, score(F.col(text_col)))


def clean(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns, whatever their names."""
    d = numbered(docs)
    scored = score_texts(d, model, f"c{docs.columns.index(text_col)}", out="score")
    return scored.filter("score < 0.5").drop("score").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = score_texts(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
