"""Licence scan by ordered signature rules, row by row in SQL functions only.

A text is normalised to words; a keyword prefilter (one pass of one alternation)
lets most texts go at once. Where a keyword stands, the rules of that keyword
are tried on the words that follow (``WINDOW`` of them; no pattern is longer).
A detection whose word interval lies inside that of a better-ranked rule is
suppressed. There is no shuffle and no key, so repeated rows and hot sources
cost nothing extra.

Defined results: null and empty texts have no words and no detections (first
and last null, labels empty, score 0); detections of one rule at one place
count once, and of equal rank none suppresses another; very long texts are read
whole; repeated rows are scanned one by one; an empty table gives no rows. Extra
columns are ignored by the query and kept by :func:`scan`; one with the name of a
result column gives way to it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, numbered, table
from .license_rules import WINDOW, joined, rules

DETECTION = "array<struct<start:int,stop:int,rank:int,label:string,confidence:double,base:boolean>>"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Normalised words, single spaces between; null gives ''."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


def _rule_map() -> tuple[str, list[str], int]:
    by: dict[str, list[dict]] = {}
    for keyword, pattern, label, rank, confidence, base in rules():
        for k in (keyword, *joined(pattern)):
            by.setdefault(k, []).append({"p": f"^(?:{pattern}) ", "label": label, "rank": rank, "confidence": confidence, "base": base})
    return json.dumps(by), sorted(by), max(map(len, by.values()))


def detections(words: str) -> Column:
    """All detections in the column named ``words``: word intervals [start, stop) with rank, label and confidence."""
    by, keywords, _ = _rule_map()
    table_sql = "from_json('" + by.replace("\\", "\\\\").replace("'", "\\'") + "', 'map<string,array<struct<p:string,label:string,rank:int,confidence:double,base:boolean>>>')"
    at = f"array_join(slice(ws, i + 1, {WINDOW}), ' ') || ' '"
    one = f"""
      transform(array({at}), w ->
        filter(transform({table_sql}[ws[i]], r -> struct(i AS start,
            i + length(regexp_replace(regexp_extract(w, r.p, 0), '[^ ]+', '')) AS stop,
            r.rank AS rank, r.label AS label, r.confidence AS confidence, r.base AS base)),
          d -> d.stop > d.start))[0]"""
    known = ", ".join(f"'{k}'" for k in keywords)
    found = f"""
      transform(array(split({words}, ' ')), ws ->
        flatten(transform(filter(sequence(0, size(ws) - 1), i -> ws[i] IN ({known})), i -> {one})))[0]"""
    gate = f"{words} RLIKE '(?:^| )(?:{'|'.join(keywords)})(?: |$)'"
    return F.expr(f"CASE WHEN {gate} THEN {found} ELSE cast(array() AS {DETECTION}) END")


def survivors(found: str) -> Column:
    """Detections that lie in no interval of a better-ranked rule. Only neighbours can: an interval has ``WINDOW`` words at most."""
    reach = WINDOW * _rule_map()[2]
    return F.expr(f"""
      filter({found}, (d, j) -> NOT exists(slice({found}, greatest(1, j + 1 - {reach}), {2 * reach}),
        e -> e.rank < d.rank AND e.start <= d.start AND e.stop >= d.stop))""")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``found`` (all detections in text order) and ``spans`` (those that survive)."""
    names, d = docs.columns, numbered(docs)
    d = d.withColumn("words", words_of(F.col(f"c{names.index(text_col)}")))
    n = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.translate("words", " ", "")) + 1)
    d = d.withColumn("n_words", n.cast("long")).withColumn("found", detections("words")).withColumn("spans", survivors("found"))
    result = ("n_words", "found", "spans")
    return d.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in result], *result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.expr("filter(found, d -> d.base)")
    d = d.withColumn("base", base)
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base.label", "spans.label"))), ",").alias("labels"),
        F.coalesce(F.array_max("spans.confidence"), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    values = ",\n".join(f"({rank}, '{k}', '^(?:{p}) ', '{label}', {confidence}::DOUBLE, {str(base).upper()})" for k, p, label, rank, confidence, base in rules())
    return rf"""
WITH rules(rank, kw, p, label, confidence, base) AS (VALUES {values}),
n AS (
  SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS words FROM documents
), a AS (SELECT doc_id, CASE WHEN words = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(words, ' ') END AS ws FROM n
), w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM a
), k AS (SELECT doc_id, i, ws[i] AS kw, array_to_string(ws[i : i + {WINDOW - 1}], ' ') || ' ' AS win FROM w WHERE ws[i] IN (SELECT kw FROM rules)
), f AS (
  SELECT doc_id, i - 1 AS start, i - 1 + len(regexp_replace(regexp_extract(win, p), '[^ ]+', '', 'g')) AS stop, rank, label, confidence, base
  FROM k JOIN rules USING (kw) WHERE regexp_matches(win, p)
), s AS (
  SELECT * FROM f d WHERE NOT EXISTS (SELECT 1 FROM f e WHERE e.doc_id = d.doc_id AND e.rank < d.rank AND e.start <= d.start AND e.stop >= d.stop)
), b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f WHERE base GROUP BY doc_id
), l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM s UNION SELECT doc_id, label FROM f WHERE base) GROUP BY doc_id
), c AS (SELECT doc_id, max(confidence) AS score FROM s GROUP BY doc_id)
SELECT a.doc_id, CAST(len(a.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word,
  CAST(b.last_word AS BIGINT) AS last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(c.score, 0.0::DOUBLE) AS score
FROM a LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
"""


SQL = _sql()
