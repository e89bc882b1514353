"""URL filtering by association rules, in DataFrame and Spark ML (JVM) operations only.

Hand-written rules (host suffix and path prefix, longest first) give the labels:
every URL that such a rule decides is a labelled transaction of URL tokens.
FP-growth mines frequent token combinations together with the label; rules
``tokens -> label`` are pruned by support, by confidence and where a part of the
combination already says as much. Each kept rule is filed in an inverted index
under one of its tokens; a URL looks up its own tokens, and the best rule all of
whose tokens it has (confidence, then support, then text order) gives the verdict
of URLs that no hand-written rule decides. No rule: ``allow``.

Whole paths are tokenised and rules have any length. The number of rules depends on
``min_support`` and the URLs' tokens, not on the number of rows: a combination needs
its support of all transactions. While the index is short (``INDEX_RULES``) it is
part of the expression; a longer one is a table, joined on the token.

Defined results: a null URL or one without "://" has an empty host and path, no
rule and the verdict ``allow``; ties between mined rules go by text order, then
verdict; repeated rows are judged one by one; very long URLs are read whole; an
empty table, or one without a listed URL, mines no rules. Extra columns are
carried by :func:`judge`; one with the name of a result column gives way to it.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, numbered, table

# (verdict, rule): a rule's host is what stands before its first "/"
LIST = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.6
INDEX_RULES = 5_000
LABELS = ("@allow", "@block")


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def listed(host: Column, path: Column, rules=LIST) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct features: each label of the host, each path segment with its place and its digits folded, the path's depth and ending."""
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "9"), "/"), lambda s: s != "")
    return F.array_distinct(
        F.concat(
            F.transform(F.filter(F.split(host, r"\."), lambda s: s != ""), lambda s: F.concat(F.lit("h:"), s)),
            F.transform(segments, lambda s, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), s)),
            F.array(F.concat(F.lit("n:"), F.size(segments).cast("string")), F.concat(F.lit("e:"), F.when(path.endswith("/"), "/").otherwise(F.regexp_extract(path, r"\.([^./]+)$", 1)))),
        )
    )


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens array, verdict) -> rules (antecedent, verdict, confidence, support), none implied by a shorter one."""
    t = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("@"), F.col("verdict")))).alias("items"))
    t = t.repartition(max(1, t.sparkSession.sparkContext.defaultParallelism))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=t.rdd.getNumPartitions()).fit(t)
    r = model.associationRules.filter(F.col("consequent")[0].isin(*LABELS) & ~F.arrays_overlap("antecedent", F.array(*map(F.lit, LABELS))))
    r = r.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 9).alias("verdict"), F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"))
    r = materialize(r, "url-rules")
    part = r.select(F.explode("antecedent").alias("t"), "antecedent", "verdict", "confidence")
    longer = part.alias("a").join(part.alias("b"), ["t", "verdict"]).filter((F.size("a.antecedent") > F.size("b.antecedent")) & (F.col("a.confidence") <= F.col("b.confidence")) & (F.size(F.array_except("b.antecedent", "a.antecedent")) == 0))
    implied = longer.select(F.col("a.antecedent").alias("antecedent"), "verdict").distinct()
    return r.join(implied, ["antecedent", "verdict"], "left_anti")


def index_of(rules: list) -> str:
    """JSON of the inverted index {token: [rule, ...]}: a rule stands under its first token."""
    by: dict[str, list[dict]] = {}
    for r in rules:
        by.setdefault(r["antecedent"][0], []).append({"need": list(r["antecedent"]), "verdict": r["verdict"], "confidence": r["confidence"], "support": r["support"]})
    return json.dumps({k: by[k] for k in sorted(by)})


def best_rule(tokens: str, index: str) -> Column:
    """struct(confidence, support, text, verdict) of the best mined rule whose tokens are all in the column ``tokens``, else null."""
    kind = "map<string,array<struct<need:array<string>,verdict:string,confidence:double,support:double>>>"
    quoted = index.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"""
      array_max(transform(filter(
        flatten(transform(filter({tokens}, t -> map_contains_key(from_json('{quoted}', '{kind}'), t)), t -> from_json('{quoted}', '{kind}')[t])),
        r -> size(array_except(r.need, {tokens})) = 0),
        r -> struct(r.confidence, r.support, array_join(r.need, ' ') AS rule_text, r.verdict)))""")


def with_best(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (tokens, open) with ``best`` as of :func:`best_rule` where open, else null."""
    head = rules.limit(INDEX_RULES + 1).collect()
    if len(head) <= INDEX_RULES:
        return urls.withColumn("best", F.when(F.col("open"), best_rule("tokens", index_of(head))))
    # distinct token lists look the index up, a row for each token and rule filed under it
    lists = urls.filter("open").select("tokens").distinct()
    filed = rules.select(F.element_at("antecedent", 1).alias("t"), "antecedent", "verdict", "confidence", "support")
    hits = lists.withColumn("t", F.explode("tokens")).join(filed, "t").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = hits.groupBy(F.col("tokens").alias("__of")).agg(F.max(F.struct("confidence", "support", F.array_join("antecedent", " ").alias("rule_text"), "verdict")).alias("best"))
    return urls.join(best, F.col("open") & (F.col("tokens") == F.col("__of")), "left").drop("__of")


def judge(pages: DataFrame, url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the mined rule (``mined_rule``, ``mined_confidence``)."""
    names = pages.columns
    p = numbered(pages)
    url = F.col(f"c{names.index(url_col)}")
    p = p.withColumns({"host": F.coalesce(host_of(url), F.lit("")), "path": F.coalesce(path_of(url), F.lit(""))})
    p = p.withColumns({"list": listed(F.col("host"), F.col("path")), "tokens": tokens_of(F.col("host"), F.col("path"))})
    labelled = p.filter(F.col("list").isNotNull()).select("tokens", F.col("list.verdict").alias("verdict"))
    p = p.withColumn("open", F.col("list").isNull() & (F.col("host") != ""))
    if labelled.isEmpty():
        p = p.withColumn("best", F.lit(None).cast("struct<confidence:double,support:double,rule_text:string,verdict:string>"))
    else:
        p = with_best(p, mine(labelled, min_support, min_confidence))
    result = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("list.rule"), "verdict": F.coalesce("list.verdict", "best.verdict", F.lit("allow")), "mined_rule": F.col("best.rule_text"), "mined_confidence": F.col("best.confidence")}
    return p.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in result], *[v.alias(k) for k, v in result.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    list_filter(string_split(regexp_replace(path, '[0-9]+', '9', 'g'), '/'), lambda s: s <> '') AS seg FROM u
), k AS (
  SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS listed,
    list_sort(list_distinct(list_concat(list_concat(
      list_transform(list_filter(string_split(host, '.'), lambda s: s <> ''), lambda s: 'h:' || s),
      list_transform(range(0, CAST(len(seg) AS BIGINT)), lambda i: 'p' || i || ':' || seg[i + 1])),
      ['n:' || len(seg), 'e:' || CASE WHEN ends_with(path, '/') THEN '/' ELSE regexp_extract(path, '\.([^./]+)$', 1) END]))) AS tok FROM r
), t AS (SELECT page_id, listed, unnest(tok) AS t FROM k
), combos AS (
  WITH RECURSIVE c(page_id, listed, c, last) AS (
    SELECT page_id, listed, [t], t FROM t UNION ALL SELECT c.page_id, c.listed, list_append(c.c, t.t), t.t FROM c JOIN t ON t.page_id = c.page_id AND t.t > c.last
  ) SELECT page_id, listed, c FROM c
), n AS (SELECT count(*) AS n FROM k WHERE listed IS NOT NULL
), f AS (
  SELECT c, v.v AS verdict, count(*) FILTER (WHERE listed = v.v) AS hits, count(*) AS total FROM combos, (VALUES ('allow'), ('block')) v(v) WHERE listed IS NOT NULL GROUP BY c, v.v
), g AS (
  SELECT c, verdict, round(hits::DOUBLE / total, 9) AS confidence, round(hits::DOUBLE / n, 9) AS support FROM f, n WHERE hits >= ceil(0.01::DOUBLE * n) AND hits::DOUBLE / total >= 0.6
), h AS (
  SELECT * FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.verdict = a.verdict AND len(b.c) < len(a.c) AND a.confidence <= b.confidence AND list_has_all(a.c, b.c))
), m AS (
  SELECT combos.page_id, h.confidence, h.support, array_to_string(h.c, ' ') AS txt, h.verdict,
    row_number() OVER (PARTITION BY combos.page_id ORDER BY h.confidence DESC, h.support DESC, array_to_string(h.c, ' ') DESC, h.verdict DESC) AS rn
  FROM combos JOIN h ON combos.c = h.c WHERE combos.listed IS NULL
)
SELECT k.page_id, k.host, k.path, k.rule, coalesce(k.listed, CASE WHEN k.host <> '' THEN m.verdict END, 'allow') AS verdict,
  CASE WHEN k.listed IS NULL AND k.host <> '' THEN m.txt END AS mined_rule, CASE WHEN k.listed IS NULL AND k.host <> '' THEN m.confidence END AS mined_confidence
FROM k LEFT JOIN m ON m.page_id = k.page_id AND m.rn = 1
"""
