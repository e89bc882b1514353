"""Clashing names, empty tables, ties and repeated rows for every operator and stage that carries columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import op1_license_scan, op2_mixing, op3_media, op4_packing, op5_url_filter, op7_sharding, op8_toxicity, op9_exact_dedup, op10_jaccard_join

from odd_rows import TEXTS, carried


def test_exact_dedup_carries_clashing_names(clashing):
    out = op9_exact_dedup.exact_dedup(clashing)
    assert out.columns == clashing.columns and carried(out) == 6
    assert op9_exact_dedup.exact_dedup(clashing.filter("false")).count() == 0


def test_near_dedup_carries_clashing_names(clashing):
    out = op10_jaccard_join.near_dedup(clashing)
    assert out.columns == clashing.columns and carried(out) == 7


def test_mixing_carries_clashing_names(clashing):
    out = op2_mixing.mix_rows(clashing)
    assert out.columns == clashing.columns and carried(out)
    assert op2_mixing.mix_rows(clashing.filter("false")).count() == 0


def test_license_scan_carries_clashing_names(clashing):
    out = op1_license_scan.scan(clashing)
    assert carried(out, ("n_words", "found", "spans")) == len(TEXTS)
    assert sorted(out.columns) == sorted(clashing.columns)
    assert op1_license_scan.scan(clashing.filter("false")).count() == 0


def test_media_carries_clashing_names(clashing):
    out = op3_media.store(clashing)
    assert carried(out, ("media",)) == len(TEXTS) and out.columns[-1] == "media"
    assert op3_media.store(clashing.filter("false")).count() == 0


def test_url_filter_carries_clashing_names(clashing):
    pages = clashing.withColumn("url", F.concat(F.lit("http://a.com/de/"), F.col("doc_id")))
    out = op5_url_filter.judge(pages)
    assert carried(out, ("host", "path", "rule", "verdict")) == len(TEXTS)


def test_sharding_carries_clashing_names(clashing):
    out = op7_sharding.shard_rows(clashing, "source", ["doc_id", "text"], shards=3)
    assert carried(out, ("shard", "slot")) == len(TEXTS)
    assert op7_sharding.shard_rows(clashing.filter("false"), "source", ["doc_id"]).count() == 0


def test_toxicity_carries_clashing_names(clashing):
    model = {"words": ["gamma"], "stems": [], "weights": [-2.0, 5.0, 0.0, 0.0, 0.0, 0.0]}
    out = op8_toxicity.clean(clashing, model)
    assert out.columns == clashing.columns and carried(out) == len(TEXTS) - 2
    assert carried(op8_toxicity.score_texts(clashing, model), ("score",)) == len(TEXTS)
    assert op8_toxicity.clean(clashing.filter("false"), model).count() == 0


def test_packing_drops_clashing_names(clashing):
    assert op4_packing.pack(clashing).count() == sum(1 for _ in TEXTS) + 2 * (30_001 // 2048)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_clashing_names_and_empty_tables(spark, tmp_path, clashing, name, stage):
    spark.createDataFrame([(1, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing.withColumns({"lang": F.lit("en"), "n_chars": F.length("text")})
    out = stage(spark, docs, str(tmp_path))
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert out.count() and stage(spark, docs.filter("false"), str(tmp_path)).count() == 0


def test_equal_rows_are_mixed_as_one_document(spark):
    # two equal rows of 10 words beside a large source: their source is passed three times
    big = [(i, f"{'w ' * 200}{i}", "a") for i in range(10)]
    rows = [*big, (100, "x " * 10, "b"), (100, "x " * 10, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = d.select("doc_id", "source", op2_mixing.count_words(F.col("text")).alias("size"), F.md5("text").alias("tie"))
    taken = sum(r["taken"] for r in op2_mixing.mix(sized).filter("doc_id = 100").collect())
    assert taken == 60
    n = Counter(r["doc_id"] for r in op2_mixing.mix_rows(d).collect())
    assert n[100] == 6


def test_dedup_of_ids_that_repeat(spark):
    rows = [(1, "same length a", 0), (1, "same length b", 1), (1, "same length a", 2), (2, "same length a", 3), (None, "SAME length b", 4), (None, "c", 5), (None, "c", 6), (3, "x" * 100 + "p", 7), (3, "x" * 100 + "q", 8), (4, "x" * 100 + "q", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, keep int")
    kept = sorted(r["keep"] for r in op9_exact_dedup.exact_dedup(d).collect())
    assert kept in ([1, 3, 5, 7, 9], [1, 3, 6, 7, 9])


def test_dedup_is_the_same_beyond_the_broadcast(spark, clashing, monkeypatch):
    from tarn.llm import common

    want = sorted(r["doc_id"] or 0 for r in op9_exact_dedup.exact_dedup(clashing).collect())
    near = sorted(r["doc_id"] or 0 for r in op10_jaccard_join.near_dedup(clashing).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(r["doc_id"] or 0 for r in op9_exact_dedup.exact_dedup(clashing).collect()) == want
    assert sorted(r["doc_id"] or 0 for r in op10_jaccard_join.near_dedup(clashing).collect()) == near
