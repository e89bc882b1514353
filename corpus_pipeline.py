"""A corpus pipeline: toxicity, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next stage's docs. All but the last return the
columns of ``documents``.

Defined results, in every stage: a null text counts as empty; very long texts are
read whole; of equal rows the dedup stages leave one, the others keep each; ties go
by doc_id, then by a hash of the text; a null doc_id loses against a number; extra
columns are carried, whatever their names, up to the last stage; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import op2_mixing, op4_packing, op8_toxicity, op9_exact_dedup, op10_jaccard_join
from tarn.llm.common import free, free_since, mark, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half stay."""
    model = op8_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return op8_toxicity.clean(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return op9_exact_dedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, Jaccard 0.8) the smallest doc_id stays; texts without words stay."""
    return op10_jaccard_join.near_dedup(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture passes more than half of it: sources near their targets, surplus ones cut."""
    return op2_mixing.mix_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their sequence and offset."""
    return op4_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

# toxicity and packing are models and tokenizers that SQL can't express; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        start = mark()
        done = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        free_since(start, done)  # the stage's own tables, and its input unless that is the given table
        free(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
