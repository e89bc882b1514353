"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import corpus_pipeline

from . import op1_license_scan, op2_mixing, op3_media, op4_packing, op5_url_filter, op6_lm_score, op7_sharding, op8_toxicity, op9_exact_dedup, op10_jaccard_join

_MODULES = (op1_license_scan, op2_mixing, op3_media, op4_packing, op5_url_filter, op6_lm_score, op7_sharding, op8_toxicity, op9_exact_dedup, op10_jaccard_join)

QUERIES = {m.__name__.rpartition(".")[2]: m.query for m in _MODULES} | {"pipeline": corpus_pipeline.run}
SQL = {m.__name__.rpartition(".")[2]: m.SQL for m in _MODULES if getattr(m, "SQL", None)}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
