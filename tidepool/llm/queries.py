"""The queries of this package, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, language_id, lm_scores, near_join, pii, quality, sharding, token_counts, top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": bpe.query,
    "op2_token_counts": token_counts.query,
    "op3_sharding": sharding.query,
    "op4_decontamination": decontaminate.query,
    "op5_top_k": top_k.query,
    "op6_ngram_jaccard_join": near_join.query,
    "op7_language_id": language_id.query,
    "op8_quality": quality.query,
    "op9_pii": pii.query,
    "op10_lm_scores": lm_scores.query,
}
ORACLE_SQL: dict[str, str] = {"op3_sharding": sharding.SQL, "op4_decontamination": decontaminate.SQL, "op5_top_k": top_k.SQL, "op6_ngram_jaccard_join": near_join.SQL}
