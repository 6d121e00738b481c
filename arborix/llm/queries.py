"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, mixing, pii, quality_knn, quality_rules, sharding, simhash, substring_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_shard": sharding.op3_shard,
    "op4_language_id": language_id.op4_language_id,
    "op5_pii": pii.op5_pii,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_quality_knn": quality_knn.op10_quality_knn,
}

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": substring_dedup.oracle(), "op2_url_filter": url_filter.oracle(), "op3_shard": sharding.oracle()}
