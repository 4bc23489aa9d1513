"""Queries of this folder and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import op1_knn, op2_chat, op3_bpe_codec, op4_packing, op5_language, op6_licenses, op7_ngram_join
from tidelog.llm import op8_token_files, op9_quality_rules, op10_lm_score


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_voronoi_knn": op1_knn.query,
        "op2_chat_format": op2_chat.query,
        "op3_bpe_codec": op3_bpe_codec.query,
        "op4_packing": op4_packing.query,
        "op5_language_id": op5_language.query,
        "op6_license_scan": op6_licenses.query,
        "op7_ngram_jaccard": op7_ngram_join.query,
        "op8_token_files": op8_token_files.query,
        "op9_quality_rules": op9_quality_rules.query,
        "op10_lm_score": op10_lm_score.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_voronoi_knn": op1_knn.ORACLE_SQL,
        "op2_chat_format": op2_chat.ORACLE_SQL,
        "op7_ngram_jaccard": op7_ngram_join.ORACLE_SQL,
        "op10_lm_score": op10_lm_score.ORACLE_SQL,
    }
