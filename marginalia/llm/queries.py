"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, hard_negatives, language_id, lexical_rank, license_scan, line_dedup, mixing, near_dedup, ngram_join, secret_scan, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_language_id": language_id.op6_language_id,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_lexical_rank": lexical_rank.op13_lexical_rank,
}

ORACLE_SQL = {"op7_exact_dedup": exact_dedup.OP7_SQL, "op11_ngram_join": ngram_join.OP11_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL, "op13_lexical_rank": lexical_rank.OP13_SQL}
