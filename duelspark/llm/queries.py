"""Queries of this subpackage by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_text, decontaminate, exact_digest, licenses, line_dedup, lm_mix, near_dups, oracles, passages, quality, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files.op1_token_files,
    "op2_quality": quality.op2_quality,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_lm_scores": lm_mix.op4_lm_scores,
    "op5_passages": passages.op5_passages,
    "op6_licenses": licenses.op6_licenses,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_near_dups": near_dups.op8_near_dups,
    "op9_exact_digest": exact_digest.op9_exact_digest,
    "op10_bpe_text": bpe_text.op10_bpe_text,
}

ORACLES: dict[str, str] = {"op5_passages": oracles.PASSAGES, "op7_line_dedup": line_dedup.ORACLE_SQL, "op8_near_dups": oracles.NEAR_DUPS}
