"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, jaccard_join, language_id, licenses, line_dedup, lm_scoring, mixing, pii, sharding, suffix_dedup, vector_codes, whitening

_QUERIES = (
    pii.op1_pii,
    suffix_dedup.op2_suffix_dedup,
    lm_scoring.op3_lm_scoring,
    licenses.op4_licenses,
    decontaminate.op5_decontaminate,
    mixing.op6_mixing,
    ann.op7_ann,
    line_dedup.op8_line_dedup,
    jaccard_join.op9_jaccard_join,
    language_id.op10_language_id,
    vector_codes.op11_vector_codes,
    sharding.op12_sharding,
    whitening.op13_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are held against brute force or held-out accuracy in the tests."""
    return {"op8_line_dedup": line_dedup.SQL, "op9_jaccard_join": jaccard_join.SQL, "op11_vector_codes": vector_codes.SQL, "op12_sharding": sharding.SQL}
