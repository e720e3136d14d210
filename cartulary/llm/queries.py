"""The operators' queries and their DuckDB statements, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_format, line_dedup, mixing, pii, quality_rules, simhash, token_count, toxicity, vp_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_count.query_op1,
    "op2_byte_bpe": byte_bpe.query_op2,
    "op3_vp_search": vp_search.query_op3,
    "op4_simhash": simhash.query_op4,
    "op5_quality_rules": quality_rules.query_op5,
    "op6_pii": pii.query_op6,
    "op7_chat_format": chat_format.query_op7,
    "op8_toxicity": toxicity.query_op8,
    "op9_line_dedup": line_dedup.query_op9,
    "op10_mixing": mixing.query_op10,
}

ORACLES: dict[str, str] = {
    "op3_vp_search": vp_search.SQL_OP3,
    "op7_chat_format": chat_format.SQL_OP7,
}
