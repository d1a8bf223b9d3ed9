"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm.chat_format import OP2_SQL, op2_chat_format
from codeatlas.llm.decontamination import op1_decontamination
from codeatlas.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from codeatlas.llm.importance import op4_importance_resampling
from codeatlas.llm.jaccard_join import op9_jaccard_join
from codeatlas.llm.language_id import op8_language_id
from codeatlas.llm.line_dedup import op3_line_dedup
from codeatlas.llm.packing import op6_best_fit_packing
from codeatlas.llm.token_count import op10_token_counts
from codeatlas.llm.url_filter import OP7_SQL, op7_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_line_dedup": op3_line_dedup,
    "op4_importance_resampling": op4_importance_resampling,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {"op2_chat_format": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op7_url_filter": OP7_SQL}
