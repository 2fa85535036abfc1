"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimspark.llm import chains, chat, decontaminate, hosts, media, mixing, quality, simhash, suffix, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat.op1_query,
    "op2_toxicity": toxicity.op2_query,
    "op3_quality": quality.op3_query,
    "op4_media_columns": media.op4_query,
    "op5_simhash": simhash.op5_query,
    "op6_mixing": mixing.op6_query,
    "op7_suffix_array": suffix.op7_query,
    "op8_url_filters": hosts.op8_query,
    "op9_chained_passages": chains.op9_query,
    "op10_decontamination": decontaminate.op10_query,
}

ORACLES: dict[str, str] = {"op1_chat_formatting": chat.OP1_SQL, "op8_url_filters": hosts.OP8_SQL}
