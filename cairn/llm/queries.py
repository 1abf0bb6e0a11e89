"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import chat, decontamination, html_text, jaccard, language, oracles, packing, quality, secrets, simhash, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_quality": quality.op2_quality,
    "op3_fingerprints": simhash.op3_fingerprints,
    "op4_chat": chat.op4_chat,
    "op5_html_text": html_text.op5_html_text,
    "op6_language": language.op6_language,
    "op7_packing": packing.op7_packing,
    "op8_secrets": secrets.op8_secrets,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_jaccard": jaccard.op10_jaccard,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": oracles.OP1_DECONTAMINATION,
    "op4_chat": chat.OP4_SQL,
    "op9_suffix_dedup": oracles.OP9_SUFFIX_DEDUP,
    "op10_jaccard": oracles.OP10_JACCARD,
}
