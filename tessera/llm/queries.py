"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontam, exact, html, langid, mixing, simhash, substring, suffix, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": langid.query,
    "op2_mixing": mixing.query,
    "op3_exact": exact.query,
    "op4_chat": chat.query,
    "op5_substring": substring.query,
    "op6_simhash": simhash.query,
    "op7_suffix": suffix.query,
    "op8_html": html.query,
    "op9_toxicity": toxicity.query,
    "op10_decontam": decontam.query,
}

ORACLES: dict[str, str] = {
    "op3_exact": exact.ORACLE,
    "op4_chat": chat.ORACLE,
}
