"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import chat, decontam, fill_middle, html_text, jaccard_join, license_scan, line_dedup, mixing, pii, quality, repair, secret_scan, simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1,
        "op2_secret_scan": secret_scan.op2,
        "op3_html_text": html_text.op3,
        "op4_pii_surrogates": pii.op4,
        "op5_mixing": mixing.op5,
        "op6_license_scan": license_scan.op6,
        "op7_decontamination": decontam.op7,
        "op8_quality_rules": quality.op8,
        "op9_jaccard_join": jaccard_join.op9,
        "op10_chat_formatting": chat.op10,
        "op11_conversation_repair": repair.op11,
        "op12_simhash": simhash.op12,
        "op13_fill_middle": fill_middle.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op5_mixing": mixing.SQL, "op6_license_scan": license_scan.SQL, "op9_jaccard_join": jaccard_join.SQL, "op10_chat_formatting": chat.SQL, "op11_conversation_repair": repair.SQL, "op13_fill_middle": fill_middle.SQL}
