"""The queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symdex.llm import chat_format, decontaminate, html_text, language_id, manifest, near_duplicates, quality_crf, quality_rules, secret_scan, set_join, source_divergence, token_codec, token_lengths

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_quality_classifier": quality_crf.op2_quality_classifier,
    "op3_language_id": language_id.op3_language_id,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_token_lengths": token_lengths.op5_token_lengths,
    "op6_html_main_text": html_text.op6_html_main_text,
    "op7_byte_bpe_codec": token_codec.op7_byte_bpe_codec,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_near_duplicates": near_duplicates.op9_near_duplicates,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_source_divergence": source_divergence.op12_source_divergence,
    "op13_jaccard_join": set_join.op13_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op10_chat_format": chat_format.OP10_SQL,
    "op11_merkle_manifest": manifest.OP11_SQL,
    "op12_source_divergence": source_divergence.OP12_SQL,
    "op4_benchmark_decontamination": decontaminate.OP4_SQL,
}
