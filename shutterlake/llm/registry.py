"""The corpus operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shutterlake.llm import conversations, decontaminate, filter_audit, language, ngram_join, packing, pseudonyms, substrings, token_counts, token_files, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.query,
    "op2_language_codes": language.query,
    "op3_token_counts": token_counts.query,
    "op4_exact_topk": topk.query,
    "op5_ngram_jaccard_join": ngram_join.query,
    "op6_merged_transform_dedup": substrings.query,
    "op7_format_preserving_pseudonyms": pseudonyms.query,
    "op8_spaced_seed_decontamination": decontaminate.query,
    "op9_warc_store": warc.query,
    "op10_toxicity": toxicity.query,
    "op11_conversation_repair": conversations.query,
    "op12_grammar_token_files": token_files.query,
    "op13_filter_audit": filter_audit.query,
}
ORACLE_SQL: dict[str, str] = {
    "op4_exact_topk": topk.SQL,
    "op5_ngram_jaccard_join": ngram_join.SQL,
    "op6_merged_transform_dedup": substrings.SQL,
    "op9_warc_store": warc.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
