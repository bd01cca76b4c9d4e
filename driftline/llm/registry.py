"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_tree, decontamination, license_scan, near_dedup, ngram_join, packing, periodic_runs, pii, prefix_trie, quality_rules, secret_scan, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_license_scans": license_scan.op1_license_scans, "op2_token_counts": token_counts.op2_token_counts, "op3_secret_scans": secret_scan.op3_secret_scans, "op4_best_fit_packing": packing.op4_best_fit_packing, "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination, "op6_toxicity": toxicity.op6_toxicity, "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup, "op8_quality_rules": quality_rules.op8_quality_rules, "op9_pii": pii.op9_pii, "op10_chat_formatting": chat_tree.op10_chat_formatting, "op11_ngram_jaccard_join": ngram_join.op11_ngram_jaccard_join, "op12_periodic_run_detection": periodic_runs.op12_periodic_run_detection, "op13_conversation_prefix_trie": prefix_trie.op13_conversation_prefix_trie}


def oracle_sql() -> dict[str, str]:
    return {"op7_minhash_near_dedup": near_dedup.ORACLE, "op8_quality_rules": quality_rules.ORACLE, "op10_chat_formatting": chat_tree.ORACLE, "op11_ngram_jaccard_join": ngram_join.ORACLE, "op12_periodic_run_detection": periodic_runs.ORACLE, "op13_conversation_prefix_trie": prefix_trie.ORACLE}
