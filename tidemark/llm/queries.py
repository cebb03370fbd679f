"""The registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import backoff, conversation_trie, decontaminate, html_text, jaccard_join, mixing, oracle, quality_rules, sharding, suffix_dedup, token_alignment, token_counts, topk, toxicity
from tidemark.llm.rows import ship


def _over(report: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return report(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": _over(suffix_dedup.report, "documents"),
        "op2_lm_scoring": _over(backoff.report, "documents"),
        "op3_decontamination": _over(decontaminate.report, "documents", "benchmark"),
        "op4_html_extraction": _over(html_text.report, "pages"),
        "op5_token_counts": _over(token_counts.report, "documents"),
        "op6_ngram_jaccard_join": _over(jaccard_join.report, "documents"),
        "op7_source_mixing": _over(mixing.report, "documents"),
        "op8_exact_topk": _over(topk.report, "embeddings"),
        "op9_sharding": _over(sharding.report, "documents"),
        "op10_toxicity": _over(toxicity.report, "documents", "labels"),
        "op11_token_alignment": _over(token_alignment.report, "documents"),
        "op12_quality_rules": _over(quality_rules.report, "documents", "labels"),
        "op13_conversation_trie": _over(conversation_trie.report, "conversations"),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
