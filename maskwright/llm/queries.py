"""Registry of the corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_extraction, jaccard_join, line_dedup, packing, pseudo_likelihood, quality, quality_classifier, sharding, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_packing": packing.op3_packing,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_quality_classifier": quality_classifier.op7_quality_classifier,
        "op8_pseudo_likelihood": pseudo_likelihood.op8_pseudo_likelihood,
        "op9_html_extraction": html_extraction.op9_html_extraction,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality.OP4_SQL,
    }
