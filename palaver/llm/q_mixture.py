"""Queries of the mixture problem (8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.llm.mixture import mix, token_counts
from palaver.session import table


def p8_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[1]


def p8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"p8_chosen": p8_chosen, "p8_report": p8_report, "p8_tokens": p8_tokens}
SQL: dict[str, str] = {}
