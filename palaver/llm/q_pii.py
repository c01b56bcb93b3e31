"""Queries of the personal-data problem (2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.pii import find_in_messages
from palaver.session import table

SIDES = {"a": "conversation_a", "b": "conversation_b"}


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "battles").select("battle_id", "conversation_a", "conversation_b")
    return find_in_messages(rows, ["battle_id"], SIDES).select("battle_id", F.explode("mentions").alias("m")).select("battle_id", "m.*")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).drop("mention")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both conversations of every battle with typed placeholders."""
    rows = table(spark, sf_dir, "battles").select("battle_id", "conversation_a", "conversation_b")
    return find_in_messages(rows, ["battle_id"], SIDES, replace=True).drop("mentions")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions and battles concerned, per type."""
    return _mentions(spark, sf_dir).groupBy("pii_type").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("battle_id").alias("battles"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p2_counts": p2_counts}
SQL: dict[str, str] = {}
