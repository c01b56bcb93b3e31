"""Queries of the language problem (1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.languages import UNDETERMINED, Model, fit, label_code, read_conversations
from palaver.session import table


def battle_model(battles: DataFrame) -> Model:
    """Automata of the labelled conversations themselves."""
    text = F.array_join(F.transform("conversation_a", lambda m: m["content"]), "\n")
    return fit(battles.select("language", text.alias("text")), "text", "language")


def _read(spark: SparkSession, sf_dir: str, segments: bool) -> DataFrame:
    battles = table(spark, sf_dir, "battles")
    rows = battles.select("battle_id", F.col("conversation_a"), label_code("language").alias("label"))
    return read_conversations(rows, "conversation_a", battle_model(battles), ["battle_id", "label"], segments)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _read(spark, sf_dir, False).where(F.size("languages") > 0)
    wrong = ~F.col("label").eqNullSafe(F.col("first_language"))
    return read.where(wrong | (F.size("languages") > 1)).select("battle_id", F.explode("languages").alias("language"))


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every battle with its confidence and what is wrong with the label."""
    status = F.when(F.col("first_language") == UNDETERMINED, "undetermined").when(F.col("label").isNull(), "missing").when(F.col("label") != F.col("first_language"), "wrong").otherwise("right")
    return _read(spark, sf_dir, False).select("battle_id", F.col("first_language").alias("language"), F.col("first_confidence").alias("confidence"), "label", status.alias("status"), F.size("languages").alias("languages"))


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every message in one language."""
    return _read(spark, sf_dir, True).select("battle_id", F.explode("segments").alias("s")).select("battle_id", "s.*")


QUERIES = {"p1_found": p1_found, "p1_labels": p1_labels, "p1_segments": p1_segments}
SQL: dict[str, str] = {}
