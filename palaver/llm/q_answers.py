"""Queries of the answer problems: broken pairs (4) and truncated texts (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.answers import answer_turns, defects, hidden_limits
from palaver.llm.languages import fit
from palaver.session import table


def _defects(spark: SparkSession, sf_dir: str, languages: bool = True) -> DataFrame:
    answers, questions = table(spark, sf_dir, "model_answer"), table(spark, sf_dir, "question")
    model = fit(table(spark, sf_dir, "documents").select("lang", "text"), "text", "lang") if languages else None
    return defects(answers, questions, model, only_cut=not languages)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defects(spark, sf_dir).where("defect_type is not null").select("answer_id", "choice_index", "turn_index", "defect_type")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer turns of each model by kind of defect."""
    return _defects(spark, sf_dir).groupBy("model_id", F.coalesce("defect_type", F.lit("sound")).alias("defect_type")).agg(F.count(F.lit(1)).alias("turns"))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No language is read: a broken-off turn stays one, whatever language it is in."""
    return _defects(spark, sf_dir, languages=False)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).where("defect_type = 'truncated'").select("answer_id", "choice_index", "turn_index")


def p5_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken-off turn with the kind of its ending and the hidden limit of its source that its
    length has reached, if any (the measure of it)."""
    return _cut(spark, sf_dir).where("defect_type = 'truncated'").select("answer_id", "choice_index", "turn_index", "model_id", "kind", "at_limit")


def p5_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of broken-off turns of each model, and of those that end at a hidden limit."""
    broken = F.coalesce(F.col("defect_type") == "truncated", F.lit(False))
    return _cut(spark, sf_dir).groupBy("model_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(broken).alias("truncated"), F.count_if(broken & F.col("at_limit").isNotNull()).alias("at_limit"), F.round(F.avg(broken.cast("long")), 6).alias("share"))


def p5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden storage limits of each model."""
    return hidden_limits(answer_turns(table(spark, sf_dir, "model_answer"))).withColumnRenamed("source", "model_id")


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p5_found": p5_found, "p5_endings": p5_endings, "p5_sources": p5_sources, "p5_limits": p5_limits}
SQL: dict[str, str] = {}
