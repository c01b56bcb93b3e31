"""Queries of the vote problems: consensus labels (3) and ranking (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.consensus import consensus
from palaver.llm.springrank import clean_votes, spring_rank
from palaver.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus(table(spark, sf_dir, "model_judgment"), min_annotators=3)
    return items.select("question_id", "turn", "model_1", "model_2", "winner")


def p3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus(table(spark, sf_dir, "model_judgment"))
    return items.withColumns({c: F.round(c, 6) for c in ("agreement", "observed")})


def p3_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, annotators = consensus(table(spark, sf_dir, "model_judgment"))
    return annotators.withColumns({c: F.round(c, 6) for c in ("reliability", "p_first", "p_second", "p_tie")})


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spring_rank(clean_votes(table(spark, sf_dir, "battles")))


QUERIES = {"p3_found": p3_found, "p3_items": p3_items, "p3_annotators": p3_annotators, "p6_ranking": p6_ranking}
SQL: dict[str, str] = {}
