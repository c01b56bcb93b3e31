"""Queries on texts and their forms: look-alikes and leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.leaks import leaked_passages
from palaver.llm.skeleton import equal_looking_pairs, look_classes, look_groups, with_skeleton
from palaver.session import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_looking_pairs(table(spark, sf_dir, "documents"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its consistent form."""
    return with_skeleton(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "skeleton")


def p9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks with more than one document: number of documents and of different texts."""
    g = look_groups(table(spark, sf_dir, "documents")).where("look is not null").groupBy("look", "form").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("first_id"))
    return g.groupBy("look").agg(F.min("first_id").alias("first_id"), F.sum("k").alias("documents"), F.count(F.lit(1)).alias("forms")).where("documents > 1").select("first_id", "documents", "forms")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that looks like a different one: its class, its form and the number of its links."""
    return look_classes(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked passage with its place and numbers of equal and altered words."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that leaked: number of documents and longest passage."""
    return p7_passages(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("equal").alias("longest"))


QUERIES = {"p7_found": p7_found, "p7_passages": p7_passages, "p7_items": p7_items, "p9_found": p9_found, "p9_forms": p9_forms, "p9_classes": p9_classes, "p9_groups": p9_groups}
SQL: dict[str, str] = {}
