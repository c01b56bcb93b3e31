"""File sources and sinks: JSON arrays and lines, text, CSV, logs, result directories.

Every reader has an explicit schema where the format has one, so nothing is inferred by an
extra pass; columns and filters are pushed to the scan by Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions.text import exact_round, hyperlink

CONVERSATION = "id string, model string, conversations array<struct<from:string,value:string>>"
INSTRUCTION = "instruction string, input string, output string"
CHAT_LOG = "tstamp double, type string, model string, models array<string>, states array<struct<template_name:string,system:string,roles:array<string>,messages:array<array<string>>,offset:int,conv_id:string,model_name:string>>, ip string"
QUESTION = "question_id bigint, category string, turns array<string>, reference array<string>"
ANSWER = "question_id bigint, answer_id string, model_id string, choices array<struct<index:int,turns:array<string>>>, tstamp double"
JUDGE_PROMPT = "name string, type string, system_prompt string, prompt_template string, description string, category string, output_format string"
FEATURES = ("atypicality", "entropy", "token_probs", "atypicality_avg", "max_ratio", "perplexity", "neglog_probs", "contra_bert", "contra_inter", "entropy_self", "max_ratio_self", "label")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array; ``pos`` is the place in the file (one file is one task)."""
    return spark.read.option("multiLine", True).schema(schema).json(path).withColumn("pos", F.monotonically_increasing_id())


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a malformed line fails the read unless not ``strict``."""
    return spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(schema).json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line"))


def answer_directory(spark: SparkSession, path: str) -> DataFrame:
    """All answer files of a directory; the model is the file's name, the last line of a question counts."""
    rows = json_lines(spark, path, ANSWER).withColumn("model", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1)).withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_at", F.monotonically_increasing_id())
    # file order: by block of the file, then by place in the block
    last = F.row_number().over(W.partitionBy("model", "question_id").orderBy(F.desc("_block"), F.desc("_at")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "_at", "_block")


def model_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1).alias("model")).distinct()


def judge_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts by name, the last one counts."""
    rows = json_lines(spark, path, JUDGE_PROMPT).withColumn("_at", F.monotonically_increasing_id())
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy(F.desc("_at")))).where("_n = 1").drop("_n", "_at")


def log_files(root: str, servers: Iterable[int], days: Iterable[str], newest: int | None = None) -> list[str]:
    """Paths of the daily logs of all servers, by day; only the ``newest`` last ones if given."""
    paths = [f"{root}/server{s}/{d}-conv.json" for d in days for s in servers]
    return paths[-newest:] if newest else paths


def logs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Log events of the files that exist; ``server`` and ``day`` from the path."""
    rows = spark.read.option("ignoreMissingFiles", True).schema(CHAT_LOG).json(paths)
    name = F.col("_metadata.file_path")
    return rows.withColumn("server", F.regexp_extract(name, r"server(\d+)/", 1).cast("int")).withColumn("day", F.regexp_extract(name, r"/([\d-]+)-conv", 1)).withColumn("model", F.coalesce("model", F.lit(""))).withColumn("models", F.coalesce("models", F.array(F.lit(""), F.lit(""))))


def leaderboard_csv(spark: SparkSession, path: str, links: bool = True) -> DataFrame:
    """The leaderboard table; ``-`` is missing, names may become links, numbers are rounded."""
    t = spark.read.option("header", True).option("nullValue", "-").option("quote", "").csv(path)
    return leaderboard(t, links)


def leaderboard(t: DataFrame, links: bool = True) -> DataFrame:
    num = lambda c: F.col(f"`{c}`").try_cast("double")
    return t.select(
        (F.when(F.col("Link").isNotNull(), hyperlink("Model", "Link")).otherwise(F.col("Model")) if links else F.col("Model")).alias("model"),
        F.col("`Arena Elo rating`").try_cast("int").alias("elo"),
        exact_round(num("MT-bench (score)"), 2).alias("score"),
        exact_round(F.regexp_replace("`MT-bench (win rate %)`", "%$", "").try_cast("double"), 1).alias("win_rate"),
        exact_round(num("MMLU") * 100, 1).alias("mmlu"),
        F.col("License").alias("license"),
    ).orderBy(F.desc_nulls_last("elo"))


def feature_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} double" for c in FEATURES)).csv(path)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One row per line in one file; for small results (a report, a release sample)."""
    df.coalesce(1).write.mode(mode).json(path)


def write_features(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(*FEATURES).write.mode(mode).option("header", False).csv(path)


def write_split(df: DataFrame, path: str, part: str = "part", mode: str = "errorifexists") -> None:
    """One folder for each part, in one pass over the data."""
    df.write.mode(mode).partitionBy(part).json(path)


def pretty(spark: SparkSession, path: str, out: str, schema: str) -> None:
    """A JSON file read and written again, one row per line: the data stay as they are."""
    write_array(json_array(spark, path, schema).orderBy("pos").drop("pos"), out)


def write_results(results: dict[str, DataFrame], root: str, mode: str = "errorifexists") -> None:
    """Named results as one table each."""
    for name, df in results.items():
        df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def read_results(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in names}


def key_values(df: DataFrame, key: str) -> DataFrame:
    """The values of one key of all records that have it."""
    return df.select(F.col(key).alias("value")).where("value is not null")


def inspected(df: DataFrame, begin: int = 0, n: int = 5, pos: str = "pos") -> str:
    """Some rows as text for a console: a report of at most ``n`` rows from a place on."""
    rows = df.where((F.col(pos) >= begin) & (F.col(pos) < begin + n)).orderBy(pos).collect()
    return "\n".join(f"{c}: {r[c]}" for r in rows for c in df.columns)


def markdown_table(df: DataFrame, rows: int = 1000) -> str:
    """A small report as a markdown table."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect())])


def html_rows(df: DataFrame) -> DataFrame:
    """One HTML table row per row; missing values are ``-``."""
    cells = [F.concat(F.lit("<td>"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


