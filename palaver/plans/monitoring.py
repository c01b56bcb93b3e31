"""Streaming queries, driven to completion over the tables, and file-format queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text
from palaver.operators import detect
from palaver.session import canonical_name, materialise, shared_dir, ship, table
from palaver.sources import files
from palaver.streaming import monitor


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    ship(spark)
    schema = spark.read.parquet(path).schema
    folder = path if os.path.isdir(path) else sf_dir
    reader = spark.readStream.schema(schema)
    return reader.parquet(folder) if folder == path else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _run(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return its result as a table."""
    spark = df.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).outputMode("append").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{root}/out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")

    df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).outputMode(mode).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def stream_type_counts(spark, sf_dir):
    return _run(monitor.type_counts(_stream(spark, sf_dir, "battles").select("winner"), "winner"), "complete")


def stream_hourly(spark, sf_dir):
    events = _stream(spark, sf_dir, "battles").where("tstamp is not null").select(F.timestamp_seconds("tstamp").alias("ts"))
    return _run(monitor.hourly(events, "ts", late=None), "complete").select(F.unix_timestamp("hour").alias("hour"), "n")


def stream_leases(spark, sf_dir):
    events = _stream(spark, sf_dir, "battles").where("ip is not null and tstamp is not null").select("ip", "tstamp")
    return _run(monitor.lease_stream(events, "ip", "tstamp"), "append")


def _beats(spark, sf_dir):
    return table(spark, sf_dir, "battles").where("tstamp is not null").select(F.col("server").alias("worker"), F.col("tstamp").alias("at"), (F.char_length("server") % 3 + 1).cast("double").alias("speed"), F.coalesce("turn", F.lit(0)).cast("bigint").alias("queue"))


def registry_expiry(spark, sf_dir):
    beats = _beats(spark, sf_dir)
    now = beats.agg(F.max("at")).first()[0] or 0.0
    live = monitor.registry_batch(beats, now, 7 * 86_400.0)
    return live.select("worker", "last", "speed")


def registry_status(spark, sf_dir):
    beats = _beats(spark, sf_dir)
    now = beats.agg(F.max("at")).first()[0] or 0.0
    live = monitor.registry_batch(beats, now, 7 * 86_400.0)
    return live.agg(F.count(F.lit(1)).alias("workers"), F.sum("speed").alias("speed"))


def ip_leases(spark, sf_dir):
    return monitor.leases(table(spark, sf_dir, "battles").select("ip", "tstamp"), "ip", "tstamp").groupBy("ip").agg(F.count(F.lit(1)).alias("leases"), F.sum("events").alias("events"))


def _chunks(spark, sf_dir):
    """Cumulative chunks of the first reply, ten letters more each time."""
    b = table(spark, sf_dir, "battles").select("battle_id", F.get("conversation_a", F.lit(1))["content"].alias("t")).where("t <> ''")
    return b.select("battle_id", "t", F.explode(F.sequence(F.lit(1), F.ceil(F.char_length("t") / 200).cast("int"))).alias("seq")).select("battle_id", "seq", F.substring("t", F.lit(1), F.col("seq") * 200).alias("text"))


def stream_delta(spark, sf_dir):
    return monitor.deltas(_chunks(spark, sf_dir), "battle_id", "seq", "text").select("battle_id", "seq", "delta")


def stream_last_chunk(spark, sf_dir):
    return monitor.last_chunks(_chunks(spark, sf_dir), "battle_id", "seq", "text").select("battle_id", F.md5("text").alias("digest"), "chunks")


def file_round_trip(spark, sf_dir):
    """Questions written as JSON lines and read back with their schema."""
    q = table(spark, sf_dir, "question").select("question_id", "category", "turns", "reference")
    path = f"{shared_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    files.write_lines(q, path)
    return files.json_lines(spark, path, files.QUESTION).select("question_id", "category", F.array_join("turns", "|").alias("turns"))


def answer_directory(spark, sf_dir):
    """Answers written as one file per model, a question's answers in order of their ids, and read
    back by file name: the last line of a question counts."""
    a = table(spark, sf_dir, "model_answer").dropDuplicates(["answer_id"])
    path = f"{shared_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    a.select("question_id", "answer_id", "model_id", "choices", "tstamp").withColumn("m", F.col("model_id")).repartition("m").sortWithinPartitions("m", "answer_id").write.partitionBy("m").json(path)
    # the format names a file by its model: one rename for each
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}-named"))
    for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/m=*/*.json")):
        model = f.getPath().getParent().getName()[2:]
        fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}-named/{model}.jsonl"))
    read = files.answer_directory(spark, f"{path}-named")
    return read.select("model", "question_id", "answer_id")


def leaderboard_csv(spark, sf_dir):
    """The leaderboard file format, written and read back with its rounding rules."""
    rows = [("Model", "Arena Elo rating", "MT-bench (score)", "MT-bench (win rate %)", "MMLU", "License", "Link"), ("a-7b", "1050", "6.125", "45.25%", "0.4375", "open", "http://a.example"), ("b-13b", "-", "7.0", "-", "-", "open", "-"), ("c-1b", "990", "2.675", "12.5%", "0.1", "closed", "http://c.example")]
    path = f"{shared_dir(spark).rstrip('/')}/board-{uuid.uuid4().hex}"
    spark.createDataFrame([(",".join(r),) for r in rows], "value string").coalesce(1).write.text(path)
    return files.leaderboard_csv(spark, path)


def feature_csv(spark, sf_dir):
    q = table(spark, sf_dir, "question")
    path = f"{shared_dir(spark).rstrip('/')}/features-{uuid.uuid4().hex}"
    files.write_features(q.select(*[(F.col("question_id") * k / 4).cast("double").alias(c) for k, c in enumerate(files.FEATURES)]), path)
    return files.feature_csv(spark, path).select("entropy", "perplexity", "label")


def html_board(spark, sf_dir):
    b = table(spark, sf_dir, "battles").groupBy(canonical_name("model_a").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.max(F.lit(None).cast("string")).alias("link"))
    return files.html_rows(b)


def serving_guards(spark, sf_dir):
    b = table(spark, sf_dir, "battles").select("battle_id", F.get("conversation_a", F.lit(0))["content"].alias("t"), "turn")
    return b.select("battle_id", text.input_guard("t", "turn", cap=60).alias("guard"), text.request_error("turn", "turn", (F.col("battle_id") % 5 - 1).cast("double"), (F.col("battle_id") % 3 / 2.0)).alias("error"), text.fits(text.words("t"), F.lit(40), F.lit(60)).alias("fits"), text.context_length(F.lit(None).cast("int"), "turn").alias("context"))


def text_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", text.first_words("text").alias("first"), F.char_length(text.cut_at_stop("text", "\n")).alias("cut"), text.partial_stop("text", ".\n").alias("partial"), F.md5(text.tidy_answer("text")).alias("tidy"), text.basename(F.concat(F.lit("a/"), F.coalesce("source", F.lit("x")), F.lit("/"))).alias("base"), text.first_rule("text", [("assistant", "chat"), ("def ", "code")]).alias("rule"))


def quantised(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    vec = next(c for c, t in e.dtypes if t.startswith("array"))
    q = e.select("vec_id", F.transform(vec, lambda x: x.cast("double")).alias("v")).withColumn("q", text.quantise("v"))
    worst = F.array_max(F.zip_with("v", text.dequantise("q"), lambda a, b: F.abs(a - b)))
    return q.select(F.col("vec_id").alias("id"), F.array_join(F.transform("q.q", lambda x: x.cast("string")), " ").alias("codes"), (worst <= 0.501 * (F.array_max("v") - F.array_min("v")) / 255).alias("close"))


def top_models(spark, sf_dir):
    """A weighted pick from the model list at one half."""
    b = table(spark, sf_dir, "battles").groupBy(canonical_name("model_a").alias("model")).agg(F.count(F.lit(1)).cast("double").alias("w")).where("model is not null")
    return detect.weighted_pick(materialise(b), "w", "model", 0.5).select("model", "w")


NAMES = ["stream_type_counts", "stream_hourly", "stream_leases", "registry_expiry", "registry_status", "ip_leases", "stream_delta", "stream_last_chunk", "file_round_trip", "answer_directory", "leaderboard_csv", "feature_csv", "html_board", "serving_guards", "text_functions", "quantised", "top_models"]
QUERIES = {n: globals()[n] for n in NAMES}
_LIVE = "l AS (SELECT server AS worker, max(tstamp) AS last FROM battles WHERE tstamp IS NOT NULL GROUP BY server), v AS (SELECT worker, last, (length(worker) % 3 + 1)::DOUBLE AS speed FROM l WHERE last >= (SELECT max(tstamp) FROM battles) - 604800)"
_CH = "b AS (SELECT battle_id, conversation_a[2].content AS t FROM battles WHERE conversation_a[2].content <> ''), s AS (SELECT battle_id, t, unnest(range(1, ceil(length(t) / 200.0)::INT + 1))::INT AS seq FROM b)"
_LEASE = """RECURSIVE o AS (SELECT ip, tstamp AS t FROM battles WHERE ip IS NOT NULL AND tstamp IS NOT NULL), f AS (SELECT ip, min(t) AS s FROM o GROUP BY ip UNION ALL SELECT f.ip, (SELECT min(o.t) FROM o WHERE o.ip = f.ip AND o.t >= f.s + 3600) AS s FROM f WHERE (SELECT min(o.t) FROM o WHERE o.ip = f.ip AND o.t >= f.s + 3600) IS NOT NULL)"""
SQL = {
    "stream_type_counts": "SELECT winner, count(*) AS n FROM battles GROUP BY winner",
    "stream_hourly": "SELECT epoch(date_trunc('hour', to_timestamp(tstamp)))::BIGINT AS hour, count(*) AS n FROM battles WHERE tstamp IS NOT NULL GROUP BY 1",
    "stream_leases": f"WITH {_LEASE} SELECT ip, s AS start FROM f",
    "registry_expiry": f"WITH {_LIVE} SELECT worker, last, speed FROM v",
    "registry_status": f"WITH {_LIVE} SELECT count(*) AS workers, sum(speed) AS speed FROM v",
    "ip_leases": f"WITH {_LEASE}, n AS (SELECT ip, count(*) AS events FROM o GROUP BY ip) SELECT f.ip, count(*) AS leases, any_value(n.events) AS events FROM f JOIN n USING (ip) GROUP BY f.ip",
    "stream_delta": f"WITH {_CH} SELECT battle_id, seq, substring(t, (seq - 1) * 200 + 1, 200) AS delta FROM s",
    "stream_last_chunk": f"WITH {_CH} SELECT battle_id, md5(any_value(t)) AS digest, count(*) AS chunks FROM s GROUP BY battle_id",
    "file_round_trip": "SELECT question_id, category, array_to_string(turns, '|') AS turns FROM question",
    "answer_directory": "SELECT model_id AS model, question_id, max(answer_id) AS answer_id FROM model_answer GROUP BY ALL",
    "leaderboard_csv": """SELECT * FROM (VALUES ('<a target="_blank" href="http://a.example">a-7b</a>', 1050, 6.12::DOUBLE, 45.2::DOUBLE, 43.8::DOUBLE, 'open'), ('b-13b', NULL, 7.0::DOUBLE, NULL, NULL, 'open'), ('<a target="_blank" href="http://c.example">c-1b</a>', 990, 2.67::DOUBLE, 12.5::DOUBLE, 10.0::DOUBLE, 'closed')) v(model, elo, score, win_rate, mmlu, license)""",
    "feature_csv": "SELECT question_id * 1 / 4.0::DOUBLE AS entropy, question_id * 5 / 4.0::DOUBLE AS perplexity, question_id * 11 / 4.0::DOUBLE AS label FROM question",
    "html_board": "SELECT '<tr><td>' || coalesce(m, '-') || '</td><td>' || count(*) || '</td><td>-</td></tr>' AS html FROM (SELECT lower(trim(model_a)) AS m FROM battles) GROUP BY m",
    "serving_guards": "WITH b AS (SELECT battle_id, conversation_a[1].content AS t, turn FROM battles) SELECT battle_id, CASE WHEN length(trim(coalesce(t, ''))) = 0 THEN 'empty' WHEN turn >= 50 THEN 'turn_limit' WHEN length(t) > 60 THEN 'cut' ELSE 'ok' END AS guard, CASE WHEN turn <= 0 THEN 'max_tokens' WHEN battle_id % 5 - 1 < 0 OR battle_id % 5 - 1 > 2 THEN 'temperature' END AS error, len(string_split(t, ' ')) + 40 <= 60 AS fits, coalesce(turn, 2048) AS context FROM b",
    "text_functions": r"SELECT doc_id, array_to_string(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0b\f\r]+')[1:4], ' ') AS first, CASE WHEN contains(text, chr(10)) THEN instr(text, chr(10)) - 1 ELSE length(text) END::INT AS cut, ends_with(text, '.') OR ends_with(text, '.' || chr(10)) AS partial, md5(regexp_replace(regexp_replace(text, '(?m)^[ \t\n\x0b\f\r]*• ?', '- ', 'g'), '\n\n(\d+\. )', E'\n\\1', 'g')) AS tidy, regexp_extract('a/' || coalesce(source, 'x') || '/', '([^/]*)/?$', 1) AS base, CASE WHEN contains(lower(text), 'assistant') THEN 'chat' WHEN contains(lower(text), 'def ') THEN 'code' ELSE 'base' END AS rule FROM documents WHERE text IS NOT NULL",
    "quantised": "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings) SELECT id, array_to_string(list_transform(v, lambda x: CASE WHEN hi > lo THEN floor((x - lo) * (255 / (hi - lo)) + 0.5) ELSE floor(x - lo + 0.5) END::INT), ' ') AS codes, true AS close FROM e",
    "top_models": "WITH b AS (SELECT lower(trim(model_a)) AS model, count(*)::DOUBLE AS w FROM battles GROUP BY 1), c AS (SELECT *, sum(w) OVER (ORDER BY model) AS c, sum(w) OVER () AS t FROM b) SELECT model, w FROM c WHERE (c - w) / t <= 0.5 AND c / t > 0.5",
}
