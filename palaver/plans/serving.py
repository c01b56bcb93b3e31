"""Queries on the registry, prompts by template, calls of models, sampling, result files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text
from palaver.operators import arena, calls, curate, detect, judge, prompts, ratings, serving
from palaver.plans import arena as arena_plans
from palaver.plans.arena import battles, log
from palaver.plans.detection import _conv, _style_sql
from palaver.plans.judging import _answers, _distinct
from palaver.plans.monitoring import _stream
from palaver.session import canonical_name, shared_dir, table
from palaver.sources import files
from palaver.streaming import monitor


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of the answering models but those whose name ends in a digit and b: the family is
    the simple name, the place is that of the name from the end of the alphabet."""
    names = table(spark, sf_dir, "model_answer").select(F.col("model_id").alias("model")).distinct().where("model not rlike '[13579]b$'")
    family = F.regexp_extract("model", "^([a-z]+)", 1)
    return names.select("model", family.alias("simple_name"), F.concat(F.lit("http://models.example/"), "model").alias("link"), F.concat(F.lit("a model of the "), family, F.lit(" family")).alias("description"), (-F.ascii("model")).alias("place"))


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return battles(spark, sf_dir).select(F.col("model_a").alias("model")).where("model is not null").distinct()


def model_cards(spark, sf_dir):
    return serving.model_cards(_models(spark, sf_dir).withColumn("o", F.col("model")), registry(spark, sf_dir), "o", "no description")


def model_priority(spark, sf_dir):
    return serving.by_priority(_models(spark, sf_dir), registry(spark, sf_dir))


def elo_model_info(spark, sf_dir):
    """Ratings with link and family of the model, where it is registered."""
    b = battles(spark, sf_dir).where("tstamp is not null and model_a <> model_b")
    rated = ratings.online_elo(b, ["tstamp", "battle_id"]).select("model", text.half_up("rating").alias("rating"))
    return serving.model_info(rated, registry(spark, sf_dir)).select("model", "rating", "simple_name", "link")


def _workers(spark, sf_dir):
    b = battles(spark, sf_dir).where("server is not null")
    return b.groupBy(F.col("server").alias("worker")).agg(F.collect_set(F.when(F.col("battle_id") % 3 == 0, F.col("model_a"))).alias("models"), F.lit(1.5).alias("speed"), F.count_if(F.col("turn") > 1).alias("queue"))


def worker_models(spark, sf_dir):
    wanted = _models(spark, sf_dir).where("model < 'k'")
    return serving.serving(_workers(spark, sf_dir), wanted)


def worker_status(spark, sf_dir):
    return serving.worker_status(_workers(spark, sf_dir)).select(F.array_join("models", ",").alias("models"), "speed", "queue")


def usage_totals(spark, sf_dir):
    """Words as tokens: those of the first prompt and of the first turn of every choice of an answer."""
    q = table(spark, sf_dir, "question").select("question_id", text.words(F.get("turns", F.lit(0))).alias("prompt_tokens"))
    a = table(spark, sf_dir, "model_answer").select("answer_id", "question_id", "choices").distinct()
    c = a.select(F.col("answer_id").alias("request"), "question_id", F.explode("choices").alias("c")).withColumn("completion_tokens", F.coalesce(text.words(F.coalesce(F.get("c.turns", F.lit(0)), F.lit(""))), F.lit(0)))
    return serving.usage(c.join(q, "question_id"))


def task_prompts(spark, sf_dir):
    """Each category is a task with two wordings of its instruction (none for the first letter m), its prompts are the instances."""
    q = table(spark, sf_dir, "question").where("category is not null")
    tasks = q.select(F.col("category").alias("task")).distinct()
    two = F.array(F.concat(F.lit("Answer this "), F.col("task"), F.lit(" question.")), F.concat(F.lit("Reply ("), F.col("task"), F.lit("):")))
    wordings = tasks.select("task", F.when(F.col("task").startswith("m"), F.array().cast("array<string>")).otherwise(two).alias("instructions"))
    instances = q.select(F.col("category").alias("task"), "question_id", F.get("turns", F.lit(0)).alias("input"))
    return serving.task_prompts(tasks, wordings, instances).select("task", "place", "question_id", "prompt")


STYLES = list(prompts.styles())


def prompt_by_template(spark, sf_dir):
    """Each battle's conversation by the template that its id names; every 13th name is unknown."""
    name = F.get(F.array(*[F.lit(x) for x in [*STYLES, "unknown"]]), (F.col("battle_id") % (len(STYLES) + 1)).cast("int"))
    shown = serving.rendered(F.col("m"), name, serving.templates(), "add_colon_single")
    return _conv(spark, sf_dir).select("battle_id", F.md5(shown).alias("digest"), F.char_length(shown).alias("chars"))


JUDGE_TEMPLATE = "[Question 1]\n{question_1}\n[A]\n{answer_a_1}\n[B]\n{answer_b_1}\n[Question 2]\n{question_2}\n[A]\n{answer_a_2}\n[B]\n{answer_b_2}\n[Reference]\n{ref}\n"


def judge_pair_prompts(spark, sf_dir):
    """The prompt of every match against a baseline, with both turns of both answers and the reference."""
    q = table(spark, sf_dir, "question")
    turns = table(spark, sf_dir, "model_answer").groupBy("question_id", "model_id").agg(F.max_by(F.get("choices", F.lit(0))["turns"], "answer_id").alias("turns"))
    m = judge.matches("baseline", _answers(spark, sf_dir), q, "heron-13b")
    a, b = (turns.select("question_id", F.col("model_id").alias(f"model_{k}"), F.col("turns").alias(f"t{k}")) for k in (1, 2))
    j = m.join(a, ["question_id", "model_1"]).join(b, ["question_id", "model_2"]).join(q.select("question_id", "turns", "reference"), "question_id")
    of = lambda c, k: F.get(c, F.lit(k))
    fields = {f"question_{k + 1}": of("turns", k) for k in (0, 1)} | {f"answer_{s}_{k + 1}": of(f"t{n}", k) for s, n in (("a", 1), ("b", 2)) for k in (0, 1)} | {"ref": of("reference", 0)}
    prompt = serving.fill(F.lit(JUDGE_TEMPLATE), fields)
    return j.select("question_id", "model_1", F.md5(prompt).alias("digest"), F.char_length(prompt).alias("chars"))


def judge_reference_join(spark, sf_dir):
    q = table(spark, sf_dir, "question")
    refs = q.where("reference is not null and size(reference) > 0").select(F.lit("judge-1").alias("judge"), "question_id", F.col("reference").alias("turns"), F.lit(0.0).alias("tstamp"))
    refs = refs.unionByName(refs.select(F.lit("judge-2").alias("judge"), "question_id", F.array(F.lit("other")).alias("turns"), F.lit(1.0).alias("tstamp")))
    m = judge.with_reference(judge.matches("single", _answers(spark, sf_dir), q), refs, "judge-1")
    return m.select("question_id", "model", "needs_ref", F.get("reference", F.lit(0)).alias("reference"))


def judge_vote_counts(spark, sf_dir):
    """Keys of the judgments and how many votes of a judging model each has."""
    return judge.vote_keys(judge.normalised(_distinct(spark, sf_dir)), "gpt4-pair")


def judge_called(spark, sf_dir):
    """A judge by a client: a stand-in that compares the lengths of two prompts, and fails on some."""

    def make():
        def client(requests: list) -> list:
            if any(r["a"] == r["b"] for r in requests):
                raise ValueError("equal prompts")
            return ["[[A]]" if len(r["a"]) > len(r["b"]) else "[[B]]" for r in requests]

        return client

    q = table(spark, sf_dir, "question").select("question_id", F.struct(F.get("turns", F.lit(0)).alias("a"), F.coalesce(F.get("turns", F.lit(1)), F.get("turns", F.lit(0))).alias("b")).alias("pair"))
    return calls.called(q, F.when(F.col("question_id") % 7 != 0, F.col("pair")), make, "verdict", attempts=1).select("question_id", "verdict")


def text_embedded(spark, sf_dir):
    """Sentence vectors by an encoder: a stand-in that counts a few letters."""

    def make():
        return lambda texts: [[float(t.count(x)) for x in "aeiou"] for t in texts]

    q = table(spark, sf_dir, "question").select("question_id", F.get("turns", F.lit(0)).alias("t"))
    return calls.embedded(q, "t", make).select("question_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ").alias("vector"))


def answer_scored(spark, sf_dir):
    """Rewards by a scorer: a stand-in that takes the share of the prompt's length, 0.0 for longer answers."""

    def make():
        return lambda pairs: [max(0.0, 1 - len(p["answer"]) / max(1, len(p["prompt"]))) for p in pairs]

    q = table(spark, sf_dir, "question").select("question_id", F.get("turns", F.lit(0)).alias("prompt"), F.get("reference", F.lit(0)).alias("answer"))
    return calls.scored(q, "prompt", "answer", make).select("question_id", F.round("reward", 6).alias("reward"))


def arena_anonymous_votes(spark, sf_dir):
    return log(spark, sf_dir).groupBy(arena.is_anonymous("models").alias("anonymous")).agg(F.count(F.lit(1)).alias("n"))


def arena_matrix_filled(spark, sf_dir):
    return arena.filled_matrix(battles(spark, sf_dir).where("winner is not null"))


def conv_take(spark, sf_dir):
    """A sampling operator: 50 rows of a seeded order."""
    return curate.shuffled_take(table(spark, sf_dir, "battles").select("battle_id"), "battle_id", 50, 7)


def conv_drawn(spark, sf_dir):
    """Rows with replacement."""
    return curate.drawn(table(spark, sf_dir, "battles").select("battle_id"), "battle_id", 3)


def elo_bootstrap_function(spark, sf_dir):
    """Three resamples under a rating function handed in: the share of wins on seat a."""
    rating = lambda r: r.groupBy("model_a").agg(F.avg(F.when(F.col("winner") == "model_a", 1.0).otherwise(0.0)).alias("rating"))
    return ratings.bootstrap(battles(spark, sf_dir).where("winner is not null").select("battle_id", "model_a", "winner"), rating, 3).select("round", "model_a", F.round("rating", 6).alias("rating"))


def elo_stream(spark, sf_dir):
    """The online Elo carried from batch to batch of a stream of battles."""
    b = _stream(spark, sf_dir, "battles").select("battle_id", "tstamp", canonical_name("model_a").alias("model_a"), canonical_name("model_b").alias("model_b"), "winner").where("tstamp is not null and model_a <> model_b")
    root = _folder(spark, "elo")
    q = b.writeStream.foreachBatch(monitor.elo_batches(f"{root}/ratings", ["tstamp", "battle_id"])).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/ratings/{q.lastProgress['batchId']}").withColumn("rating", F.round("rating", 6))


def stream_stop(spark, sf_dir):
    """Replies in chunks of 40 letters more each time, with the stop string ".\\n"."""
    b = table(spark, sf_dir, "model_answer").select("answer_id", F.get(F.get("choices", F.lit(0))["turns"], F.lit(0)).alias("t")).distinct().where("t <> ''")
    chunks = b.select("answer_id", F.explode(F.sequence(F.lit(1), F.ceil(F.char_length("t") / 40).cast("int"))).alias("seq"), "t").select("answer_id", "seq", F.substring("t", F.lit(1), F.col("seq") * 40).alias("text"))
    return monitor.stopped(chunks, "text", ".\n").groupBy("answer_id").agg(F.sum(F.char_length("shown")).alias("shown"), F.count_if("finished").alias("finished"))


def feature_sets(spark, sf_dir):
    """Columns of every named feature set."""
    columns = [c for c in files.FEATURES if c != "label"]
    rows = [(n, own, ",".join(detect.feature_set(n, columns, own))) for own, names in ((False, detect.FEATURE_SETS), (True, detect.OWN_FEATURE_SETS)) for n in (*names, "default")]
    return spark.createDataFrame(rows, "name string, own boolean, columns string")


def random_baseline(spark, sf_dir):
    b = table(spark, sf_dir, "battles").where("winner is not null").select("battle_id", (F.col("winner") == "model_a").cast("int").alias("label"))
    return detect.binary_metrics(detect.random_baseline(b, "battle_id")).select(*[F.round(c, 6).alias(c) for c in ("auc", "ap", "accuracy")])


def json_texts(spark, sf_dir):
    q = table(spark, sf_dir, "question").select("question_id", F.get("turns", F.lit(0)).alias("t"), "reference")
    return q.select("question_id", text.json_text("t").alias("json"), text.from_json_text(text.json_text("t")).alias("back"), text.first_gold("reference").alias("gold"))


def result_tables(spark, sf_dir):
    """Two results written under their names and read back."""
    root = _folder(spark, "results")
    b = battles(spark, sf_dir)
    files.write_results({"a": b.groupBy("model_a").count().toDF("model", "n"), "b": b.groupBy("model_b").count().toDF("model", "n")}, root)
    return serving_union(files.read_results(spark, root, ("a", "b")))


def serving_union(results: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select(F.lit(name).alias("side"), "model", "n") for name, df in results.items()]
    return parts[0].unionByName(parts[1])


def file_formats(spark, sf_dir):
    """Written and read back: one JSON array, its pretty form, a line list, a directory of prompts, values of a key, a split."""
    q = table(spark, sf_dir, "question").select("question_id", "category", "turns", "reference")
    root = _folder(spark, "formats")
    files.write_array(q.orderBy("question_id"), f"{root}/array")
    lines = files.json_lines(spark, f"{root}/array", files.QUESTION)
    q.select(F.concat(F.lit("  "), F.get("turns", F.lit(0)), F.lit(" ")).alias("value")).where("value not like '%\n%'").write.text(f"{root}/text")
    files.write_split(q.withColumn("part", F.when(F.col("question_id") % 2 == 0, "even").otherwise("odd")), f"{root}/split")
    spark.createDataFrame([(f"p{k % 2}", "single", "s", f"t{k}", "d", "c", "o") for k in range(4)], files.JUDGE_PROMPT).coalesce(1).write.json(f"{root}/prompts")
    judges = files.judge_prompts(spark, f"{root}/prompts")
    parts = [
        lines.agg(F.lit("array").alias("what"), F.count(F.lit(1)).alias("n"), F.sum("question_id").alias("total")),
        files.text_lines(spark, f"{root}/text").agg(F.lit("text").alias("what"), F.count(F.lit(1)).alias("n"), F.sum(F.char_length("line")).alias("total")),
        spark.read.json(f"{root}/split").where("part = 'even'").agg(F.lit("split").alias("what"), F.count(F.lit(1)).alias("n"), F.sum("question_id").alias("total")),
        files.key_values(q, "category").agg(F.lit("key").alias("what"), F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("total")),
        judges.agg(F.lit("prompts").alias("what"), F.count(F.lit(1)).alias("n"), F.sum(F.substring("prompt_template", 2, 9).cast("bigint")).alias("total")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stream_trailing(spark, sf_dir):
    """Sliding hours of the votes, each quarter."""
    from palaver.plans.monitoring import _run

    events = _stream(spark, sf_dir, "battles").where("tstamp is not null").select(F.timestamp_seconds("tstamp").alias("ts"))
    return _run(monitor.trailing(events, "ts"), "complete").select(F.unix_timestamp("until").alias("until"), "n")


def shortest_queue(spark, sf_dir):
    return monitor.shortest_queue(_workers(spark, sf_dir).withColumn("speed", F.ascii(F.substring("worker", -1, 1)).cast("double")))


def text_marks(spark, sf_dir):
    """Escapes inside code, marks beside ideographs, whole sentences, credentials."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    coded = F.concat(F.lit("a\\_b```c\\_d```e\\_f"), F.substring("text", 1, 20))
    return d.select("doc_id", text.unescape_in_code(coded).alias("code"), F.md5(text.cjk_marks(F.concat(F.lit("中,文! a,b 和?"), F.col("text")))).alias("marks"), text.complete_sentence("text").alias("whole"), F.size(text.credentials(F.concat(F.lit("a:b, c:d,"), F.coalesce("source", F.lit(""))))).alias("pairs"))


def arena_throughput(spark, sf_dir):
    b = table(spark, sf_dir, "battles").select(F.get("conversation_a", F.lit(0))["content"].alias("p"), F.get("conversation_a", F.lit(1))["content"].alias("a")).where("p is not null and a is not null")
    return arena.throughput(b, "p", "a", 100.0).select(F.round("words_per_second", 6).alias("words_per_second"))


def det_explode_tasks(spark, sf_dir):
    """Paraphrases with the instruction of their task; every eighth task is unknown."""
    names = [*detect.TASKS, "other"]
    q = table(spark, sf_dir, "question")
    sets = q.select(F.col("question_id").alias("id"), F.col("category").alias("gold"), F.array("turns").alias("questions"))
    rows = detect.exploded(sets).withColumn("task", F.get(F.array(*[F.lit(n) for n in names]), (F.col("id") % len(names)).cast("int")))
    return detect.with_instruction(rows, "task").select("id", "n", "task", "instruction")


def det_first_definition(spark, sf_dir):
    """The first question of each category; gold answers are looked at only afterwards."""
    q = table(spark, sf_dir, "question").where("category is not null").select(F.col("category").alias("definition"), "question_id", F.get("reference", F.lit(0)).alias("gold"))
    return judge.first_rows(q, ["definition"], ["question_id"]).where(detect.usable_gold()).select("definition", "question_id")


def det_line_contradiction(spark, sf_dir):
    """Embeddings as lines of answers, three each."""
    e = table(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 3).cast("bigint").alias("answer"), (F.col("vec_id") % 3).alias("line"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return detect.line_contradiction(e, "label", "answer", "v").withColumn("contradiction", F.round("contradiction", 5))


def det_masked_pool(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    p = detect.pooled(e, "label", "v", 64, F.col("vec_id") % 3 != 0)
    return p.select("label", *[F.round(F.get("vector", F.lit(k)), 5).alias(f"v{k}") for k in (0, 31, 63)])


def prompt_mask_checked(spark, sf_dir):
    """Label masks against the words of the prompt, one word too many for every fifth battle."""
    mask = prompts.label_mask(F.col("m"))
    words = F.aggregate(F.transform("m", lambda x: text.words(F.coalesce(x["content"], F.lit("")))), F.lit(0), lambda a, x: a + x) + F.when(F.col("battle_id") % 5 == 0, 1).otherwise(0)
    checked = prompts.checked_mask(mask, words)
    return _conv(spark, sf_dir).select("battle_id", F.size(checked).alias("words"), F.aggregate(checked, F.lit(0), lambda a, x: a + x).alias("kept"))


def judge_pair_winrate_listed(spark, sf_dir):
    r = judge.pair_win_rates(table(spark, sf_dir, "model_judgment"), models=["heron-13b", "lynx-7b", "ibis-30b", "civet-33b", "kestrel-xl"])
    return r.select("model", "win", "loss", "tie")


def serving_inputs(spark, sf_dir):
    """The text that goes on of each first message, and whether a stop of some kind is one."""
    stops = [None, "null", '"a"', '["a", "b"]', "3", '["a", 3]', "[]", '{"a": 1}']
    b = table(spark, sf_dir, "battles").select("battle_id", F.get("conversation_a", F.lit(0))["content"].alias("t"), F.get(F.array(*[F.lit(x).cast("string") for x in stops]), (F.col("battle_id") % len(stops)).cast("int")).alias("stop"))
    return b.select("battle_id", F.md5(text.guarded_text("t", 60)).alias("digest"), text.is_stop("stop").alias("stop"))


NAMES = ["det_explode_tasks", "det_first_definition", "det_line_contradiction", "det_masked_pool", "prompt_mask_checked", "judge_pair_winrate_listed", "serving_inputs", "model_cards", "model_priority", "elo_model_info", "worker_models", "worker_status", "usage_totals", "task_prompts", "prompt_by_template", "judge_pair_prompts", "judge_reference_join", "judge_vote_counts", "judge_called", "text_embedded", "answer_scored", "arena_anonymous_votes", "arena_matrix_filled", "conv_take", "conv_drawn", "elo_bootstrap_function", "elo_stream", "stream_stop", "feature_sets", "random_baseline", "json_texts", "result_tables", "file_formats", "stream_trailing", "shortest_queue", "text_marks", "arena_throughput"]
QUERIES = {n: globals()[n] for n in NAMES}

_B = "b AS (SELECT * REPLACE (nullif(lower(trim(model_a)), '') AS model_a, nullif(lower(trim(model_b)), '') AS model_b) FROM battles)"
_REG = "reg AS (SELECT DISTINCT model_id AS model, regexp_extract(model_id, '^([a-z]+)', 1) AS family, -ascii(model_id) AS place FROM model_answer WHERE NOT regexp_matches(model_id, '[13579]b$'))"
_MODELS = "m AS (SELECT DISTINCT model_a AS model FROM b WHERE model_a IS NOT NULL)"
_WORK = "w AS (SELECT server AS worker, list(DISTINCT model_a) FILTER (battle_id % 3 = 0 AND model_a IS NOT NULL) AS models, count(*) FILTER (turn > 1) AS queue FROM b WHERE server IS NOT NULL GROUP BY server)"
_PLACE = "('0x' || substr(md5('{}:' || {}), 1, 15))::BIGINT"
_LAST = "l AS (SELECT question_id, model_id, arg_max(choices[1].turns, answer_id) AS turns FROM model_answer GROUP BY ALL)"
_COLUMNS = "atypicality,entropy,token_probs,atypicality_avg,max_ratio,perplexity,neglog_probs"
_SETS = [("ALL", False, _COLUMNS), ("4_combination", False, "atypicality,entropy,token_probs,atypicality_avg"), ("atypicality", False, "atypicality"), ("entropy", False, "entropy"), ("token_probs", False, "token_probs"), ("perplexity", False, "perplexity"), ("atypicality_avg", False, "atypicality_avg"), ("atypicalities", False, "atypicality,atypicality_avg"), ("ALL_merges", False, _COLUMNS + ",contra_bert,contra_inter,entropy_self,max_ratio_self"), ("ALL_wo_selfGPT", False, "atypicality,entropy,token_probs,atypicality_avg,max_ratio,perplexity,entropy_self,max_ratio_self"), ("ALL_wo_selfcons", False, _COLUMNS + ",contra_bert,contra_inter"), ("default", False, _COLUMNS), ("self_consistency", True, "token_probs,atypicality_avg"), ("selfCheckGPT", True, "max_ratio,perplexity,neglog_probs"), ("default", True, _COLUMNS)]
_POISSON = "CASE " + " ".join(f"WHEN p < {limit} THEN {k}" for k, limit in enumerate(curate.poisson_limits())) + f" ELSE {len(curate.poisson_limits())} END"


def _fill_sql() -> str:
    q = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    value = {"question_1": "q.turns[1]", "question_2": "q.turns[2]", "answer_a_1": "a.turns[1]", "answer_a_2": "a.turns[2]", "answer_b_1": "b.turns[1]", "answer_b_2": "b.turns[2]", "ref": "q.reference[1]"}
    out, rest = [], JUDGE_TEMPLATE
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [q(head), f"coalesce({value[name]}, '')"]
    return " || ".join([*out, q(rest)])


# The fold of the online Elo in SQL, as in the arena queries.
_ELO = arena_plans.SQL["elo_online"]
SQL = {
    "elo_stream": _ELO,
    "det_explode_tasks": "WITH t AS (SELECT question_id AS id, unnest(range(len(turns)))::INT AS n, ['commonsense', 'arc', 'math', 'gsm8k', 'truthful', 'faviq', 'comqa', 'other'][question_id % 8 + 1] AS task FROM question) SELECT id, n, task, CASE WHEN task IN ('commonsense', 'arc') THEN 'Choose the right option.' WHEN task IN ('math', 'gsm8k') THEN 'Solve the problem.' WHEN task = 'truthful' THEN 'Answer truthfully.' WHEN task IN ('faviq', 'comqa') THEN 'Answer the question.' END AS instruction FROM t",
    "det_first_definition": "WITH f AS (SELECT category AS definition, question_id, reference[1] AS gold FROM question WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY question_id) = 1) SELECT definition, question_id FROM f WHERE coalesce(gold, '') <> '' AND NOT contains(gold, 'en.wikipedia.org')",
    "det_line_contradiction": "WITH v AS (SELECT label, vec_id // 3 AS a, vec_id, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT label, min(a) AS a0, arg_min(v, vec_id) AS v0 FROM v GROUP BY label), c AS (SELECT v.label, v.a, max(list_cosine_similarity(v.v, f.v0)) AS c FROM v JOIN f ON f.label = v.label AND v.a > f.a0 GROUP BY ALL) SELECT f.label, round(1 - avg(greatest(0.0::DOUBLE, c)), 5) AS contradiction FROM f LEFT JOIN c USING (label) GROUP BY f.label",
    "det_masked_pool": f"WITH m AS (SELECT label, {', '.join(f'avg(embedding[{k + 1}]::DOUBLE) AS a{k}' for k in range(64))} FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY label), n AS (SELECT *, sqrt({' + '.join(f'a{k} * a{k}' for k in range(64))}) AS norm FROM m) SELECT label, {', '.join(f'round(a{k} / norm, 5) AS v{k}' for k in (0, 31, 63))} FROM n",
    "prompt_mask_checked": "WITH r AS (SELECT battle_id, list_transform(conversation_a, lambda m: {'n': len(string_split(coalesce(m.content, ''), ' ')), 'a': m.role = 'assistant'}) AS x FROM battles) SELECT battle_id, (coalesce(list_sum(list_transform(x, lambda y: y.n)), 0) + (battle_id % 5 = 0)::INT)::INT AS words, CASE WHEN battle_id % 5 = 0 THEN 0 ELSE coalesce(list_sum(list_transform(x, lambda y: CASE WHEN y.a THEN y.n ELSE 0 END)), 0) END::INT AS kept FROM r",
    "judge_pair_winrate_listed": "WITH k AS (SELECT * FROM model_judgment WHERE model_1 IN ('heron-13b', 'lynx-7b', 'ibis-30b', 'civet-33b', 'kestrel-xl') AND model_2 IN ('heron-13b', 'lynx-7b', 'ibis-30b', 'civet-33b', 'kestrel-xl')), r AS (SELECT model_1, model_2, coalesce(g1_winner = 'tie' OR g1_winner <> g2_winner, true) OR g2_winner IS NULL AS t, coalesce(g1_winner = 'model_1', false) AS one FROM k), u AS (SELECT model_1 AS model, (NOT t AND one)::INT AS w, (NOT t AND NOT one)::INT AS l, t::INT AS t FROM r UNION ALL SELECT model_2, (NOT t AND NOT one)::INT, (NOT t AND one)::INT, t::INT FROM r) SELECT model, sum(w)::BIGINT AS win, sum(l)::BIGINT AS loss, sum(t)::BIGINT AS tie FROM u GROUP BY model",
    "serving_inputs": "SELECT battle_id, md5(substring(conversation_a[1].content, 1, 60)) AS digest, battle_id % 8 IN (0, 1, 2, 3, 6) AS stop FROM battles",
    "elo_model_info": f"WITH {_REG}, r AS ({_ELO}) SELECT r.model, floor(rating + 0.5)::INT AS rating, family AS simple_name, CASE WHEN family IS NOT NULL THEN 'http://models.example/' || r.model END AS link FROM r LEFT JOIN reg USING (model)",
    "model_cards": f"WITH {_B}, {_REG}, {_MODELS}, k AS (SELECT m.model, coalesce(family, m.model) AS s, CASE WHEN family IS NULL THEN m.model || ': no description' ELSE family || ': a model of the ' || family || ' family' END AS t FROM m LEFT JOIN reg USING (model)), f AS (SELECT s, arg_min(t, model) AS t, row_number() OVER (ORDER BY min(model)) - 1 AS n FROM k GROUP BY s) SELECT (n // 3)::INT AS row, (n % 3)::INT AS column, s AS simple_name, t AS text FROM f",
    "model_priority": f"WITH {_B}, {_REG}, {_MODELS} SELECT m.model, row_number() OVER (ORDER BY place NULLS LAST, m.model) AS priority FROM m LEFT JOIN reg USING (model)",
    "worker_models": f"WITH {_B}, {_WORK}, {_MODELS}, u AS (SELECT worker, unnest(models) AS model FROM w) SELECT model, worker FROM u JOIN m USING (model) WHERE model < 'k'",
    "worker_status": f"WITH {_B}, {_WORK} SELECT array_to_string(list_sort(list_distinct(flatten(list(models)))), ',') AS models, sum(1.5::DOUBLE) AS speed, sum(queue)::BIGINT AS queue FROM w",
    "usage_totals": "WITH a AS (SELECT DISTINCT answer_id, question_id, choices FROM model_answer), c AS (SELECT answer_id, question_id, unnest(choices) AS c FROM a) SELECT answer_id AS request, max(len(string_split(q.turns[1], ' ')))::INT AS prompt_tokens, sum(len(string_split(coalesce(c.turns[1], ''), ' ')))::BIGINT AS completion_tokens, (max(len(string_split(q.turns[1], ' '))) + sum(len(string_split(coalesce(c.turns[1], ''), ' '))))::BIGINT AS total_tokens FROM c JOIN question q USING (question_id) GROUP BY answer_id",
    "task_prompts": "WITH i AS (SELECT category AS task, question_id, turns[1] AS t, unnest([0, 1]) AS place FROM question WHERE category IS NOT NULL AND NOT starts_with(category, 'm')) SELECT task, place, question_id, CASE WHEN place = 0 THEN 'Answer this ' || task || ' question.' ELSE 'Reply (' || task || '):' END || chr(10) || t AS prompt FROM i",
    "prompt_by_template": " UNION ALL ".join(f"SELECT * FROM ({_style_sql(name)}) WHERE battle_id % {len(STYLES) + 1} IN ({k}{f', {len(STYLES)}' if name == 'add_colon_single' else ''})" for k, name in enumerate(STYLES)),
    "judge_pair_prompts": f"WITH {_LAST}, p AS (SELECT a.question_id, a.model_id AS model_1, {_fill_sql()} AS t FROM l a JOIN l b ON b.question_id = a.question_id AND b.model_id = 'heron-13b' JOIN question q ON q.question_id = a.question_id WHERE a.model_id <> 'heron-13b') SELECT question_id, model_1, md5(t) AS digest, length(t)::INT AS chars FROM p",
    "judge_reference_join": "WITH a AS (SELECT DISTINCT question_id, model_id FROM model_answer) SELECT question_id, model_id AS model, coalesce(category IN ('math', 'reasoning', 'coding'), false) AS needs_ref, CASE WHEN category IN ('math', 'reasoning', 'coding') THEN reference[1] END AS reference FROM a JOIN question USING (question_id)",
    "judge_vote_counts": "WITH d AS (SELECT DISTINCT * FROM model_judgment) SELECT question_id, coalesce(turn, 1) AS turn, least(model_1, model_2) AS model_1, greatest(model_1, model_2) AS model_2, count(*) FILTER (contains(judge[1], 'judge') OR contains(judge[1], 'gpt-4')) AS votes FROM d GROUP BY ALL",
    "judge_called": "SELECT question_id, CASE WHEN question_id % 7 = 0 THEN NULL WHEN turns[1] = coalesce(turns[2], turns[1]) THEN '$ERROR$' WHEN length(turns[1]) > length(turns[2]) THEN '[[A]]' ELSE '[[B]]' END AS verdict FROM question",
    "text_embedded": "SELECT question_id, " + " || ' ' || ".join(f"(length(turns[1]) - length(replace(turns[1], '{x}', '')))" for x in "aeiou") + " AS vector FROM question",
    "answer_scored": "SELECT question_id, CASE WHEN reference[1] IS NOT NULL AND turns[1] IS NOT NULL THEN round(greatest(0.0::DOUBLE, 1 - length(reference[1]) / greatest(1, length(turns[1]))::DOUBLE), 6) END AS reward FROM question",
    "arena_anonymous_votes": "SELECT anony AS anonymous, count(*) AS n FROM battles GROUP BY anony",
    "arena_matrix_filled": f"WITH {_B}, c AS (SELECT * FROM b WHERE winner IS NOT NULL), x AS (SELECT DISTINCT model_a FROM c), y AS (SELECT DISTINCT model_b FROM c), g AS (SELECT model_a, model_b, count(*) AS n, count(*) FILTER (winner = 'model_a') AS a_wins, count(*) FILTER (winner = 'model_b') AS b_wins FROM c GROUP BY ALL) SELECT x.model_a, y.model_b, coalesce(n, 0) AS n, coalesce(a_wins, 0) AS a_wins, coalesce(b_wins, 0) AS b_wins FROM x CROSS JOIN y LEFT JOIN g ON g.model_a = x.model_a AND g.model_b = y.model_b",
    "conv_take": f"SELECT battle_id FROM battles ORDER BY {_PLACE.format(7, 'battle_id')}, battle_id LIMIT 50",
    "conv_drawn": f"WITH p AS (SELECT battle_id, {_PLACE.format(3, 'battle_id')} AS p FROM battles) SELECT battle_id, ({_POISSON})::INT AS times FROM p WHERE times > 0",
    "elo_bootstrap_function": f"WITH {_B}, r AS (SELECT battle_id, model_a, winner, unnest([0, 1, 2]) AS round FROM b WHERE winner IS NOT NULL), p AS (SELECT *, ('0x' || substr(md5((42 + round) || ':' || battle_id), 1, 15))::BIGINT AS p FROM r), t AS (SELECT *, {_POISSON} AS times FROM p) SELECT round, model_a, round(sum(CASE WHEN winner = 'model_a' THEN times ELSE 0 END) / sum(times)::DOUBLE, 6) AS rating FROM t WHERE times > 0 GROUP BY ALL",
    "stream_stop": r"WITH b AS (SELECT DISTINCT answer_id, choices[1].turns[1] AS t FROM model_answer WHERE choices[1].turns[1] <> ''), s AS (SELECT answer_id, substring(t, 1, 40 * unnest(range(1, ceil(length(t) / 40.0)::INT + 1))::INT) AS x FROM b), c AS (SELECT answer_id, instr(x, '.' || chr(10)) AS k, x FROM s) SELECT answer_id, sum(CASE WHEN k > 0 THEN k - 1 WHEN ends_with(x, '.') THEN length(x) - 1 ELSE length(x) END)::BIGINT AS shown, count(*) FILTER (k > 0) AS finished FROM c GROUP BY answer_id",
    "feature_sets": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(own).lower()}, '{c}')" for n, own, c in _SETS) + ") v(name, own, columns)",
    "random_baseline": "WITH r AS (SELECT (winner = 'model_a')::INT AS y, (('0x' || substr(md5('7:' || battle_id), 1, 1))::INT >= 8)::INT AS p FROM battles WHERE winner IS NOT NULL), c AS (SELECT sum(y * p)::DOUBLE AS tp, sum((1 - y) * p)::DOUBLE AS fp, sum(y * (1 - p))::DOUBLE AS fn, sum((1 - y) * (1 - p))::DOUBLE AS tn FROM r) SELECT round(100 * (tp / (tp + fn) - fp / (fp + tn) + 1) / 2, 6) AS auc, round(100 * (tp / (tp + fn) * tp / (tp + fp) + (1 - tp / (tp + fn)) * (tp + fn) / (tp + fp + fn + tn)), 6) AS ap, round(100 * (tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c",
    "json_texts": "SELECT question_id, to_json(turns[1])::VARCHAR AS json, turns[1] AS back, CASE WHEN reference[1] IS NOT NULL THEN to_json(reference[1])::VARCHAR END AS gold FROM question",
    "result_tables": f"WITH {_B} SELECT 'a' AS side, model_a AS model, count(*) AS n FROM b GROUP BY model_a UNION ALL SELECT 'b', model_b, count(*) FROM b GROUP BY model_b",
    "file_formats": "SELECT 'array' AS what, count(*) AS n, sum(question_id)::BIGINT AS total FROM question UNION ALL SELECT 'text', count(*), sum(length(trim(turns[1])))::BIGINT FROM question WHERE NOT contains(turns[1], chr(10)) UNION ALL SELECT 'split', count(*), sum(question_id)::BIGINT FROM question WHERE question_id % 2 = 0 UNION ALL SELECT 'key', count(category), count(DISTINCT category) FROM question UNION ALL SELECT 'prompts', 2, 5",
    "stream_trailing": "WITH e AS (SELECT floor(tstamp / 900)::BIGINT AS q FROM battles WHERE tstamp IS NOT NULL), u AS (SELECT (q + unnest([1, 2, 3, 4])) * 900 AS until FROM e) SELECT until, count(*) AS n FROM u GROUP BY until",
    "shortest_queue": f"WITH {_B}, {_WORK} SELECT worker FROM w ORDER BY queue / ascii(right(worker, 1))::DOUBLE, worker LIMIT 1",
    "text_marks": r"SELECT doc_id, 'a\_b```c_d```e\_f' || substring(text, 1, 20) AS code, md5('中，文！ a,b 和？' || text) AS marks, regexp_matches(text, '[.!?…。！？\"”]\s*$') AS whole, CASE WHEN trim(coalesce(source, '')) = '' THEN 2 ELSE 3 END AS pairs FROM documents WHERE text IS NOT NULL",
    "arena_throughput": "SELECT round(sum(len(string_split(conversation_a[2].content, ' ')) - len(string_split(conversation_a[1].content, ' '))) / 100.0::DOUBLE, 6) AS words_per_second FROM battles WHERE conversation_a[1].content IS NOT NULL AND conversation_a[2].content IS NOT NULL",
}
