"""Judge queries: matches, verdicts, win rates, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions import text, verdicts
from palaver.operators import judge
from palaver.session import join_side, table


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "model_judgment")


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judgments(spark, sf_dir).dropDuplicates()


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per question and model (the last by id) with the model's place in the list."""
    last = judge.last_rows(table(spark, sf_dir, "model_answer").select("answer_id", "question_id", "model_id").distinct(), ["question_id", "model_id"], ["answer_id"])
    names = last.select("model_id").distinct()
    place = names.withColumn("idx", F.row_number().over(W.orderBy("model_id")))  # a list of models
    return last.join(join_side(place, names.count()), "model_id")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single scores derived from the judgments, with -1 for some."""
    return _distinct(spark, sf_dir).select(F.col("model_1").alias("model"), F.coalesce("turn", F.lit(1)).alias("turn"), ((F.col("question_id") * 7 + F.char_length("model_2")) % 12 - 1).cast("double").alias("score"))


def judge_single_scores(spark, sf_dir):
    return judge.mean_scores(_scores(spark, sf_dir)).withColumn("score", F.round("score", 6))


def judge_pair_winrate(spark, sf_dir):
    return judge.pair_win_rates(_judgments(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("win_rate", "loss_rate", "win_rate_adjusted")})


def judge_pair_winrate_baseline(spark, sf_dir):
    return judge.pair_win_rates(_judgments(spark, sf_dir), "heron-13b").withColumns({c: F.round(c, 6) for c in ("win_rate", "loss_rate", "win_rate_adjusted")})


def judge_pair_winrate_strict(spark, sf_dir):
    return judge.pair_win_rates(_judgments(spark, sf_dir), strict=True).withColumns({c: F.round(c, 6) for c in ("win_rate", "loss_rate", "win_rate_adjusted")})


def judge_normalise_keys(spark, sf_dir):
    return judge.normalised(_judgments(spark, sf_dir))


def _agreement(spark, sf_dir):
    votes = judge.normalised(_distinct(spark, sf_dir))
    rows = []
    for name, families, ban in (("judge_human", ("gpt4-pair", "human"), False), ("judge_human_no_ties", ("gpt4-pair", "human"), True), ("human_human", ("human", "human"), False), ("human_human_no_ties", ("human", "human"), True)):
        rows.append(judge.agreement(votes, families, ban).select(F.lit(name).alias("what"), "agree", "total", F.round("agreement", 6).alias("agreement")))
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def judge_agreement(spark, sf_dir):
    return _agreement(spark, sf_dir)


def judge_dedup_clean(spark, sf_dir):
    models = ["heron-13b", "lynx-7b", "civet-33b", "ibis-30b", "kestrel-xl"]
    rows = judge.deduplicated(_judgments(spark, sf_dir), ["tstamp", "turn", "g1_winner", "g2_winner", F.coalesce("g1_judgment", F.lit(""))], models)
    return rows.select("question_id", "model_1", "model_2", "judge_key", "tstamp").orderBy("model_1", "question_id", "model_2", "judge_key")


def judge_missing_models(spark, sf_dir):
    models = table(spark, sf_dir, "model_answer").select(F.col("model_id").alias("model")).distinct()
    return judge.missing_models(_judgments(spark, sf_dir).where("judge[0] = 'author_1'"), models)


def judge_matches_all_pairs(spark, sf_dir):
    return judge.matches_all_pairs(_answers(spark, sf_dir), table(spark, sf_dir, "question")).withColumn("needs_ref", F.coalesce("needs_ref", F.lit(False)))


def judge_matches_multi_turn(spark, sf_dir):
    return judge.matches_all_pairs(_answers(spark, sf_dir), table(spark, sf_dir, "question"), True).select("question_id", "model_1", "model_2")


def judge_matches_baseline(spark, sf_dir):
    return judge.matches_baseline(_answers(spark, sf_dir), table(spark, sf_dir, "question"), "heron-13b")


def judge_matches_single(spark, sf_dir):
    return judge.matches_single(_answers(spark, sf_dir), table(spark, sf_dir, "question"))


def judge_match_union(spark, sf_dir):
    """The four lists of matches of one run, told apart by kind."""
    a, q = _answers(spark, sf_dir), table(spark, sf_dir, "question")
    single = judge.matches_single(a, q)
    lists = [("single", single), ("single_ref", single.where("needs_ref"))]
    pairs = judge.matches_baseline(a, q, "heron-13b").select("question_id", F.col("model_1").alias("model"), "needs_ref")
    lists += [("pair", pairs.where("not needs_ref")), ("pair_ref", pairs.where("needs_ref"))]
    out = None
    for kind, df in lists:
        part = df.select("question_id", "model", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def judge_missing_answers(spark, sf_dir):
    a = _answers(spark, sf_dir)
    models = a.select("model_id").distinct()
    return judge.missing_answers(a, table(spark, sf_dir, "question"), models)


def judge_parse_verdicts(spark, sf_dir):
    j = _distinct(spark, sf_dir).where("g1_judgment is not null")
    mark1, mark2 = verdicts.verdict("g1_judgment"), verdicts.verdict("g2_judgment")
    return j.select("question_id", "model_1", "model_2", "tstamp", mark1.alias("mark_1"), verdicts.game_winner(mark1, 1).alias("game_1"), verdicts.game_winner(mark2, 2).alias("game_2"))


def judge_parse_scores(spark, sf_dir):
    """Scores parsed from texts written around known numbers."""
    q = table(spark, sf_dir, "question")
    s = F.col("question_id")
    t = F.when(s % 4 == 0, F.concat(F.lit("Rating: [["), (s % 11).cast("string"), F.lit("]]"))).when(s % 4 == 1, F.concat(F.lit("so ["), (s % 7).cast("string"), F.lit(".5] it is"))).when(s % 4 == 2, F.lit("no score")).otherwise(F.concat(F.lit("[["), (s % 9).cast("string"), F.lit(","), (s % 5).cast("string"), F.lit("]]")))
    two = verdicts.two_scores("t")
    return q.select("question_id", t.alias("t")).withColumn("two", two).select("question_id", verdicts.one_score("t").alias("score"), F.col("two.score_1").alias("a"), F.col("two.score_2").alias("b"), verdicts.score_winner("two.score_1", "two.score_2").alias("winner"))


def judge_routing(spark, sf_dir):
    q = table(spark, sf_dir, "question")
    return q.select("question_id", F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("turn"), "category").select("question_id", "turn", judge.judge_route().alias("judge_name"))


def judge_lookup(spark, sf_dir):
    games = _distinct(spark, sf_dir).where("judge[0] = 'egret-judge'").select("question_id", F.coalesce("turn", F.lit(1)).alias("turn"), F.col("model_2").alias("model_1"), F.col("model_1").alias("model_2")).distinct()
    return judge.looked_up(games, _distinct(spark, sf_dir).where("judge[0] = 'egret-judge' and g1_winner <> 'tie'"))


def judge_prompts(spark, sf_dir):
    q = table(spark, sf_dir, "question")
    template = F.lit("[Question]\n{question}\n\n[Answer]\n{answer}")
    filled = F.replace(F.replace(template, F.lit("{question}"), F.get("turns", F.lit(0))), F.lit("{answer}"), F.coalesce(F.get("reference", F.lit(0)), F.lit("none")))
    return q.select("question_id", filled.alias("prompt"), text.preview("question_id", F.get("turns", F.lit(0))).alias("preview"), text.temperature_of("category").alias("temperature"), verdicts.prompt_size(F.get("turns", F.lit(0)), filled).alias("size"))


NAMES = ["judge_single_scores", "judge_pair_winrate", "judge_pair_winrate_baseline", "judge_pair_winrate_strict", "judge_normalise_keys", "judge_agreement", "judge_dedup_clean", "judge_missing_models", "judge_matches_all_pairs", "judge_matches_multi_turn", "judge_matches_baseline", "judge_matches_single", "judge_match_union", "judge_missing_answers", "judge_parse_verdicts", "judge_parse_scores", "judge_routing", "judge_lookup", "judge_prompts"]
QUERIES = {n: globals()[n] for n in NAMES}

_D = "d AS (SELECT DISTINCT * FROM model_judgment)"
_REF = "('math', 'reasoning', 'coding')"
_R = """r AS (SELECT unnest([{{'model': model_1, 'win': w1, 'loss': w2, 'tie': t}}, {{'model': model_2, 'win': w2, 'loss': w1, 'tie': t}}]) AS x FROM (SELECT *, (NOT tie AND g1_winner = 'model_1')::INT AS w1, (NOT tie AND NOT coalesce(g1_winner = 'model_1', false))::INT AS w2, tie::INT AS t FROM (SELECT *, (g1_winner IS NULL OR g2_winner IS NULL OR g1_winner = 'tie' OR g1_winner <> g2_winner) AS tie FROM model_judgment WHERE {where})))"""
_RATES = "SELECT x.model AS model, sum(x.win)::BIGINT AS win, sum(x.loss)::BIGINT AS loss, sum(x.tie)::BIGINT AS tie, round(sum(x.win) / count(*)::DOUBLE, 6) AS win_rate, round(sum(x.loss) / count(*)::DOUBLE, 6) AS loss_rate, round((sum(x.win) + 0.5::DOUBLE * sum(x.tie)) / count(*), 6) AS win_rate_adjusted FROM r"
_N = """n AS (SELECT question_id, coalesce(turn, 1) AS turn, judge[1] AS judge, least(model_1, model_2) AS model_1, greatest(model_1, model_2) AS model_2,
  CASE WHEN model_1 > model_2 THEN CASE g1_winner WHEN 'model_1' THEN 'model_2' WHEN 'model_2' THEN 'model_1' ELSE g1_winner END ELSE g1_winner END AS g1,
  CASE WHEN model_1 > model_2 THEN CASE g2_winner WHEN 'model_1' THEN 'model_2' WHEN 'model_2' THEN 'model_1' ELSE g2_winner END ELSE g2_winner END AS g2 FROM {src})"""
_N_DECIDED = _N.format(src="(SELECT * FROM d WHERE g1_winner <> 'tie')")
_A = "a AS (SELECT question_id, model_id, dense_rank() OVER (ORDER BY model_id) AS idx FROM (SELECT DISTINCT question_id, model_id FROM model_answer))"


def _agree(name: str, x: str, y: str, ban: bool) -> str:
    votes = "CASE WHEN g1 = g2 THEN g1 ELSE 'inconsistent' END"
    pick = f"SELECT *, row_number() OVER () AS k, CASE WHEN {votes} = 'inconsistent' THEN 'tie' ELSE {votes} END AS vote, CASE WHEN judge LIKE '%judge%' THEN 'gpt4-pair' WHEN judge LIKE 'expert%' THEN 'human' END AS family FROM n WHERE {votes} IN ('model_1', 'model_2', 'tie', 'inconsistent')"
    keep = " WHERE vote <> 'tie'" if ban else ""
    on = "p.question_id = q.question_id AND p.turn = q.turn AND p.model_1 = q.model_1 AND p.model_2 = q.model_2"
    pair = "p.k < q.k" if x == y else "true"
    return f"SELECT '{name}' AS what, coalesce(sum((p.vote = q.vote)::INT), 0)::DOUBLE AS agree, count(*)::DOUBLE AS total, round(sum((p.vote = q.vote)::INT)::DOUBLE / count(*), 6) AS agreement FROM (SELECT * FROM ({pick}){keep}) p JOIN (SELECT * FROM ({pick}){keep}) q ON {on} AND {pair} WHERE p.family = '{x}' AND q.family = '{y}'"


SQL = {
    "judge_single_scores": f"WITH {_D}, s AS (SELECT model_1 AS model, coalesce(turn, 1) AS turn, ((question_id * 7 + length(model_2)) % 12 - 1)::DOUBLE AS score FROM d) SELECT model, turn, round(avg(score), 6) AS score, count(*) AS n FROM s GROUP BY GROUPING SETS ((model, turn), (model))",
    "judge_pair_winrate": f"WITH {_R.format(where='true')} {_RATES} GROUP BY 1",
    "judge_pair_winrate_baseline": f"""WITH {_R.format(where="model_1 = 'heron-13b' OR model_2 = 'heron-13b'")} {_RATES} WHERE x.model <> 'heron-13b' GROUP BY 1""",
    "judge_pair_winrate_strict": f"""WITH {_R.format(where="g1_winner <> 'error' AND g2_winner <> 'error'")} {_RATES} GROUP BY 1""",
    "judge_normalise_keys": f"WITH {_N.format(src='model_judgment')} SELECT *, CASE WHEN g1 = g2 THEN g1 ELSE 'inconsistent' END AS winner FROM n",
    "judge_agreement": f"WITH {_D}, {_N.format(src='d')} " + " UNION ALL ".join(_agree(*x) for x in (("judge_human", "gpt4-pair", "human", False), ("judge_human_no_ties", "gpt4-pair", "human", True), ("human_human", "human", "human", False), ("human_human_no_ties", "human", "human", True))),
    "judge_dedup_clean": "SELECT question_id, model_1, model_2, array_to_string(judge, '|') AS judge_key, min(tstamp) AS tstamp FROM model_judgment WHERE model_1 IN ('heron-13b', 'lynx-7b', 'civet-33b', 'ibis-30b', 'kestrel-xl') GROUP BY 1, 2, 3, 4",
    "judge_missing_models": "SELECT DISTINCT model_id AS model FROM model_answer WHERE model_id NOT IN (SELECT model_1 FROM model_judgment WHERE judge[1] = 'author_1')",
    "judge_matches_all_pairs": f"WITH {_A} SELECT x.question_id, x.model_id AS model_1, y.model_id AS model_2, coalesce(q.category IN {_REF}, false) AS needs_ref FROM a x JOIN a y ON x.question_id = y.question_id AND x.idx < y.idx JOIN question q ON q.question_id = x.question_id",
    "judge_matches_multi_turn": f"WITH {_A} SELECT x.question_id, x.model_id AS model_1, y.model_id AS model_2 FROM a x JOIN a y ON x.question_id = y.question_id AND x.idx < y.idx JOIN question q ON q.question_id = x.question_id WHERE len(q.turns) = 2",
    "judge_matches_baseline": f"WITH {_A} SELECT a.question_id, a.model_id AS model_1, 'heron-13b' AS model_2, coalesce(q.category IN {_REF}, false) AS needs_ref FROM a JOIN question q USING (question_id) WHERE model_id <> 'heron-13b' AND question_id IN (SELECT question_id FROM a WHERE model_id = 'heron-13b')",
    "judge_matches_single": f"WITH {_A} SELECT a.question_id, a.model_id AS model, coalesce(q.category IN {_REF}, false) AS needs_ref FROM a JOIN question q USING (question_id)",
    "judge_match_union": f"WITH {_A}, s AS (SELECT a.question_id, a.model_id AS model, coalesce(q.category IN {_REF}, false) AS r, a.model_id <> 'heron-13b' AND a.question_id IN (SELECT question_id FROM a WHERE model_id = 'heron-13b') AS p FROM a JOIN question q USING (question_id)) SELECT question_id, model, 'single' AS kind FROM s UNION ALL SELECT question_id, model, 'single_ref' FROM s WHERE r UNION ALL SELECT question_id, model, 'pair' FROM s WHERE p AND NOT r UNION ALL SELECT question_id, model, 'pair_ref' FROM s WHERE p AND r",
    "judge_missing_answers": "SELECT q.question_id, m.model_id FROM question q, (SELECT DISTINCT model_id FROM model_answer) m WHERE NOT EXISTS (SELECT 1 FROM model_answer a WHERE a.question_id = q.question_id AND a.model_id = m.model_id)",
    "judge_parse_verdicts": f"WITH {_D}, v AS (SELECT *, CASE WHEN contains(g1_judgment, '[[A]]') THEN 'A' WHEN contains(g1_judgment, '[[B]]') THEN 'B' WHEN contains(g1_judgment, '[[C]]') THEN 'tie' ELSE 'error' END AS m1, CASE WHEN contains(g2_judgment, '[[A]]') THEN 'A' WHEN contains(g2_judgment, '[[B]]') THEN 'B' WHEN contains(g2_judgment, '[[C]]') THEN 'tie' ELSE 'error' END AS m2 FROM d WHERE g1_judgment IS NOT NULL) SELECT question_id, model_1, model_2, tstamp, m1 AS mark_1, CASE m1 WHEN 'A' THEN 'model_1' WHEN 'B' THEN 'model_2' ELSE m1 END AS game_1, CASE m2 WHEN 'A' THEN 'model_2' WHEN 'B' THEN 'model_1' ELSE m2 END AS game_2 FROM v",
    "judge_parse_scores": "SELECT question_id, CASE question_id % 4 WHEN 0 THEN (question_id % 11)::DOUBLE WHEN 1 THEN (question_id % 7) + 0.5::DOUBLE ELSE -1::DOUBLE END AS score, CASE question_id % 4 WHEN 3 THEN (question_id % 9)::DOUBLE ELSE -1::DOUBLE END AS a, CASE question_id % 4 WHEN 3 THEN (question_id % 5)::DOUBLE ELSE -1::DOUBLE END AS b, CASE WHEN question_id % 4 <> 3 THEN 'error' WHEN question_id % 9 = question_id % 5 THEN 'tie' WHEN question_id % 9 > question_id % 5 THEN 'A' ELSE 'B' END AS winner FROM question",
    "judge_routing": f"WITH t AS (SELECT question_id, category, unnest(range(1, len(turns) + 1))::INT AS turn FROM question) SELECT question_id, turn, CASE WHEN coalesce(category IN {_REF}, false) THEN CASE WHEN turn > 1 THEN 'pair-math-v1-multi-turn' ELSE 'pair-math-v1' END WHEN turn > 1 THEN 'pair-v2-multi-turn' ELSE 'pair-v2' END AS judge_name FROM t",
    "judge_lookup": f"WITH {_D}, {_N_DECIDED}, k AS (SELECT * FROM n WHERE judge = 'egret-judge' QUALIFY row_number() OVER (PARTITION BY question_id, turn, model_1, model_2 ORDER BY g1 NULLS FIRST, g2 NULLS FIRST) = 1), g AS (SELECT DISTINCT question_id, coalesce(turn, 1) AS turn, model_2 AS model_1, model_1 AS model_2 FROM d WHERE judge[1] = 'egret-judge') SELECT g.question_id, g.turn, g.model_1, g.model_2, coalesce(CASE WHEN g.model_1 > g.model_2 THEN CASE k.g2 WHEN 'model_1' THEN 'model_2' WHEN 'model_2' THEN 'model_1' ELSE k.g2 END ELSE k.g1 END, 'N/A') AS g1, coalesce(CASE WHEN g.model_1 > g.model_2 THEN CASE k.g1 WHEN 'model_1' THEN 'model_2' WHEN 'model_2' THEN 'model_1' ELSE k.g1 END ELSE k.g2 END, 'N/A') AS g2 FROM g LEFT JOIN k ON k.question_id = g.question_id AND k.turn = g.turn AND k.model_1 = least(g.model_1, g.model_2) AND k.model_2 = greatest(g.model_1, g.model_2)",
    "judge_prompts": "WITH p AS (SELECT question_id, category, turns[1] AS t, '[Question]' || chr(10) || turns[1] || chr(10) || chr(10) || '[Answer]' || chr(10) || coalesce(reference[1], 'none') AS prompt FROM question), w AS (SELECT *, len(string_split(t, ' ')) + len(string_split(prompt, ' ')) AS n FROM p) SELECT question_id, prompt, question_id::VARCHAR || ': ' || substring(t, 1, 128) || '...' AS preview, CASE WHEN category IN ('writing', 'roleplay') THEN 0.7::DOUBLE WHEN category IN ('extraction', 'math', 'coding', 'reasoning') THEN 0.0::DOUBLE WHEN category IN ('stem', 'humanities') THEN 0.1::DOUBLE ELSE 0.7::DOUBLE END AS temperature, CASE WHEN n > 768 THEN 'bare' WHEN n > 420 THEN 'short' ELSE 'full' END AS size FROM w",
}
