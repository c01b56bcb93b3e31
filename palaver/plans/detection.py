"""Answer consistency and prompt queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text, verdicts
from palaver.operators import detect, prompts
from palaver.session import canonical_name, table

def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as paraphrase sets: their turns are two lists, the category is the gold."""
    q = table(spark, sf_dir, "question")
    return q.select(F.col("question_id").alias("id"), F.col("category").alias("gold"), F.array(F.slice("turns", 1, 1), F.slice("turns", 2, 5)).alias("questions"))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations: one per vote and side, grouped by question, with derived log-probabilities."""
    b = table(spark, sf_dir, "battles").where("question_id is not null")
    logps = F.transform(F.sequence(F.lit(1), (F.col("battle_id") % 5 + 2).cast("int")), lambda i: -((F.col("battle_id") * i) % 17 + 1) / 10.0)
    return b.select(F.col("battle_id").alias("pos"), canonical_name("model_a").alias("grp"), F.col("language").alias("cluster"), "winner", logps.alias("logps"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole embeddings, grouped by label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("bigint").alias("pos"), F.concat(F.lit("g"), "label").alias("grp"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def det_explode(spark, sf_dir):
    return detect.exploded(sets(spark, sf_dir)).select("id", "n", "input", "gold")


def det_explode_duplicate(spark, sf_dir):
    return detect.exploded(sets(spark, sf_dir), duplicate=10).select("id", "n", "input")


def det_group(spark, sf_dir):
    a = table(spark, sf_dir, "model_answer").select("question_id", "answer_id", "model_id").distinct()
    g = detect.grouped(a, "question_id", "answer_id", "model_id", "model_id")
    return g.select("question_id", F.array_join("texts", "|").alias("models"), "gold", "first", "n")


def det_entropy(spark, sf_dir):
    g = detect.cluster_entropy(generations(spark, sf_dir).withColumn("cluster", F.coalesce("cluster", F.lit("none"))), "grp", "cluster")
    return g.withColumns({c: F.round(c, 6) for c in ("entropy", "max_ratio", "contradiction")})


def det_logprob_features(spark, sf_dir):
    g = generations(spark, sf_dir)
    return g.select("pos", *[F.round(c, 6).alias(n) for n, c in detect.logprob_features(F.col("logps")).items()])


def det_contradiction(spark, sf_dir):
    return detect.contradiction(vectors(spark, sf_dir), "grp", "pos", "v").withColumn("contradiction", F.round("contradiction", 5))


def det_embedding_pool(spark, sf_dir):
    v = vectors(spark, sf_dir)
    dim = v.agg(F.max(F.size("v"))).first()[0] or 0
    p = detect.pooled(v, "grp", "v", dim)
    return p.select("grp", *[F.round(F.get("vector", F.lit(k)), 5).alias(f"v{k}") for k in range(dim)])


def det_leader_cluster(spark, sf_dir):
    return detect.leader_clusters(vectors(spark, sf_dir), "grp", "pos", "v", 0.3)


# Cases of the labelling rules: (golds, answer, question, whether a number is asked for, label).
QUIZ = "Which is it?\n(A) a red fox.\n(B) a grey wolf\n(C) two bears!"
LABEL_CASES = [
    (["a red fox"], "I think the answer to this is a red fox. Sure.", QUIZ, False, 1),
    (["a red fox"], "Well, the answer is a grey wolf. Sure.", QUIZ, False, 0),
    (["a red fox"], "Two bears", QUIZ, False, 0),
    (["a red fox"], "some other animal", QUIZ, False, -1),
    (["a red fox"], "a grey wolf", "Which is it?", False, -1),
    (["Paris", "Lutetia"], "lutetia.", "", False, 1),
    (["Paris"], "in Paris", "", False, 1),
    (["Paris"], "it must be Paris", "", False, -1),
    (["twenty-five thousand"], "about twenty-five thousand", "", False, 1),
    (["12"], "There are 12 apples.", "", True, 1),
    (["12"], "There are 13 apples.", "", True, 0),
    (["1200"], "It costs 1,200 in all", "", True, 1),
    (["12"], "First 3, then 4. Therefore 3 * 4 = 12 apples.", "", True, 1),
    (["12"], "First 3, then 4. So it is 14.", "", True, 0),
    (["12"], "3 and 4 Answer: \\boxed{12}", "", True, 1),
    (["12"], "3 and 4, who knows", "", True, -1),
    (["12"], "no number here", "", True, -1),
    (["12"], "the answer here is 12. It was 11 before.", "", True, 1),
]
# Cases of the reward rules: (gold, answer, reply on the kind, reply on the correctness, level).
REWARD_CASES = [
    ("Paris", " paris ", "", "", 6),
    ("Paris", "in Paris", "", "", 5),
    ("7", "it is 7", "", "", -1),
    ("Paris", "Paris" + " and much more" * 5, "", "", -1),
    ("Paris", "Rome", "Unexpected answer type", "Completely correct", 1),
    ("Paris", "Rome", "unexpected answer type", "correct", 0),
    ("Paris", "Rome", "Expected answer type", "incorrect", 1),
    ("Paris", "Rome", "a valid kind", "partly correct", 3),
    ("Paris", "Rome", "expected answer type", "completely correct", 4),
    ("Paris", "Rome", "expected answer type", "no idea", -1),
    ("Paris", "Rome", "no idea", "completely correct", 2),
    ("Paris", "Rome", "no idea", "correct", 1),
    ("Paris", "Rome", "no idea", "incorrect", 0),
    ("Paris", "Rome", "no idea", "no idea", -1),
]
# Replies on the agreement of two answers, and whether they agree; replies on a level, and the level; replies on the kind, and the coarse reward.
SAID_CASES = [("They are the same.", True), ("not contradicted", True), ("contradicted", False), ("Same", True), ("SAME", False)]
LEVEL_CASES = [("Level 3: fine", 3), ("level 4", 4), ("Level 5", -1), ("3 of Level 2", -1), ("none", -1), ("It is level 0.", 0)]
COARSE_CASES = [("unexpected", 0), ("expected", 2), ("a valid reply", 2), ("neither", 1), ("expected, not unexpected", 0)]


def _case(cases: list, at: int, kind: str) -> Column:
    """Field ``at`` of the case that the question id points to."""
    values = [F.array(*[F.lit(x) for x in c[at]]) if isinstance(c[at], list) else F.lit(c[at]) for c in cases]
    return F.get(F.array(*values), (F.col("question_id") % len(cases)).cast("int")).cast(kind)


def det_rule_label(spark, sf_dir):
    q = table(spark, sf_dir, "question")
    label = verdicts.rule_label(_case(LABEL_CASES, 0, "array<string>"), _case(LABEL_CASES, 1, "string"), _case(LABEL_CASES, 2, "string"), _case(LABEL_CASES, 3, "boolean"))
    return q.select("question_id", label.alias("label"), verdicts.fused_label(label, F.col("question_id") % 2 == 1).alias("fused"), verdicts.agrees(_case(SAID_CASES, 0, "string")).alias("agrees"))


def det_rule_label_answers(spark, sf_dir):
    """The rules on the answers themselves, held against the reference answers and the prompts."""
    q = table(spark, sf_dir, "question").where("reference is not null")
    a = table(spark, sf_dir, "model_answer").select("answer_id", "question_id", F.get(F.get("choices", F.lit(0))["turns"], F.lit(0)).alias("answer")).distinct()
    label = verdicts.rule_label("reference", "answer", F.get("turns", F.lit(0)), F.lit(False))
    return a.join(q, "question_id").select("answer_id", label.alias("label"))


def det_reward_ladder(spark, sf_dir):
    q = table(spark, sf_dir, "question")
    level = verdicts.reward(*[_case(REWARD_CASES, k, "string") for k in range(4)])
    return q.select("question_id", level.alias("level"), F.round(verdicts.scaled_reward(level), 6).alias("scaled"), verdicts.level_of(_case(LEVEL_CASES, 0, "string")).alias("said_level"), verdicts.coarse_reward(_case(COARSE_CASES, 0, "string")).alias("coarse"))


def det_feature_join(spark, sf_dir):
    """Features of the clusters by language, and as own ones by winner; an outdated row of each group comes first."""
    g = generations(spark, sf_dir)
    groups = detect.cluster_entropy(g.withColumn("cluster", F.coalesce("cluster", F.lit("none"))), "grp", "cluster").withColumn("pos", F.lit(1))
    stale = groups.withColumns({"entropy": F.lit(-1.0), "max_ratio": F.lit(-1.0), "pos": F.lit(0)})
    own = detect.cluster_entropy(g.withColumn("cluster", F.coalesce("winner", F.lit("none"))), "grp", "cluster").withColumn("pos", F.lit(0))
    labels = g.select("winner", F.when(F.col("winner") == "model_a", 1).otherwise(0).alias("label"), "pos").where("winner is not null")
    j = detect.feature_join(g.select("pos", "grp", "winner"), stale.unionByName(groups), labels, "grp", "winner", own)
    return j.select("pos", "grp", F.round("entropy", 6).alias("entropy"), F.round("max_ratio", 6).alias("max_ratio"), "label", (F.round("entropy_self", 6) + 0.0).alias("entropy_self"), F.round("max_ratio_self", 6).alias("max_ratio_self"))


def det_gold_filter(spark, sf_dir):
    return sets(spark, sf_dir).where(detect.usable_gold()).select("id", "gold", text.gold_list(F.array("gold", F.lit("x"))).alias("listed"))


def det_mixed_groups(spark, sf_dir):
    g = generations(spark, sf_dir).where("winner is not null").select("grp", F.when(F.col("winner") == "model_a", 1).otherwise(0).alias("label"), F.size("logps").cast("double").alias("value"))
    return detect.mixed_groups(g, "grp", "label", "value").withColumns({c: F.round(c, 6) for c in ("sum_0", "sum_1")})


def det_classifier_metrics(spark, sf_dir):
    g = generations(spark, sf_dir).where("winner is not null")
    f = detect.logprob_features(F.col("logps"))
    rows = g.select("pos", F.when(F.col("winner") == "model_a", 1).otherwise(0).alias("label"), *[c.alias(n) for n, c in f.items()])
    train, test = detect.hash_split(rows, "pos", 0.75)
    return detect.binary_metrics(detect.boosted(train, test, list(f)))


def det_baseline_metrics(spark, sf_dir):
    """Metrics of a fixed prediction, against which the classifier is held."""
    g = generations(spark, sf_dir).where("winner is not null")
    rows = g.select(F.when(F.col("winner") == "model_a", 1).otherwise(0).alias("label"), F.when(F.size("logps") > 3, 1).otherwise(0).alias("prediction"))
    return detect.binary_metrics(rows).select(*[F.round(c, 6).alias(c) for c in ("auc", "ap", "accuracy")])


def det_paraphrase_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.explode(detect.paraphrase_lines(F.col("text"))).alias("line"))


def det_batches(spark, sf_dir):
    e = table(spark, sf_dir, "question").select((F.col("question_id") - 1).alias("pos"))
    return detect.last_in_batches(e, "pos").select("pos", "batch", "index")


def det_top_instances(spark, sf_dir):
    """The first ten questions of each category: a top-n report."""
    q = table(spark, sf_dir, "question").select(F.coalesce("category", F.lit("none")).alias("task"), "question_id")
    return detect.top_instances(q, "task", "question_id", 10)


def _conv(spark, sf_dir):
    return table(spark, sf_dir, "battles").select("battle_id", F.col("conversation_a").alias("m"))


def _render(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text_ = prompts.render(F.col("m"), "Be kind.", ("USER", "ASSISTANT"), prompts.styles()[name])
        return _conv(spark, sf_dir).select("battle_id", F.md5(text_).alias("digest"), F.char_length(text_).alias("chars"))

    query.__name__ = f"prompt_render_{name}"
    return query


def prompt_chat_pairs(spark, sf_dir):
    return _conv(spark, sf_dir).where("size(m) > 0").select("battle_id", F.posexplode(prompts.chat_pairs(F.col("m"))).alias("round", "p")).select("battle_id", "round", "p.said", "p.replied")


def prompt_moderation(spark, sf_dir):
    return _conv(spark, sf_dir).select("battle_id", prompts.moderation_text(F.col("m")).alias("text"))


def prompt_decorated(spark, sf_dir):
    return _conv(spark, sf_dir).select("battle_id", F.posexplode(prompts.decorated(F.col("m"))).alias("turn", "d")).select("battle_id", "turn", "d.text", "d.next")


def prompt_answer_pairs(spark, sf_dir):
    return _conv(spark, sf_dir).select("battle_id", F.posexplode(prompts.answer_pairs(F.col("m"), 12)).alias("n", "p")).select("battle_id", "n", "p.context", "p.answer")


def prompt_label_mask(spark, sf_dir):
    mask = prompts.label_mask(F.col("m"))
    return _conv(spark, sf_dir).select("battle_id", F.size(mask).alias("words"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("kept"))


RENDERS = {f"prompt_render_{n}": _render(n) for n in prompts.styles()}
NAMES = ["det_explode", "det_explode_duplicate", "det_group", "det_entropy", "det_logprob_features", "det_contradiction", "det_embedding_pool", "det_leader_cluster", "det_rule_label", "det_rule_label_answers", "det_reward_ladder", "det_feature_join", "det_gold_filter", "det_mixed_groups", "det_classifier_metrics", "det_baseline_metrics", "det_paraphrase_lines", "det_batches", "det_top_instances", "prompt_chat_pairs", "prompt_moderation", "prompt_decorated", "prompt_answer_pairs", "prompt_label_mask"]
QUERIES = {n: globals()[n] for n in NAMES} | RENDERS

_G = """g AS (SELECT battle_id AS pos, lower(trim(model_a)) AS grp, coalesce(language, 'none') AS cluster, winner, list_transform(range(1, battle_id % 5 + 3), lambda i: -((battle_id * i) % 17 + 1) / 10.0::DOUBLE) AS logps FROM battles WHERE question_id IS NOT NULL)"""
_E = f"""{_G}, k AS (SELECT grp, cluster, count(*) AS k FROM g GROUP BY ALL), h AS (SELECT grp, ln(sum(k)::DOUBLE) - sum(k * ln(k::DOUBLE)) / sum(k) AS entropy, max(k) / sum(k)::DOUBLE AS max_ratio, 1 - arg_min(k, cluster) / sum(k)::DOUBLE AS contradiction FROM k GROUP BY grp)"""


_V = "v AS (SELECT vec_id::BIGINT AS pos, 'g' || label AS grp, embedding::DOUBLE[] AS v FROM embeddings)"


def _pick(cases: list, at: int) -> str:
    """Field ``at`` of the case that the question id points to, in SQL."""
    return f"[{', '.join(str(c[at]) for c in cases)}][question_id % {len(cases)} + 1]"


def _style_sql(name: str) -> str:
    s = prompts.styles()[name]
    q = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    body = "m.content" if not s.tidy else "replace(replace(m.content, chr(13) || chr(10), chr(10)), chr(10) || chr(10), chr(10))"
    begin = "''"
    if s.round_begin:
        a, _, b = s.round_begin.partition("{n}")
        begin = f"CASE WHEN i % 2 = 1 THEN {q(a)} || ((i - 1) // 2)::VARCHAR || {q(b)} ELSE '' END" if "{n}" in s.round_begin else f"CASE WHEN i % 2 = 1 THEN {q(s.round_begin)} ELSE '' END"
    role = "CASE WHEN i % 2 = 1 THEN 'USER' ELSE 'ASSISTANT' END"
    end = f"CASE WHEN i % 2 = 1 THEN {q(s.ends[0])} ELSE {q(s.ends[1])} END"
    part = f"{begin} || {role} || CASE WHEN coalesce(m.content, '') <> '' THEN {q(s.joint)} || {body} || {end} ELSE {q(s.open_joint)} END"
    return f"WITH t AS (SELECT battle_id, {q('Be kind.' + s.system_end)} || coalesce(array_to_string(list_transform(conversation_a, lambda m, i: {part}), ''), '') AS t FROM battles) SELECT battle_id, md5(t) AS digest, length(t)::INT AS chars FROM t"



SQL = {
    "det_explode": "WITH f AS (SELECT question_id AS id, category AS gold, turns FROM question), n AS (SELECT id, gold, turns, unnest(range(len(turns)))::INT AS n FROM f) SELECT id, n, turns[n + 1] AS input, gold FROM n",
    "det_explode_duplicate": "SELECT question_id AS id, unnest(range(10))::INT AS n, turns[1] AS input FROM question",
    "det_group": "WITH a AS (SELECT DISTINCT question_id, answer_id, model_id FROM model_answer) SELECT question_id, string_agg(model_id, '|' ORDER BY answer_id) AS models, arg_min(model_id, answer_id) AS gold, min(answer_id) AS first, count(*) AS n FROM a GROUP BY question_id",
    "det_entropy": f"WITH {_E} SELECT grp, round(entropy, 6) AS entropy, round(max_ratio, 6) AS max_ratio, round(contradiction, 6) AS contradiction FROM h",
    "det_logprob_features": f"WITH {_G}, x AS (SELECT pos, logps, list_transform(logps, lambda y: exp(y)) AS p, list_sum(logps) AS t, len(logps) AS n FROM g) SELECT pos, round(list_sum(p) / n, 6) AS prob_mean, round(list_max(p), 6) AS prob_max, round(list_min(p), 6) AS prob_min, round(exp(-t / n), 6) AS perplexity, round(-t / n, 6) AS neglog_mean, round(-list_min(logps), 6) AS neglog_max, round(t, 6) AS likelihood, round(t / n, 6) AS likelihood_avg FROM x",
    "det_rule_label": f"WITH l AS (SELECT question_id, {_pick(LABEL_CASES, 4)} AS label, {_pick(SAID_CASES, 1)} AS agrees FROM question) SELECT question_id, label, CASE WHEN label = -1 THEN (question_id % 2 = 1)::INT ELSE label END AS fused, agrees FROM l",
    "det_rule_label_answers": r"""WITH a AS (SELECT DISTINCT answer_id, question_id, choices[1].turns[1] AS x FROM model_answer), j AS (SELECT answer_id, list_filter(reference, lambda g: g IS NOT NULL) AS golds, x, string_split(x, chr(10))[1] AS line FROM a JOIN question USING (question_id) WHERE reference IS NOT NULL),
s AS (SELECT *, CASE WHEN regexp_matches(line, '^.*? answer .*? is .*') THEN string_split(regexp_extract(line, '^(.*?) answer (.*?) is (.*)', 3), '.')[1] WHEN regexp_matches(line, '^.*? answer is .*') THEN string_split(regexp_extract(line, '^(.*?) answer is (.*)', 2), '.')[1] ELSE x END AS said FROM j),
t AS (SELECT answer_id, lower(trim(trim(said, ' ' || chr(9) || chr(10) || chr(13)), '.')) AS a, list_transform(golds, lambda g: lower(trim(trim(g, ' ' || chr(9) || chr(10) || chr(13)), '.'))) AS gs FROM s)
SELECT answer_id, CASE WHEN a IS NOT NULL AND len(list_filter(gs, lambda g: a = g OR (contains(a, g) AND (length(a) - length(g) < 5 OR (length(a) < 1.5 * length(g) AND length(a) - length(g) < 15))))) > 0 THEN 1 ELSE -1 END AS label FROM t""",
    "det_reward_ladder": f"WITH l AS (SELECT question_id, {_pick(REWARD_CASES, 4)} AS level, {_pick(LEVEL_CASES, 1)} AS said_level, {_pick(COARSE_CASES, 1)} AS coarse FROM question) SELECT question_id, level, round(greatest(1.0::DOUBLE, level / 4.0::DOUBLE), 6) AS scaled, said_level, coarse FROM l",
    "det_contradiction": f"WITH {_V}, f AS (SELECT grp, min(pos) AS o, arg_min(v, pos) AS v0 FROM v GROUP BY grp), c AS (SELECT v.grp, greatest(0.0::DOUBLE, list_dot_product(v.v, f.v0) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(f.v0, f.v0)))) AS c FROM v JOIN f ON f.grp = v.grp AND v.pos > f.o) SELECT f.grp, round(1 - avg(c.c), 5) AS contradiction FROM f LEFT JOIN c USING (grp) GROUP BY f.grp",
    "det_embedding_pool": f"WITH {_V}, m AS (SELECT grp, {', '.join(f'avg(v[{k + 1}]) AS a{k}' for k in range(64))} FROM v GROUP BY grp), n AS (SELECT *, sqrt({' + '.join(f'a{k} * a{k}' for k in range(64))}) AS norm FROM m) SELECT grp, {', '.join(f'round(a{k} / norm, 5) AS v{k}' for k in range(64))} FROM n",
    "det_leader_cluster": f"""WITH RECURSIVE {_V}, o AS (SELECT grp, pos, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u, row_number() OVER (PARTITION BY grp ORDER BY pos) AS n FROM v),
s AS (SELECT DISTINCT grp, 0::BIGINT AS n, NULL::BIGINT AS pos, NULL::BIGINT AS leader, []::STRUCT(p BIGINT, u DOUBLE[])[] AS known FROM o UNION ALL
SELECT grp, n, pos, coalesce(hit, pos), CASE WHEN hit IS NULL THEN list_append(known, {{'p': pos, 'u': u}}) ELSE known END FROM (SELECT o.grp, o.n, o.pos, o.u, s.known, list_filter(s.known, lambda k: list_dot_product(k.u, o.u) >= 0.3)[1].p AS hit FROM s JOIN o ON o.grp = s.grp AND o.n = s.n + 1))
SELECT grp, pos, leader FROM s WHERE pos IS NOT NULL""",
    "det_feature_join": f"WITH {_E}, k2 AS (SELECT grp, coalesce(winner, 'none') AS cluster, count(*) AS k FROM g GROUP BY ALL), h2 AS (SELECT grp, ln(sum(k)::DOUBLE) - sum(k * ln(k::DOUBLE)) / sum(k) AS entropy, max(k) / sum(k)::DOUBLE AS max_ratio FROM k2 GROUP BY grp) SELECT g.pos, g.grp, round(h.entropy, 6) AS entropy, round(h.max_ratio, 6) AS max_ratio, (g.winner = 'model_a')::INT AS label, round(h2.entropy, 6) + 0.0::DOUBLE AS entropy_self, round(h2.max_ratio, 6) AS max_ratio_self FROM g JOIN h ON g.grp = h.grp JOIN h2 ON g.grp = h2.grp WHERE g.winner IS NOT NULL",
    "det_gold_filter": "SELECT question_id AS id, category AS gold, '[' || category || ', x]' AS listed FROM question WHERE coalesce(category, '') <> '' AND NOT contains(category, 'en.wikipedia.org')",
    "det_mixed_groups": f"WITH {_G}, r AS (SELECT grp, (winner = 'model_a')::INT AS label, len(logps)::DOUBLE AS v FROM g WHERE winner IS NOT NULL), p AS (SELECT grp, avg(v) FILTER (label = 0) AS m0, avg(v) FILTER (label = 1) AS m1 FROM r GROUP BY grp HAVING count(DISTINCT label) = 2) SELECT count(*) AS groups, round(sum(m0), 6) AS sum_0, round(sum(m1), 6) AS sum_1 FROM p",
    "det_baseline_metrics": f"WITH {_G}, r AS (SELECT (winner = 'model_a')::INT AS y, (len(logps) > 3)::INT AS p FROM g WHERE winner IS NOT NULL), c AS (SELECT sum(y * p)::DOUBLE AS tp, sum((1 - y) * p)::DOUBLE AS fp, sum(y * (1 - p))::DOUBLE AS fn, sum((1 - y) * (1 - p))::DOUBLE AS tn FROM r) SELECT round(100 * (tp / (tp + fn) - fp / (fp + tn) + 1) / 2, 6) AS auc, round(100 * (tp / (tp + fn) * tp / (tp + fp) + (1 - tp / (tp + fn)) * (tp + fn) / (tp + fp + fn + tn)), 6) AS ap, round(100 * (tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c",
    "det_paraphrase_lines": r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, trim(regexp_replace(x, '^[\s\d.]+', ''), ' ') AS line FROM l WHERE coalesce(try_cast(nullif(regexp_extract(x, '(\d+)', 1), '') AS INT), 0) > 0",
    "det_batches": "SELECT question_id - 1 AS pos, (question_id - 1) // 4 AS batch, (question_id - 1) % 4 AS index FROM question",
    "det_top_instances": "SELECT coalesce(category, 'none') AS task, question_id FROM question QUALIFY row_number() OVER (PARTITION BY coalesce(category, 'none') ORDER BY question_id) <= 10",
    "prompt_chat_pairs": "WITH r AS (SELECT battle_id, conversation_a AS m, unnest(range((len(conversation_a) + 1) // 2))::INT AS round FROM battles) SELECT battle_id, round, m[2 * round + 1].content AS said, m[2 * round + 2].content AS replied FROM r",
    "prompt_moderation": "SELECT battle_id, coalesce(array_to_string(list_filter(list_transform(list_filter(conversation_a, lambda m: m.role = 'user'), lambda m: m.content), lambda x: x IS NOT NULL), chr(10)), '') AS text FROM battles",
    "prompt_decorated": "WITH r AS (SELECT battle_id, conversation_a AS m, unnest(range(len(conversation_a)))::INT AS turn FROM battles) SELECT battle_id, turn, '### ' || m[turn + 1].role || ': ' || coalesce(m[turn + 1].content, '') || chr(10) AS text, m[turn + 2].role AS next FROM r",
    "prompt_answer_pairs": "WITH r AS (SELECT battle_id, conversation_a AS m, unnest(list_filter(range(len(conversation_a)), lambda i: conversation_a[i + 1].role = 'assistant')) AS i FROM battles), t AS (SELECT battle_id, row_number() OVER (PARTITION BY battle_id ORDER BY i) - 1 AS n, flatten(list_transform(m[:i], lambda x: string_split(coalesce(x.content, ''), ' '))) AS w, string_split(coalesce(m[i + 1].content, ''), ' ') AS a FROM r) SELECT battle_id, n::INT AS n, coalesce(array_to_string(w[greatest(len(w) - 11, 1):], ' '), '') AS context, array_to_string(a[:12], ' ') || '</s>' AS answer FROM t",
    "prompt_label_mask": "WITH r AS (SELECT battle_id, list_transform(conversation_a, lambda m: {'n': len(string_split(coalesce(m.content, ''), ' ')), 'a': m.role = 'assistant'}) AS x FROM battles) SELECT battle_id, coalesce(list_sum(list_transform(x, lambda y: y.n)), 0)::INT AS words, coalesce(list_sum(list_transform(x, lambda y: CASE WHEN y.a THEN y.n ELSE 0 END)), 0)::INT AS kept FROM r",
} | {f"prompt_render_{n}": _style_sql(n) for n in prompts.styles()}
