"""Curation queries over conversations (battles) and documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators import curate
from palaver.session import canonical_name, table


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each battle's side a as a corpus sample: id, pos, model, conversations."""
    b = table(spark, sf_dir, "battles")
    turns = F.transform("conversation_a", lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise("gpt").alias("from"), m["content"].alias("value")))
    return b.select(F.col("battle_id").alias("id"), F.col("battle_id").alias("pos"), canonical_name("model_a").alias("model"), turns.alias("conversations"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def conv_clean_codes(spark, sf_dir):
    c = curate.cleaned(conversations(spark, sf_dir))
    return c.select("id", "code", F.size("conversations").alias("turns"))


def conv_clean_counts(spark, sf_dir):
    return curate.cleaned(conversations(spark, sf_dir)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def conv_clean_pages(spark, sf_dir):
    """The same with each turn converted from its page."""
    c = curate.cleaned(curate.with_markdown(conversations(spark, sf_dir)), "md")
    return c.select("id", "code", F.size("conversations").alias("turns"))


# Small conversations for the rules that the tables do not reach: (turns as role and text, code, turns left).
CLEAN_CASES = [
    ([("system", "x"), ("human", "a question here"), ("gpt", "an answer"), ("human", "more")], 0, 2),
    ([("system", "x"), ("system", "y"), ("human", "a question here"), ("gpt", "an answer")], 2, 3),
    ([("human", "a question here"), ("human", "another")], 1, 1),
    ([("human", "a"), ("gpt", "b"), ("human", "c"), ("gpt", "d")], 1, 4),
    ([("human", "a"), ("gpt", "b"), ("human", "a text of enough letters"), ("gpt", " ")], 0, 2),
    ([("human", "what is ChatGPT"), ("gpt", "a model of some kind")], 3, 2),
    ([("human", "a question here"), ("gpt", "an answer of some length"), ("gpt", "again"), ("human", "x"), ("gpt", "y")], 2, 5),
    ([("human", "only one turn of text")], 1, 1),
    ([("human", "a question here"), ("gpt", ""), ("human", "openai"), ("gpt", "b")], 1, 0),
]


def conv_clean_cases(spark, sf_dir):
    """The cleaning rules on ``CLEAN_CASES``, one for each battle by its id; ``turns`` as in conv_clean_codes."""
    case = F.array(*[F.array(*[F.struct(F.lit(r).alias("from"), F.lit(t).alias("value")) for r, t in turns]) for turns, _, _ in CLEAN_CASES])
    b = table(spark, sf_dir, "battles").select(F.col("battle_id").alias("id"), F.get(case, (F.col("battle_id") % len(CLEAN_CASES)).cast("int")).alias("conversations"))
    c = curate.cleaned(b)
    return c.select("id", "code", F.when(F.col("code") == 0, F.size("conversations")).alias("turns"))


def conv_role_filter(spark, sf_dir):
    return conversations(spark, sf_dir).where(curate.alternating(F.col("conversations"))).select("id", F.size("conversations").alias("turns"))


def conv_first_round(spark, sf_dir):
    c = conversations(spark, sf_dir).withColumn("conversations", curate.first_round())
    return c.select("id", F.size("conversations").alias("turns"), F.get("conversations", F.lit(0))["value"].alias("first"))


def conv_model_filter(spark, sf_dir):
    return curate.model_rows(conversations(spark, sf_dir), "lynx-7b").select("id", "model")


def conv_turn_index(spark, sf_dir):
    t = conversations(spark, sf_dir).select("id", F.posexplode("conversations").alias("turn", "m"))
    return t.select("id", "turn", (F.col("turn") % 2).alias("parity"), F.col("m.from").alias("speaker"))


def conv_stats(spark, sf_dir):
    return curate.turn_stats(conversations(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("avg_rounds", "avg_response_tokens")})


def conv_split_long(spark, sf_dir):
    s = curate.split_long(conversations(spark, sf_dir), 120)
    return s.select("id", "begin", F.size("conversations").alias("turns"), curate.alternating(F.col("conversations")).alias("valid"))


def conv_sample(spark, sf_dir):
    c = conversations(spark, sf_dir)
    return curate.sample(c, 1, c.count() + 1, 1500).select("id")


def conv_shuffle(spark, sf_dir):
    """A seeded order of the corpus."""
    return curate.shuffled_place(conversations(spark, sf_dir).select("id"), "id", 42)


def conv_train_test(spark, sf_dir):
    return curate.train_test(conversations(spark, sf_dir).select("id"), "id", 0.9)


def conv_merge(spark, sf_dir):
    a = conversations(spark, sf_dir).select(F.col("id").cast("string"), "model", F.size("conversations").alias("turns"))
    q = table(spark, sf_dir, "question").select(F.col("question_id").cast("string").alias("id"), F.size("turns").alias("turns"))
    return curate.merged(a, q)


def conv_greedy_dedup(spark, sf_dir):
    """Drops battles whose question id or first pair of turns an earlier kept one has."""
    b = table(spark, sf_dir, "battles")
    pair = F.md5(F.to_json(F.slice("conversation_a", 1, 2)))
    return curate.greedy_dedup(b.select("battle_id", F.col("question_id").alias("k1"), pair.alias("k2")), "battle_id", ("k1", "k2")).select("battle_id")


def conv_filter_format(spark, sf_dir):
    """Conversations without a list item numbered 1 twice; documents as one turn."""
    d = documents(spark, sf_dir)
    said = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "\n1. one\n1. again").when(F.col("doc_id") % 5 == 1, "\n1. one\n2. two\n1. new").otherwise(""))
    conv = F.array(F.struct(F.lit("gpt").alias("from"), said.alias("value")))
    return d.where(~curate.has_wrong_format(conv)).select("doc_id")


def doc_repetition_filter(spark, sf_dir):
    return documents(spark, sf_dir).where(curate.has_repetition(F.concat("text", F.repeat((F.col("doc_id") % 10).cast("string"), (F.col("doc_id") % 4 + 7).cast("int"))))).select("doc_id")


def doc_lang_keep(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("code", F.lower(F.trim("lang")))
    return curate.language_rows(d, "code", keep={"en", "de", "unknown"}).select("doc_id", "code")


def doc_lang_skip(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("code", F.lower(F.trim("lang")))
    return curate.language_rows(d, "code", skip={"en", "und"}).select("doc_id", "code")


def doc_dedup_first(spark, sf_dir):
    """The first document of each text."""
    return documents(spark, sf_dir).groupBy(F.md5("text").alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


def doc_length_hist(spark, sf_dir):
    return curate.length_histogram(documents(spark, sf_dir).where("text is not null"), "text", 20)


def doc_counts(spark, sf_dir):
    """Samples of each source and a checksum of the whole."""
    d = documents(spark, sf_dir)
    return d.groupBy(canonical_name("source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), F.min(F.md5("text")).alias("least_md5"))


def instruction_to_conv(spark, sf_dir):
    q = table(spark, sf_dir, "question").select(F.get("turns", F.lit(0)).alias("instruction"), F.coalesce(F.get("turns", F.lit(1)), F.lit("")).alias("input"), F.coalesce("category", F.lit("")).alias("output"), F.col("question_id").alias("place"))
    return curate.instruction_rows(q).select("id", F.get("conversations", F.lit(0))["value"].alias("prompt"), F.get("conversations", F.lit(1))["value"].alias("answer"))


# Questions and answers about identity by rule: openings times ends. The groups have 12 x 6, 7 x 7 and 68 x 12 pairs.
IDENTITY = [
    ((["Who", "Say who", "Tell me who"], [" are you?", " you are.", " you really are.", " I am talking to."]), (["I am {name}", "My name is {name}"], [".", ", a model of {org}.", ", made by {org}."])),
    ((["Who made you", "Who trained you", "Who built you", "Who wrote you", "Who runs you", "Who owns you", "Who tests you"], ["?"]), (["{org}", "People of {org}", "A group at {org}", "The makers of {name}", "Those behind {name}", "It was {org}", "That is {org}"], ["."])),
    ((["Are you ", "You are ", "Is your name ", "Do they call you "], [f"model {k}?" for k in range(1, 18)]), (["No", "No, not at all", "Not me", "You mix me up"], [", I am {name}.", ". I am {name} of {org}.", ". My name is {name}."])),
]


def identity_rows(spark, sf_dir):
    groups = [([o + e for o in qs for e in qe], [o + e for o in ans for e in ae]) for (qs, qe), (ans, ae) in IDENTITY]
    return curate.identity_rows(spark, "Palaver", "the team", groups).select("id", F.get("conversations", F.lit(0))["value"].alias("question"), F.get("conversations", F.lit(1))["value"].alias("answer"))


def doc_every_fifth(spark, sf_dir):
    """A sampling operator: every fifth document by id."""
    return curate.every_fifth(documents(spark, sf_dir).select("doc_id", (F.col("doc_id") - 1).alias("pos"))).select("doc_id")


def conv_long_pairs(spark, sf_dir):
    c = conversations(spark, sf_dir).select("id", F.get("conversations", F.lit(0))["value"].alias("question"), F.get("conversations", F.lit(1))["value"].alias("answer"))
    return curate.long_pairs(c, "question", "answer").select("id")


PAGE_PARTS = [("3 / 4", "\n```\npythonCopy codex = 1\n\n```\n"), ("<div class='a'><span id='b'>", "</div>\n\n\nend"), ("", "Copy12 chars / 3 words"), (" 1 / 2 ", "```\nCopy code\n```"), ("<DIV>", "``` Copy code```!\n\n\n\n")]


def page_strip_tags(spark, sf_dir):
    """Documents as page texts, with the leftovers that chat pages have put around them by id."""
    d = documents(spark, sf_dir).where("text is not null")
    head = F.element_at(F.array(*[F.lit(x) for x, _ in PAGE_PARTS]), (F.col("doc_id") % len(PAGE_PARTS) + 1).cast("int"))
    tail = F.element_at(F.array(*[F.lit(x) for _, x in PAGE_PARTS]), (F.col("doc_id") % len(PAGE_PARTS) + 1).cast("int"))
    return d.select("doc_id", curate.strip_page(F.concat(head, F.col("text"), tail)).alias("text"))


def page_to_markdown(spark, sf_dir):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[curate.page(t) for t in b["text"]])

    return documents(spark, sf_dir).select("doc_id", "text").mapInPandas(run, "doc_id bigint, text string")


NAMES = ["conv_clean_codes", "conv_clean_counts", "conv_clean_pages", "conv_clean_cases", "conv_role_filter", "conv_first_round", "conv_model_filter", "conv_turn_index", "conv_stats", "conv_split_long", "conv_sample", "conv_shuffle", "conv_train_test", "conv_merge", "conv_greedy_dedup", "conv_filter_format", "doc_repetition_filter", "doc_lang_keep", "doc_lang_skip", "doc_dedup_first", "doc_length_hist", "doc_counts", "instruction_to_conv", "identity_rows", "doc_every_fifth", "conv_long_pairs", "page_strip_tags", "page_to_markdown"]
QUERIES = {n: globals()[n] for n in NAMES}

_C = "c AS (SELECT battle_id AS id, lower(trim(model_a)) AS model, list_transform(conversation_a, lambda m: {'f': CASE WHEN m.role = 'user' THEN 'human' ELSE 'gpt' END, 'v': m.content}) AS conv FROM battles)"
_CLEAN = f"""{_C}, a AS (SELECT id, conv, CASE WHEN len(conv) > 0 AND conv[1].f <> 'human' THEN conv[2:] ELSE conv END AS a FROM c),
b AS (SELECT *, CASE WHEN len(a) > 1 AND a[-1].f = 'human' THEN a[:-2] ELSE a END AS b FROM a),
t AS (SELECT *, list_transform(b, lambda x, i: CASE WHEN x.f <> CASE WHEN i % 2 = 1 THEN 'human' ELSE 'gpt' END THEN 2 WHEN regexp_matches(lower(coalesce(x.v, '')), 'openai|chatgpt') THEN 3 WHEN coalesce(trim(x.v), '') = '' OR regexp_matches(trim(x.v), '^\\pC') THEN -1 ELSE 0 END) AS t FROM b),
u AS (SELECT *, coalesce(list_filter(t, lambda z: z <> 0)[1], 0) AS bad, list_position(t, -1) AS stop FROM t),
w AS (SELECT *, CASE WHEN bad = -1 THEN stop - 1 ELSE len(b) END AS n0 FROM u), x AS (SELECT *, (n0 - n0 % 2)::INT AS n FROM w),
y AS (SELECT *, coalesce(list_sum(list_transform(b[:n0], lambda m: coalesce(length(trim(m.v)), 0))), 0) AS chars FROM x),
z AS (SELECT id, CASE WHEN len(conv) <= 1 OR len(a) <= 1 OR len(b) <= 1 THEN 1 WHEN bad IN (2, 3) THEN bad WHEN n = 0 OR chars < 16 THEN 1 ELSE 0 END AS code, n AS turns FROM y)"""
_W = "len(string_split({}, ' '))"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _identity_sql() -> str:
    """The products of openings and ends, numbered by group, question and answer."""
    parts = []
    for g, pair in enumerate(IDENTITY):
        q, a = ((f"[{', '.join(_text(x.replace('{name}', 'Palaver').replace('{org}', 'the team')) for x in side[0])}]", f"[{', '.join(_text(x.replace('{name}', 'Palaver').replace('{org}', 'the team')) for x in side[1])}]", len(side[1])) for side in pair)
        nq, na = len(pair[0][0]) * len(pair[0][1]), len(pair[1][0]) * len(pair[1][1])
        parts.append(f"SELECT {g} AS g, i, j, {q[0]}[i // {q[2]} + 1] || {q[1]}[i % {q[2]} + 1] AS question, {a[0]}[j // {a[2]} + 1] || {a[1]}[j % {a[2]} + 1] AS answer FROM range({nq}) q(i), range({na}) a(j)")
    return f"SELECT 'identity_' || (row_number() OVER (ORDER BY g, i, j) - 1) AS id, question, answer FROM ({' UNION ALL '.join(parts)})"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL = {
    "conv_clean_codes": f"WITH {_CLEAN} SELECT id, code::INT AS code, turns FROM z",
    "conv_clean_counts": f"WITH {_CLEAN} SELECT code::INT AS code, count(*) AS n FROM z GROUP BY code",
    "conv_role_filter": f"WITH {_C} SELECT id, len(conv)::INT AS turns FROM c WHERE len(conv) > 0 AND len(list_filter(conv, lambda x, i: x.f <> CASE WHEN i % 2 = 1 THEN 'human' ELSE 'gpt' END)) = 0",
    "conv_first_round": f"WITH {_C} SELECT id, least(len(conv), 2)::INT AS turns, conv[1].v AS first FROM c",
    "conv_model_filter": f"WITH {_C} SELECT id, model FROM c WHERE model = 'lynx-7b' OR model IS NULL",
    "conv_turn_index": f"WITH {_C}, t AS (SELECT id, unnest(range(len(conv)))::INT AS turn, conv FROM c) SELECT id, turn, (turn % 2)::INT AS parity, conv[turn + 1].f AS speaker FROM t",
    "conv_stats": f"WITH {_C}, t AS (SELECT conv, unnest(range(len(conv))) AS i FROM c), r AS (SELECT sum({_W.format('conv[i + 1].v')})::DOUBLE / count(conv[i + 1].v) AS t FROM t WHERE i % 2 = 1) SELECT count(*) AS conversations, round(avg(len(conv) // 2), 6) AS avg_rounds, round(any_value(r.t), 6) AS avg_response_tokens FROM c, r",
    "conv_sample": f"WITH {_C} SELECT id FROM c WHERE coalesce(list_sum(list_transform(conv, lambda m: coalesce(length(m.v), 0))), 0) <= 1500",
    "conv_train_test": "WITH p AS (SELECT battle_id AS id, row_number() OVER (ORDER BY ('0x' || substr(md5('0:' || battle_id), 1, 15))::BIGINT, battle_id) AS n, count(*) OVER () AS t FROM battles) SELECT id, CASE WHEN n <= floor(0.9::DOUBLE * t) THEN 'train' ELSE 'test' END AS part FROM p",
    "conv_shuffle": "SELECT battle_id AS id, ('0x' || substr(md5('42:' || battle_id), 1, 15))::BIGINT AS place FROM battles",
    "conv_merge": f"WITH {_C} SELECT id::VARCHAR AS id, model, len(conv)::INT AS turns, 0 AS part FROM c UNION ALL SELECT question_id::VARCHAR, NULL, len(turns)::INT, 1 FROM question",
    "conv_filter_format": r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text || CASE doc_id % 5 WHEN 0 THEN chr(10) || '1. one' || chr(10) || '1. again' WHEN 1 THEN chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || '1. new' ELSE '' END, '\n1\. [^2]*\n1\. ')",
    "doc_repetition_filter": "SELECT doc_id FROM documents WHERE regexp_matches(text || repeat((doc_id % 10)::VARCHAR, (doc_id % 4 + 7)::INT), '" + "|".join(f"{d}{{9}}" for d in "0123456789") + "')",
    "doc_lang_keep": "SELECT doc_id, lower(trim(lang)) AS code FROM documents WHERE coalesce(lower(trim(lang)), 'unknown') IN ('en', 'de', 'unknown')",
    "doc_lang_skip": "SELECT doc_id, lower(trim(lang)) AS code FROM documents WHERE coalesce(lower(trim(lang)), 'unknown') NOT IN ('en', 'und')",
    "doc_dedup_first": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
    "doc_length_hist": f"SELECT floor({_W.format('text')} / 20.0::DOUBLE)::BIGINT AS bucket, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "doc_counts": "SELECT nullif(lower(trim(source)), '') AS source, count(*) AS n, sum(length(text))::BIGINT AS chars, min(md5(text)) AS least_md5 FROM documents GROUP BY 1",
    "instruction_to_conv": "SELECT 'alpaca_' || question_id AS id, CASE WHEN length(trim(coalesce(turns[2], ''))) > 1 THEN turns[1] || chr(10) || 'Input:' || chr(10) || turns[2] ELSE turns[1] END AS prompt, coalesce(category, '') AS answer FROM question",
    "identity_rows": _identity_sql(),
    "doc_every_fifth": "SELECT doc_id FROM documents WHERE doc_id % 5 = 0",
    "conv_long_pairs": f"WITH {_C} SELECT id FROM c WHERE len(regexp_extract_all(conv[1].v, '[^ \\t\\n\\r\\f\\v]+')) > 5 AND len(regexp_extract_all(conv[2].v, '[^ \\t\\n\\r\\f\\v]+')) > 5",
    "page_strip_tags": rf"""WITH p AS (SELECT * FROM (VALUES {', '.join(f"({k}, {_text(x)}, {_text(y)})" for k, (x, y) in enumerate(PAGE_PARTS))}) v(k, head, tail)),
d AS (SELECT doc_id, regexp_replace(regexp_replace(head || text || tail, '<div.*?>', '', 'g'), '<span.*?>', '', 'g') AS t FROM documents JOIN p ON k = doc_id % {len(PAGE_PARTS)} WHERE text IS NOT NULL),
e AS (SELECT doc_id, trim(regexp_replace(trim(t, {_WS}), '(?s)```\s*(.*?)(?:Copy code)+(.+?)\s*?```', '```\1' || chr(10) || '\2' || chr(10) || '```', 'g'), {_WS}) AS t FROM d)
SELECT doc_id, trim(replace(regexp_replace(regexp_replace(regexp_replace(t, '^\d+ / \d+', ''), 'Copy\d+ chars / \d+ words', '', 'g'), '```(.*?)Copy code\s*```', '', 'g'), chr(10) || chr(10) || chr(10), chr(10)), {_WS}) AS text FROM e""",
    "conv_clean_cases": f"WITH v AS (SELECT * FROM (VALUES {', '.join(f'({k}, {code}, {left})' for k, (_, code, left) in enumerate(CLEAN_CASES))}) v(k, code, turns)) SELECT battle_id AS id, code, CASE WHEN code = 0 THEN turns END AS turns FROM battles JOIN v ON k = battle_id % {len(CLEAN_CASES)}",
    "conv_greedy_dedup": """WITH RECURSIVE o AS (SELECT battle_id AS id, coalesce(question_id, '') AS a, question_id IS NULL AS na, coalesce(conversation_a[1:2]::VARCHAR, '') AS b, conversation_a IS NULL AS nb, row_number() OVER (ORDER BY battle_id) AS n FROM battles),
s AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, []::VARCHAR[] AS sa, []::VARCHAR[] AS sb UNION ALL
SELECT o.n, CASE WHEN keep THEN o.id END, CASE WHEN keep AND NOT na THEN list_append(sa, a) ELSE sa END, CASE WHEN keep AND NOT nb THEN list_append(sb, b) ELSE sb END
FROM (SELECT s.sa, s.sb, o.*, NOT ((NOT na AND list_contains(sa, a)) OR (NOT nb AND list_contains(sb, b))) AS keep FROM s JOIN o ON o.n = s.n + 1) o)
SELECT id AS battle_id FROM s WHERE id IS NOT NULL""",
    "conv_split_long": f"""WITH RECURSIVE {_C}, e AS (SELECT id, conv, len(conv) // 2 AS n FROM c WHERE len(conv) > 1),
k AS (SELECT id, conv, n, list_transform(range(n), lambda i: len(string_split(conv[2 * i + 1].v, ' ')) + len(string_split(conv[2 * i + 2].v, ' ')) + 12) AS cost FROM e),
f AS (SELECT id, conv, n, cost, 0::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS cur, NULL::BIGINT AS b, NULL::BIGINT AS e FROM k UNION ALL
SELECT id, conv, n, cost, i + 1, CASE WHEN cur + cost[i + 1] > 120 THEN i ELSE start END, CASE WHEN cur + cost[i + 1] > 120 THEN cost[i + 1] ELSE cur + cost[i + 1] END,
CASE WHEN cur + cost[i + 1] > 120 OR i = n - 1 THEN start END, CASE WHEN cur + cost[i + 1] > 120 THEN i WHEN i = n - 1 THEN i + 1 END FROM f WHERE i < n),
r AS (SELECT id || '_' || 2 * b AS id, (2 * b)::INT AS begin, conv[2 * b + 1 : 2 * e] AS part FROM f WHERE b IS NOT NULL)
SELECT id, begin, len(part)::INT AS turns, len(part) > 0 AND len(list_filter(part, lambda x, i: x.f <> CASE WHEN i % 2 = 1 THEN 'human' ELSE 'gpt' END)) = 0 AS valid FROM r""",
}
