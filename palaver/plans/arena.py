"""Arena queries: battles, histograms, win matrices, ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.text import IDENTITY_WORDS, day_of, half_up, time_of
from palaver.operators import arena, ratings
from palaver.session import canonical_name, table


def battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Battles with canonical model names, without the texts."""
    b = table(spark, sf_dir, "battles").drop("conversation_a", "conversation_b")
    return b.withColumns({c: canonical_name(c) for c in ("model_a", "model_b")})


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw vote events as a serving log has them, derived from the battles; every 11th event
    has no message after its offset, every 13th names one model only, every 17th is a share."""
    b = table(spark, sf_dir, "battles")
    state = lambda side: F.struct(
        canonical_name(f"model_{side}").alias("model_name"),
        F.when(F.col("battle_id") % 11 == 0, F.size(f"conversation_{side}")).otherwise(0).alias("offset"),
        F.transform(f"conversation_{side}", lambda m: F.array(m["role"], m["content"])).alias("messages"),
    )
    kind = F.when(F.col("battle_id") % 17 == 0, "share").when(F.col("winner") == "model_a", "leftvote").when(F.col("winner") == "model_b", "rightvote").when(F.col("winner") == "tie", "tievote").when(F.col("winner") == "tie (bothbad)", "bothbad_vote")
    name = lambda side: F.when(F.col("anony"), F.lit("")).otherwise(canonical_name(f"model_{side}"))
    return b.select("battle_id", kind.alias("type"), F.array(name("a"), F.when(F.col("battle_id") % 13 == 0, F.lit("")).otherwise(name("b"))).alias("models"), F.array(state("a"), state("b")).alias("states"), "tstamp", "ip")


def arena_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.classify_votes(log(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def arena_battles_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = arena.battle_columns(arena.valid_battles(log(spark, sf_dir)), "simple")
    return b.select("battle_id", "model_a", "model_b", "winner", "anony", "turn", "tstamp")


def arena_battles_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = arena.battle_columns(arena.valid_battles(log(spark, sf_dir)), "conv_release")
    return b.select("battle_id", "model_a", "model_b", "winner", F.size("conversation_a").alias("messages"), F.try_element_at("conversation_a", F.lit(-1))["role"].alias("last_role"))


def arena_type_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.trailing_histogram(battles(spark, sf_dir), "winner")


def arena_model_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = battles(spark, sf_dir).select("tstamp", F.explode(F.array("model_a", "model_b")).alias("model"))
    return arena.trailing_histogram(b, "model", keep_idle=True)


def arena_hourly_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.hourly(battles(spark, sf_dir))


def arena_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return battles(spark, sf_dir).where("tstamp is not null").groupBy(day_of("tstamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def arena_local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return battles(spark, sf_dir).where("tstamp is not null").select("battle_id", time_of("tstamp").alias("local_time"))


def arena_top_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = battles(spark, sf_dir).where("ip is not null").select("ip", F.explode(F.array("model_a", "model_b")).alias("model"))
    return arena.top_keys(b, "model", "ip", 20)


def arena_server_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by server and day: the pruned log scan's partitions."""
    return battles(spark, sf_dir).groupBy("server", day_of("tstamp", "UTC").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def arena_battle_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.battle_matrix(battles(spark, sf_dir))


def arena_win_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.win_fraction(battles(spark, sf_dir)).withColumn("fraction", F.round("fraction", 6))


def arena_model_winrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = arena.average_win_rate(arena.win_fraction(battles(spark, sf_dir)))
    return rate.withColumn("win_rate", F.round("win_rate", 6))


def arena_model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = battles(spark, sf_dir).select(F.explode(F.array("model_a", "model_b")).alias("model")).where("model is not null").distinct()
    boost = {"heron-13b": 5.0, "lynx-7b": 5.0}
    return arena.pair_weights(names.withColumn("weight", F.lit(1.0)), boost).withColumn("p", F.round("p", 9))


def arena_lost_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.lost_to(battles(spark, sf_dir), "heron-13b", "lynx-7b").select("battle_id", "model_a", "model_b", "winner")


def elo_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = battles(spark, sf_dir).where("tstamp is not null and model_a <> model_b")
    return ratings.online_elo(b, ["tstamp", "battle_id"]).withColumn("rating", F.round("rating", 6))


def elo_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = battles(spark, sf_dir).where("tstamp is not null and model_a <> model_b")
    board = arena.medals(ratings.online_elo(b, ["tstamp", "battle_id"]))
    return board.select("model", "rank", "medal", half_up("rating").alias("rating"))


def elo_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = battles(spark, sf_dir).where("model_a <> model_b")
    return ratings.interval(ratings.bootstrap_elo(b, rounds=1000))


NAMES = ["arena_status_counts", "arena_battles_clean", "arena_battles_release", "arena_type_hist", "arena_model_hist", "arena_hourly_24", "arena_daily_counts", "arena_local_times", "arena_top_ip", "arena_server_counts", "arena_battle_matrix", "arena_win_fraction", "arena_model_winrate", "arena_model_pairs", "arena_lost_to", "elo_online", "elo_leaderboard", "elo_bootstrap_ci"]
QUERIES = {n: globals()[n] for n in NAMES}

_B = "b AS (SELECT * REPLACE (lower(trim(model_a)) AS model_a, lower(trim(model_b)) AS model_b) FROM battles)"
_LEAK = "|".join(IDENTITY_WORDS)
_LOG = f"""{_B}, e AS (SELECT *, CASE WHEN battle_id % 17 = 0 THEN 'share' WHEN winner IS NULL THEN NULL ELSE winner END AS kind,
  CASE WHEN anony THEN '' ELSE model_a END AS pa, CASE WHEN battle_id % 13 = 0 THEN '' WHEN anony THEN '' ELSE model_b END AS pb,
  lower(coalesce(array_to_string(list_transform(list_filter(CASE WHEN battle_id % 11 = 0 THEN [] ELSE conversation_a END, lambda m: m.content IS NOT NULL AND m.content <> ''), lambda m: m.content), ''), '')
  || coalesce(array_to_string(list_transform(list_filter(CASE WHEN battle_id % 11 = 0 THEN [] ELSE conversation_b END, lambda m: m.content IS NOT NULL AND m.content <> ''), lambda m: m.content), ''), '')) AS said FROM b),
c AS (SELECT *, CASE WHEN kind IS NULL OR kind = 'share' THEN 'not_vote' WHEN (pa = '') <> (pb = '') THEN 'invalid' WHEN pa NOT IN ('', 'Model A') AND (pa <> model_a OR pb <> model_b) THEN 'invalid'
  WHEN battle_id % 11 = 0 THEN 'invalid' WHEN regexp_matches(said, '{_LEAK}') THEN 'leak' WHEN pa IN ('', 'Model A') THEN 'anony' ELSE 'named' END AS status FROM e)"""
_M = """m AS (SELECT model_a, model_b, count(*) AS n, count(*) FILTER (winner = 'model_a') AS a_wins, count(*) FILTER (winner = 'model_b') AS b_wins FROM b WHERE winner IN ('model_a', 'model_b') GROUP BY ALL)"""
_F = f"""{_B}, {_M}, r AS (SELECT model_a AS model, model_b AS opponent, a_wins AS wins, n FROM m UNION ALL SELECT model_b, model_a, b_wins, n FROM m),
p AS (SELECT model, opponent, sum(wins)::BIGINT AS wins, sum(n)::BIGINT AS games FROM r GROUP BY ALL),
f AS (SELECT *, wins::DOUBLE / games AS fraction FROM p WHERE model IN (SELECT model_a FROM m WHERE a_wins > 0) AND model IN (SELECT model_b FROM m WHERE b_wins > 0)
  AND opponent IN (SELECT model_b FROM m WHERE a_wins > 0) AND opponent IN (SELECT model_a FROM m WHERE b_wins > 0))"""
_ELO = f"""WITH RECURSIVE {_B}, o AS (SELECT row_number() OVER (ORDER BY tstamp, battle_id) AS k, model_a, model_b, CASE winner WHEN 'model_a' THEN 1.0::DOUBLE WHEN 'model_b' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS s
  FROM b WHERE tstamp IS NOT NULL AND model_a <> model_b AND winner IS NOT NULL),
g AS (SELECT 0::BIGINT AS k, MAP([]::VARCHAR[], []::DOUBLE[]) AS m UNION ALL
  SELECT k, map_concat(m, MAP([model_a, model_b], [ra + 4.0::DOUBLE * (s - 1 / (1 + pow(10::DOUBLE, (rb - ra) / 400))), rb + 4.0::DOUBLE * (1 - s - 1 / (1 + pow(10::DOUBLE, (ra - rb) / 400)))]))
  FROM (SELECT o.k, g.m, o.model_a, o.model_b, o.s, coalesce(g.m[o.model_a], 1000::DOUBLE) AS ra, coalesce(g.m[o.model_b], 1000::DOUBLE) AS rb FROM g JOIN o ON o.k = g.k + 1)),
z AS (SELECT unnest(map_entries(m)) AS x FROM g WHERE k = (SELECT max(k) FROM g)), l AS (SELECT x.key AS model, x.value AS rating FROM z)"""

SQL = {
    "arena_status_counts": f"WITH {_LOG} SELECT status, count(*) AS n FROM c GROUP BY status",
    "arena_battles_clean": f"WITH {_LOG} SELECT battle_id, replace(model_a, 'bard', 'palm-2') AS model_a, replace(model_b, 'bard', 'palm-2') AS model_b, winner, status = 'anony' AS anony, (len(conversation_a) // 2)::INT AS turn, tstamp FROM c WHERE status IN ('anony', 'named')",
    "arena_battles_release": f"WITH {_LOG} SELECT battle_id, replace(model_a, 'bard', 'palm-2') AS model_a, replace(model_b, 'bard', 'palm-2') AS model_b, winner, len(conversation_a)::INT AS messages, CASE WHEN len(conversation_a) % 2 = 1 THEN 'user' ELSE 'assistant' END AS last_role FROM c WHERE status = 'anony'",
    "arena_type_hist": "WITH l AS (SELECT max(tstamp) AS t FROM battles), h AS (SELECT winner, count(*) AS n_all, count(*) FILTER (tstamp > t - 86400) AS n_day, count(*) FILTER (tstamp > t - 3600) AS n_hour FROM battles, l GROUP BY winner) SELECT * FROM h WHERE n_day > 0 AND n_hour > 0",
    "arena_model_hist": f"WITH {_B}, l AS (SELECT max(tstamp) AS t FROM b), u AS (SELECT tstamp, unnest([model_a, model_b]) AS model FROM b) SELECT model, count(*) AS n_all, count(*) FILTER (tstamp > t - 86400) AS n_day, count(*) FILTER (tstamp > t - 3600) AS n_hour FROM u, l GROUP BY model",
    "arena_hourly_24": "WITH l AS (SELECT max(tstamp) AS t FROM battles), d AS (SELECT tstamp FROM battles, l WHERE tstamp > t - 86400), z AS (SELECT min(tstamp) AS b0 FROM d), c AS (SELECT (floor((tstamp - b0) / 3600) + 1)::INT AS hour, count(*) AS n FROM d, z GROUP BY 1) SELECT h::INT AS hour, coalesce(n, 0) AS n FROM range(1, 25) r(h) LEFT JOIN c ON c.hour = h",
    "arena_daily_counts": "SELECT strftime(timezone('US/Pacific', to_timestamp(floor(tstamp))), '%Y-%m-%d') AS day, count(*) AS n FROM battles WHERE tstamp IS NOT NULL GROUP BY 1",
    "arena_local_times": "SELECT battle_id, strftime(timezone('US/Pacific', to_timestamp(floor(tstamp))), '%Y-%m-%d %H:%M:%S') AS local_time FROM battles WHERE tstamp IS NOT NULL",
    "arena_top_ip": f"WITH {_B}, u AS (SELECT ip, unnest([model_a, model_b]) AS model FROM b WHERE ip IS NOT NULL), c AS (SELECT model, ip, count(*) AS n FROM u GROUP BY ALL) SELECT model, ip, n, (row_number() OVER (PARTITION BY model ORDER BY n DESC, ip))::INT AS rank FROM c QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, ip) <= 20",
    "arena_server_counts": "SELECT server, strftime(timezone('UTC', to_timestamp(floor(tstamp))), '%Y-%m-%d') AS day, count(*) AS n FROM battles GROUP BY 1, 2",
    "arena_battle_matrix": f"WITH {_B} SELECT model_a, model_b, count(*) AS n, count(*) FILTER (winner = 'model_a') AS a_wins, count(*) FILTER (winner = 'model_b') AS b_wins FROM b GROUP BY ALL",
    "arena_win_fraction": f"WITH {_F} SELECT model, opponent, wins, games, round(fraction, 6) AS fraction FROM f",
    "arena_model_winrate": f"WITH {_F} SELECT model, round(avg(fraction), 6) AS win_rate, count(fraction) AS opponents FROM f GROUP BY model",
    "arena_model_pairs": f"WITH {_B}, n AS (SELECT DISTINCT unnest([model_a, model_b]) AS model FROM b), w AS (SELECT model, CASE WHEN model IN ('heron-13b', 'lynx-7b') THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM n WHERE model IS NOT NULL), p AS (SELECT x.model AS model_a, y.model AS model_b, x.w * y.w AS w FROM w x, w y WHERE x.model <> y.model) SELECT model_a, model_b, round(w / (SELECT sum(w) FROM p), 9) AS p FROM p",
    "arena_lost_to": f"WITH {_B} SELECT battle_id, model_a, model_b, winner FROM b WHERE (model_a = 'heron-13b' AND model_b = 'lynx-7b' AND winner = 'model_b') OR (model_b = 'heron-13b' AND model_a = 'lynx-7b' AND winner = 'model_a')",
    "elo_online": f"{_ELO} SELECT model, round(rating, 6) AS rating FROM l",
    "elo_leaderboard": f"{_ELO} SELECT model, (row_number() OVER (ORDER BY rating DESC, model))::INT AS rank, CASE row_number() OVER (ORDER BY rating DESC, model) WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' ELSE '' END AS medal, floor(rating + 0.5)::INT AS rating FROM l",
}
