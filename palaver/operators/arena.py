"""Analytics of arena logs: votes, histograms, win matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions.text import IDENTITY_WORDS, VOTES, remove_html, rename_model, winner_of

DAY, HOUR = 86_400, 3_600


def identity_leak(messages_a: Column, messages_b: Column, words: tuple[str, ...] = IDENTITY_WORDS) -> Column:
    """Whether any non-empty message after the offset, both sides joined without separator, names a model."""
    text = F.lower(F.concat(*[F.array_join(F.filter(F.transform(m, lambda x: F.get(x, F.lit(1))), lambda x: x.isNotNull() & (x != "")), "") for m in (messages_a, messages_b)]))
    return F.rlike(text, F.lit("|".join(words)))


def classify_votes(log: DataFrame) -> DataFrame:
    """Add ``status`` and the fields of a battle to raw vote events.

    The status is the first that holds: not_vote, invalid (one public name empty, public
    and hidden names differ, no message after the offset), leak, anony, named. Hidden names
    missing from the state are the public ones.
    """
    public = F.transform(F.coalesce("models", F.array(F.lit(""), F.lit(""))), remove_html)
    log = log.withColumn("public", public)
    hidden = [F.coalesce(F.get("states", F.lit(k))["model_name"], F.get("public", F.lit(k))) for k in (0, 1)]
    p = [F.get("public", F.lit(k)) for k in (0, 1)]
    after = [F.slice(F.get("states", F.lit(k))["messages"], F.get("states", F.lit(k))["offset"] + 1, F.size(F.get("states", F.lit(k))["messages"])) for k in (0, 1)]
    short = [F.get("states", F.lit(k))["offset"] >= F.size(F.get("states", F.lit(k))["messages"]) for k in (0, 1)]
    anony = p[0].isin("", "Model A")
    status = (
        F.when(~F.col("type").isin(*VOTES) | F.col("type").isNull(), "not_vote")
        .when((p[0] == "") != (p[1] == ""), "invalid")
        .when(~anony & ((p[0] != hidden[0]) | (p[1] != hidden[1])), "invalid")
        .when(short[0] | short[1], "invalid")
        .when(identity_leak(after[0], after[1]), "leak")
        .when(anony, "anony")
        .otherwise("named")
    )
    roles = lambda m: F.transform(m, lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), F.get(x, F.lit(1)).alias("content")))
    return log.withColumn("status", status).select(
        "*",
        rename_model(hidden[0]).alias("model_a"),
        rename_model(hidden[1]).alias("model_b"),
        winner_of("type").alias("winner"),
        (F.col("status") == "anony").alias("anony"),
        F.try_divide(F.size(after[0]), F.lit(2)).cast("int").alias("turn"),
        roles(after[0]).alias("conversation_a"),
        roles(after[1]).alias("conversation_b"),
    )


def valid_battles(log: DataFrame) -> DataFrame:
    return classify_votes(log).where(F.col("status").isin("anony", "named"))


def battle_columns(battles: DataFrame, mode: str) -> DataFrame:
    """Column prune by mode: ``simple`` drops texts, ``conv_release`` keeps anonymous ones."""
    if mode == "simple":
        return battles.drop("conversation_a", "conversation_b", "question_id", "states", "models")
    if mode == "conv_release":
        return battles.where("anony").drop("rounds")
    return battles


def trailing_histogram(events: DataFrame, key: str, tstamp: str = "tstamp", keep_idle: bool = False) -> DataFrame:
    """Counts by key over all time, the last day and the last hour, anchored at the latest
    event; a key without an event in the last hour disappears unless ``keep_idle``."""
    last = events.agg(F.max(tstamp).alias("last"))
    held = events.join(F.broadcast(last))  # one row
    counts = held.groupBy(key).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col(tstamp) > F.col("last") - DAY).alias("n_day"), F.count_if(F.col(tstamp) > F.col("last") - HOUR).alias("n_hour"))
    return counts if keep_idle else counts.where("n_day > 0 and n_hour > 0")


def hourly(events: DataFrame, tstamp: str = "tstamp") -> DataFrame:
    """Events in each of 24 hours from the first event of the last day, zero-filled."""
    last = events.agg(F.max(tstamp).alias("last"))
    recent = events.join(F.broadcast(last)).where(F.col(tstamp) > F.col("last") - DAY).select(tstamp)
    base = recent.agg(F.min(tstamp).alias("base"))
    counted = recent.join(F.broadcast(base)).groupBy((F.floor((F.col(tstamp) - F.col("base")) / HOUR) + 1).cast("int").alias("hour")).count()
    hours = events.sparkSession.range(1, 25).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(counted.where("hour between 1 and 24")), "hour", "left").select("hour", F.coalesce("count", F.lit(0)).alias("n"))


def top_keys(events: DataFrame, group: str, key: str, k: int = 20) -> DataFrame:
    """The k most frequent keys of each group; ties by key."""
    counts = events.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), F.asc_nulls_first(key)))).where(F.col("rank") <= k)


def battle_matrix(battles: DataFrame) -> DataFrame:
    """Long form of the model by model counts: (model_a, model_b, n, a_wins, b_wins)."""
    return battles.groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("winner") == "model_a").alias("a_wins"), F.count_if(F.col("winner") == "model_b").alias("b_wins"))


def win_fraction(battles: DataFrame) -> DataFrame:
    """(model, opponent, wins, games, fraction): wins of ``model`` on either seat over games.

    As with aligned matrices, a pair is defined only if ``model`` has won on seat a against
    someone and on seat b against someone, and so has ``opponent`` lost on both seats.
    """
    m = battle_matrix(battles.where("winner in ('model_a', 'model_b')"))
    rows = m.select(F.explode(F.array(F.struct(F.col("model_a").alias("model"), F.col("model_b").alias("opponent"), F.col("a_wins").alias("wins"), "n"), F.struct(F.col("model_b").alias("model"), F.col("model_a").alias("opponent"), F.col("b_wins").alias("wins"), "n"))).alias("r")).select("r.*")
    pairs = rows.groupBy("model", "opponent").agg(F.sum("wins").alias("wins"), F.sum("n").alias("games"))
    won_a, won_b = m.where("a_wins > 0"), m.where("b_wins > 0")
    guard = lambda df, c, name: df.select(F.col(c).alias(name)).distinct()
    for name, sets in (("model", (guard(won_a, "model_a", "model"), guard(won_b, "model_b", "model"))), ("opponent", (guard(won_a, "model_b", "opponent"), guard(won_b, "model_a", "opponent")))):
        for s in sets:
            pairs = pairs.join(s, name, "left_semi")
    return pairs.withColumn("fraction", F.try_divide("wins", "games"))


def is_anonymous(models: Column | str) -> Column:
    """Whether the log hides the first model's name; a name like "Model A" is not hidden."""
    models = F.col(models) if isinstance(models, str) else models
    return F.coalesce(F.get(models, F.lit(0)) == "", F.lit(False))


def filled_matrix(battles: DataFrame, most: int = 2_000) -> DataFrame:
    """The counts of ``battle_matrix`` for every pair of models of the two seats, zero where
    there is no battle. The models are lists of at most ``most`` names (checked)."""
    m = battle_matrix(battles)
    a, b = m.select("model_a").distinct(), m.select("model_b").distinct()
    if max(a.count(), b.count()) > most:
        raise ValueError("a matrix is for a list of models")
    return a.join(F.broadcast(b)).join(m, ["model_a", "model_b"], "left").na.fill(0)


def average_win_rate(fractions: DataFrame) -> DataFrame:
    """Unweighted mean over opponents."""
    return fractions.groupBy("model").agg(F.avg("fraction").alias("win_rate"), F.count("fraction").alias("opponents"))


def pair_weights(models: DataFrame, boost: dict[str, float] | None = None) -> DataFrame:
    """Ordered pairs of different models with the normalised product of their weights.

    The pairs are the product of a model list of a few dozen names with itself; that is the
    result asked for, so the list's size is checked.
    """
    if models.count() > 2_000:
        raise ValueError("pair weights are for model lists, not for data")
    weight = F.coalesce(*[F.when(F.col("model") == m, F.lit(w)) for m, w in (boost or {}).items()], F.col("weight"))
    w = models.select("model", weight.alias("w"))
    a, b = w.toDF("model_a", "wa"), w.toDF("model_b", "wb")
    pairs = a.join(F.broadcast(b), F.col("model_a") != F.col("model_b")).withColumn("w", F.col("wa") * F.col("wb"))
    return pairs.join(F.broadcast(pairs.agg(F.sum("w").alias("total")))).select("model_a", "model_b", (F.col("w") / F.col("total")).alias("p"))


def medals(ratings: DataFrame, rating: str = "rating") -> DataFrame:
    """Rank with medals for the first three."""
    rank = F.row_number().over(W.orderBy(F.desc(rating), "model"))  # a leaderboard has as many rows as there are models
    return ratings.withColumn("rank", rank).withColumn("medal", F.when(F.col("rank") == 1, "gold").when(F.col("rank") == 2, "silver").when(F.col("rank") == 3, "bronze").otherwise(""))


def lost_to(battles: DataFrame, loser: str, winner: str) -> DataFrame:
    """Battles that ``loser`` lost against ``winner`` on either seat."""
    return battles.where(((F.col("model_a") == loser) & (F.col("model_b") == winner) & (F.col("winner") == "model_b")) | ((F.col("model_b") == loser) & (F.col("model_a") == winner) & (F.col("winner") == "model_a")))


def throughput(turns: DataFrame, prompt: str, answer: str, seconds: float) -> DataFrame:
    """Words produced in a second: words of answers less words of prompts, words between blanks."""
    return turns.agg((F.sum(F.size(F.split(answer, " ")) - F.size(F.split(prompt, " "))) / seconds).alias("words_per_second"))
