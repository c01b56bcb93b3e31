"""Judge analytics: matches, win rates, agreement, dedup, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.functions.verdicts import consistent, flip, is_tie, judge_family

NEED_REFERENCE = ("math", "reasoning", "coding")


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row of each key by order (a total one for a defined result)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def last_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return first_rows(df, key, [F.desc(c) for c in order])


def pair_results(judgments: DataFrame, strict: bool = False) -> DataFrame:
    """Two rows (model, win, loss, tie) per judgment: a tie if game 1 is a tie or the games
    differ; else model_1 wins if game 1 says so and model_2 otherwise, so that equal errors
    count for model_2. ``strict`` leaves errors out."""
    rows = judgments.where("g1_winner <> 'error' and g2_winner <> 'error'") if strict else judgments
    tie = (F.col("g1_winner") == "tie") | (F.col("g1_winner") != F.col("g2_winner")) | F.col("g1_winner").isNull() | F.col("g2_winner").isNull()
    first = ~tie & (F.col("g1_winner") == "model_1")
    second = ~tie & ~first
    row = lambda m, win, loss: F.struct(F.col(m).alias("model"), win.cast("int").alias("win"), loss.cast("int").alias("loss"), tie.cast("int").alias("tie"))
    return rows.select(F.explode(F.array(row("model_1", first, second), row("model_2", second, first))).alias("r")).select("r.*")


def pair_win_rates(judgments: DataFrame, baseline: str | None = None, strict: bool = False, models: list[str] | None = None) -> DataFrame:
    """Win, loss and tie counts and rates per model; with ``baseline`` only games against it, with
    ``models`` only games between listed models."""
    if models is not None:
        judgments = judgments.where(F.col("model_1").isin(*models) & F.col("model_2").isin(*models))
    rows = judgments.where((F.col("model_1") == baseline) | (F.col("model_2") == baseline)) if baseline else judgments
    sums = pair_results(rows, strict).groupBy("model").agg(F.sum("win").alias("win"), F.sum("loss").alias("loss"), F.sum("tie").alias("tie"))
    if baseline:
        sums = sums.where(F.col("model") != baseline)
    n = F.col("win") + F.col("loss") + F.col("tie")
    return sums.select("model", "win", "loss", "tie", (F.col("win") / n).alias("win_rate"), (F.col("loss") / n).alias("loss_rate"), ((F.col("win") + 0.5 * F.col("tie")) / n).alias("win_rate_adjusted"))


def mean_scores(scores: DataFrame) -> DataFrame:
    """Mean score by model and turn, and by model (turn null); unparsed scores of -1 count."""
    return scores.groupingSets([["model", "turn"], ["model"]], "model", "turn").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


def normalised(judgments: DataFrame) -> DataFrame:
    """Models in name order with the verdicts turned accordingly, and the joint verdict."""
    swap = F.col("model_1") > F.col("model_2")
    turned = lambda c: F.when(swap, flip(c)).otherwise(F.col(c))
    out = judgments.select("question_id", F.coalesce("turn", F.lit(1)).alias("turn"), F.get("judge", F.lit(0)).alias("judge"), F.least("model_1", "model_2").alias("model_1"), F.greatest("model_1", "model_2").alias("model_2"), turned("g1_winner").alias("g1"), turned("g2_winner").alias("g2"))
    return out.withColumn("winner", consistent("g1", "g2"))


def deduplicated(judgments: DataFrame, order: list[str], models: list[str] | None = None) -> DataFrame:
    """First judgment of each (question, models, judge); the model list is applied afterwards
    and to model_1 only."""
    rows = first_rows(judgments.withColumn("judge_key", F.array_join("judge", "|")), ["question_id", "model_1", "model_2", "judge_key"], order)
    return rows.where(F.col("model_1").isin(*models)) if models else rows


def missing_models(judgments: DataFrame, models: DataFrame) -> DataFrame:
    """Listed models without any judgment."""
    return models.select("model").join(judgments.select(F.col("model_1").alias("model")).distinct(), "model", "left_anti")


def agreement(votes: DataFrame, families: tuple[str, str], ban_ties: bool) -> DataFrame:
    """Agreement ratio of votes of two families on the same question and pair.

    Votes of a key are counted by value, and the number of agreeing and of all pairs follows
    from the counts, so no pairs of votes are built.
    """
    v = votes.withColumn("family", judge_family("judge")).where(F.col("family").isin(*families) & F.col("winner").isin("model_1", "model_2", "tie", "inconsistent"))
    v = v.withColumn("vote", F.when(F.col("winner") == "inconsistent", "tie").otherwise(F.col("winner")))
    if ban_ties:
        v = v.where(~is_tie("vote"))
    key = ["question_id", "turn", "model_1", "model_2"]
    count = v.groupBy(*key, "vote").agg(F.count_if(F.col("family") == families[0]).alias("x"), F.count_if(F.col("family") == families[1]).alias("y"))
    sums = count.groupBy(*key).agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * (F.col("x") - 1) / 2).alias("xx"))
    same, total = ("xx", F.col("nx") * (F.col("nx") - 1) / 2) if families[0] == families[1] else ("xy", F.col("nx") * F.col("ny"))
    return sums.agg(F.coalesce(F.sum(same), F.lit(0)).cast("double").alias("agree"), F.coalesce(F.sum(total), F.lit(0)).cast("double").alias("total")).withColumn("agreement", F.try_divide("agree", "total"))


def matches_all_pairs(answers: DataFrame, questions: DataFrame, multi_turn: bool = False) -> DataFrame:
    """Every unordered pair of models (by list position ``idx``) on every question both
    answered. Grouped by question, whose models are a list of bounded length."""
    rows = answers.join(questions.where(F.size("turns") == 2) if multi_turn else questions, "question_id").select("question_id", "category", "model_id", "idx")
    a, b = rows.select("question_id", "category", F.col("model_id").alias("model_1"), F.col("idx").alias("i")), rows.select("question_id", F.col("model_id").alias("model_2"), F.col("idx").alias("j"))
    return a.join(b, "question_id").where("i < j").select("question_id", "model_1", "model_2", F.col("category").isin(*NEED_REFERENCE).alias("needs_ref"))


def matches_baseline(answers: DataFrame, questions: DataFrame, baseline: str) -> DataFrame:
    rows = answers.join(questions, "question_id").select("question_id", "category", "model_id")
    base = rows.where(F.col("model_id") == baseline).select("question_id")
    return rows.where(F.col("model_id") != baseline).join(base, "question_id", "left_semi").select("question_id", F.col("model_id").alias("model_1"), F.lit(baseline).alias("model_2"), F.coalesce(F.col("category").isin(*NEED_REFERENCE), F.lit(False)).alias("needs_ref"))


def matches_single(answers: DataFrame, questions: DataFrame) -> DataFrame:
    return answers.join(questions, "question_id").select("question_id", F.col("model_id").alias("model"), F.coalesce(F.col("category").isin(*NEED_REFERENCE), F.lit(False)).alias("needs_ref"))


def missing_answers(answers: DataFrame, questions: DataFrame, models: DataFrame, most: int = 2_000) -> DataFrame:
    """Questions of each listed model without an answer. ``models`` is a list, of at most ``most``
    names (checked), so questions times models is what was asked for."""
    n = models.count()
    if n > most:
        raise ValueError(f"a list of models, not {n} rows")
    wanted = questions.select("question_id").join(F.broadcast(models.select("model_id")))
    return wanted.join(answers.select("question_id", "model_id").distinct(), ["question_id", "model_id"], "left_anti")


def assert_complete(missing: DataFrame) -> None:
    """Raise if any answer is missing, naming the first ones."""
    some = missing.limit(5).collect()
    if some:
        raise ValueError(f"answers are missing, among them {[tuple(r) for r in some]}")


def with_reference(matches: DataFrame, references: DataFrame, judge_model: str) -> DataFrame:
    """Matches that need a reference answer get that of the judging model (``references``: judge,
    question_id, turns; the last by ``tstamp`` counts), null if there is none; others get null."""
    last = references.where(F.col("judge") == judge_model).groupBy("question_id").agg(F.max_by("turns", "tstamp").alias("reference"))
    return matches.join(last, "question_id", "left").withColumn("reference", F.when(F.col("needs_ref"), F.col("reference")))


def vote_keys(votes: DataFrame, family: str, key: tuple[str, ...] = ("question_id", "turn", "model_1", "model_2"), check: bool = False) -> DataFrame:
    """Each key with its number of votes of a judge family. With ``check`` the query fails on a
    key that has not exactly one, as a comparison with people's votes asks."""
    n = F.count_if(judge_family("judge") == family)
    counted = votes.groupBy(*key).agg(n.alias("votes"))
    return counted.where(F.assert_true(F.col("votes") == 1, F.lit("a key has not exactly one vote")).isNull()) if check else counted


#: Ways of pairing answers for a judge, by name: each takes (answers, questions, baseline).
MATCHERS = {"pairs": lambda a, q, _: matches_all_pairs(a, q), "baseline": matches_baseline, "single": lambda a, q, _: matches_single(a, q)}


def matches(mode: str, answers: DataFrame, questions: DataFrame, baseline: str | None = None) -> DataFrame:
    """The matches of a run by the name of their strategy; own strategies are items of ``MATCHERS``."""
    return MATCHERS[mode](answers, questions, baseline)


def judge_route(category: str = "category", turn: str = "turn") -> Column:
    """Which of the four judges a game goes to."""
    hard, second = F.coalesce(F.col(category).isin(*NEED_REFERENCE), F.lit(False)), F.col(turn) > 1
    return F.when(hard & second, "pair-math-v1-multi-turn").when(hard, "pair-math-v1").when(second, "pair-v2-multi-turn").otherwise("pair-v2")


def looked_up(games: DataFrame, judgments: DataFrame) -> DataFrame:
    """Verdicts of asked games (question, models in any order), turned to the asked order;
    ``N/A`` where there is none. The first judgment of a key counts."""
    known = first_rows(normalised(judgments), ["question_id", "turn", "model_1", "model_2"], ["judge", "g1", "g2"])
    key = games.select("*", F.least("model_1", "model_2").alias("lo"), F.greatest("model_1", "model_2").alias("hi"))
    k = known.select("question_id", "turn", F.col("model_1").alias("lo"), F.col("model_2").alias("hi"), "g1", "g2")
    swap = F.col("model_1") > F.col("model_2")
    return key.join(k, ["question_id", "turn", "lo", "hi"], "left").select("question_id", "turn", "model_1", "model_2", F.coalesce(F.when(swap, flip("g2")).otherwise(F.col("g1")), F.lit("N/A")).alias("g1"), F.coalesce(F.when(swap, flip("g1")).otherwise(F.col("g2")), F.lit("N/A")).alias("g2"))


