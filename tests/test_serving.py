import random

import pytest
from pyspark.sql import functions as F

from palaver.operators import calls, judge, ratings, serving
from palaver.operators.curate import drawn, poisson_limits, shuffled_take, train_test
from palaver.streaming import monitor


def test_calls_try_again_and_lose_only_the_bad_request(spark):
    def make():
        seen = {"n": 0}

        def client(requests):
            seen["n"] += 1
            if "bad" in requests or seen["n"] < 3 and len(requests) > 1:
                raise ValueError("no")
            return [r.upper() for r in requests]

        return client

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "b")], "id int, t string").coalesce(1)
    got = {r.id: r.reply for r in calls.called(df, F.col("t"), make, "reply", attempts=4, wait=0.0).collect()}
    assert got == {1: "A", 2: None, 3: "$ERROR$", 4: "B"}
    good = df.where("t <> 'bad'")
    assert {r.id: r.reply for r in calls.called(good, F.col("t"), make, "reply", attempts=4, wait=0.0).collect()} == {1: "A", 4: "B"}
    assert calls.called(df.limit(0), F.col("t"), make, "reply").count() == 0


def test_cards_of_unknown_models(spark):
    models = spark.createDataFrame([("b1", 1), ("zz", 2), ("b2", 3), ("a", 4)], "model string, o int")
    registry = spark.createDataFrame([("a", "a", "l", "first", 1), ("b1", "b", "l", "second", 2), ("b2", "b", "l", "third", 3)], "model string, simple_name string, link string, description string, place int")
    got = sorted(tuple(r) for r in serving.model_cards(models, registry, "o", "?", width=2).collect())
    assert got == [(0, 0, "b", "b: second"), (0, 1, "zz", "zz: ?"), (1, 0, "a", "a: first")]
    assert [r.model for r in serving.by_priority(models, registry).orderBy("priority").collect()] == ["a", "b1", "b2", "zz"]


def test_fill_leaves_places_inside_values(spark):
    df = spark.createDataFrame([("{b}", None)], "a string, b string")
    assert df.select(serving.fill(F.lit("<{a}|{b}|{c}>"), {"a": F.col("a"), "b": F.col("b")})).first()[0] == "<{b}||{c}>"


def test_missing_answers_and_votes_are_reported(spark):
    q = spark.createDataFrame([(1,), (2,)], "question_id int")
    a = spark.createDataFrame([(1, "m"), (2, "m"), (1, "n")], "question_id int, model_id string")
    missing = judge.missing_answers(a, q, a.select("model_id").distinct())
    with pytest.raises(ValueError, match="missing"):
        judge.assert_complete(missing)
    judge.assert_complete(missing.where("model_id = 'm'"))
    with pytest.raises(ValueError, match="list"):
        judge.missing_answers(a, q, a.select("model_id").distinct(), most=1)
    votes = spark.createDataFrame([(1, 1, "a", "b", "x-judge")] * 2, "question_id int, turn int, model_1 string, model_2 string, judge string")
    assert judge.vote_keys(votes, "gpt4-pair").first().votes == 2
    with pytest.raises(Exception, match="exactly one"):
        judge.vote_keys(votes, "gpt4-pair", check=True).collect()


def test_elo_in_parts_and_batches_equals_the_fold(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, float(k // 2), rng.choice("abcd"), rng.choice("efg"), rng.choice(["model_a", "model_b", "tie", None])) for k in range(300)]
    df = spark.createDataFrame(rows, "battle_id int, tstamp double, model_a string, model_b string, winner string")
    one = {r.model: r.rating for r in ratings.online_elo(df, ["tstamp", "battle_id"]).collect()}
    parts = {r.model: r.rating for r in ratings.online_elo(df, ["tstamp", "battle_id"], portion=40).collect()}
    sink = monitor.elo_batches(str(tmp_path), ["tstamp", "battle_id"])
    for k in range(3):
        sink(df.where(f"battle_id >= {100 * k} and battle_id < {100 * (k + 1)}"), k)
    stream = {r.model: r.rating for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert one == pytest.approx(parts) and one == pytest.approx(stream) and len(one) == 7
    assert ratings.online_elo(df.limit(0), ["tstamp", "battle_id"]).count() == 0


def test_samples(spark):
    df = spark.range(20_000)
    assert abs(drawn(df, "id", 1).agg(F.sum("times")).first()[0] - 20_000) < 500
    assert poisson_limits()[0] == int(2.718281828459045**-1 * 2**60)
    assert shuffled_take(df.repartition(7), "id", 10, 3).collect() == shuffled_take(df, "id", 10, 3).collect()
    parts = train_test(df, "id", 0.75)
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {"train": 15_000, "test": 5_000}
