import random

import numpy as np

from palaver.llm.springrank import clean_votes, spring_rank


def solved(votes, alpha=0.1):
    names = sorted({m for a, b, _ in votes for m in (a, b)})
    at = {m: k for k, m in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b, p in votes:
        w[at[a], at[b]] += p
        w[at[b], at[a]] += 1 - p
    both = w + w.T
    m = alpha * np.eye(len(names)) + np.diag(both.sum(1)) - both
    s = np.linalg.solve(m, w.sum(1) - w.sum(0))
    return dict(zip(names, s - s.mean(), strict=True))


def test_equals_the_direct_solution(spark):
    rng = random.Random(1)
    names = [f"m{k}" for k in range(12)]
    votes = []
    for _ in range(400):
        a, b = rng.sample(range(12), 2)
        votes.append((names[a], names[b], 1.0 if rng.random() < 1 / (1 + 2 ** (b - a)) else rng.choice([0.0, 0.5])))
    votes += [("lone1", "lone2", 1.0)]  # another component
    found = {r.model: r.strength for r in spring_rank(spark.createDataFrame(votes, "model_a string, model_b string, points double")).collect()}
    want = solved(votes)
    assert found.keys() == want.keys()
    assert max(abs(found[m] - want[m]) for m in want) < 1e-6


def test_ties_share_a_rank_and_counts(spark):
    votes = [("a", "b", 0.5), ("c", "d", 1.0)]
    rows = {r.model: r for r in spring_rank(spark.createDataFrame(votes, "model_a string, model_b string, points double")).collect()}
    assert rows["a"].rank == rows["b"].rank == 2 and rows["c"].rank == 1 and rows["d"].rank == 4
    assert (rows["a"].ties, rows["c"].wins, rows["d"].losses) == (1, 1, 1)


def test_cleaning(spark):
    s = "battle_id bigint, question_id string, model_a string, model_b string, winner string, tstamp double, extra string"
    rows = [(1, "q", "A", " b", "model_a", 1.0, "x"), (2, "q", "A", " b", "model_a", 1.0, "x"), (3, "r", "a", "A ", "tie", 1.0, "x"), (4, "s", "a", "b", None, 1.0, "x"), (5, None, "a", "b", "tie", 1.0, "x"), (6, None, "a", "b", "tie", 1.0, "x"), (7, "t", None, "b", "tie", 1.0, "x"), (8, "u", "a", "b", "odd", 1.0, "x")]
    votes = clean_votes(spark.createDataFrame(rows, s)).collect()
    assert sorted((v.model_a, v.model_b, v.points) for v in votes) == [("a", "b", 0.5), ("a", "b", 0.5), ("a", "b", 1.0)]


def test_empty(spark):
    assert spring_rank(spark.createDataFrame([], "model_a string, model_b string, points double")).count() == 0
