import random

import pytest

from palaver.llm.consensus import NotConverged, consensus, verdicts

SCHEMA = "question_id bigint, model_1 string, model_2 string, g1_winner string, g2_winner string, judge array<string>, g1_judgment string, turn int, tstamp double, extra string"


def judged(spark, rows):
    return spark.createDataFrame([(q, a, b, g1, g2, j, None, t, float(k), "x") for k, (q, a, b, g1, g2, j, t) in enumerate(rows)], SCHEMA)


def simulated(items=150, seed=3):
    """Items with a true verdict; careful annotators, noisy ones, and one who picks the first seat."""
    rng = random.Random(seed)
    truth, rows = {}, []
    skill = {"a1": 0.9, "a2": 0.8, "n1": 0.4, "n2": 0.36, "n3": 0.34, "first": None}
    for q in range(items):
        truth[q] = rng.choice(["model_1", "model_2", "tie"])
        for name, p in skill.items():
            flip = rng.random() < 0.5
            if p is None:
                g = ["model_1", "model_2"]
            else:
                g = [truth[q] if rng.random() < p else rng.choice(["model_1", "model_2", "tie"]) for _ in range(2)]
                if flip:
                    g = [{"model_1": "model_2", "model_2": "model_1"}.get(x, x) for x in g]
            rows.append((q, "b" if flip else "a", "a" if flip else "b", g[0], g[1], [name, "x"], 1))
    return truth, rows


def test_beats_plain_majority_and_finds_the_careful(spark):
    truth, rows = simulated()
    items, annotators = consensus(judged(spark, rows))
    found = {r.question_id: r.winner for r in items.collect()}
    right = sum(found[q] == t for q, t in truth.items()) / len(truth)
    votes = {}
    for q, a, _, g1, g2, _, _ in rows:
        for g in (g1, g2):
            g = {"model_1": "model_2", "model_2": "model_1"}.get(g, g) if a == "b" else g
            votes.setdefault(q, []).append(g)
    plain = sum(max(("model_1", "model_2", "tie"), key=votes[q].count) == t for q, t in truth.items()) / len(truth)
    assert right >= 0.85 and right > plain
    r = {x.annotator: x.reliability for x in annotators.collect()}
    assert r["a1"] > r["a2"] > max(r["n1"], r["n2"], r["n3"]) and abs(r["first"]) < 0.25


def test_repeats_nulls_and_order_of_models(spark):
    rows = [(1, "b", "a", "model_1", "model_1", ["x"], None), (1, "a", "b", "model_2", None, ["y"], 1), (1, "a", "b", "error", "model_2", ["z"], 1), (2, "a", "b", "error", None, ["x"], 1), (3, None, "b", "tie", "tie", ["x"], 1), (4, "a", "b", "tie", "tie", None, 1)]
    df = judged(spark, rows)
    items, _ = consensus(df.union(df))
    found = {(r.question_id, r.turn): r for r in items.collect()}
    assert set(found) == {(1, 1), (2, 1)}
    assert found[1, 1].winner == "model_2" and found[1, 1].model_1 == "a" and found[1, 1].annotators == 3
    assert found[2, 1].winner == "tie" and found[2, 1].agreement is None


def test_verdict_rows_count_once(spark):
    df = judged(spark, [(1, "a", "b", "model_1", "tie", ["x"], 1)])
    assert verdicts(df.union(df)).count() == 2


def test_empty(spark):
    items, annotators = consensus(judged(spark, []))
    assert items.count() == 0 and annotators.count() == 0


def known_skill(spark, items, seed, offset=0, names="abcdefghijklmnopqrstuvwx"):
    """Annotators who know the answer with a known probability, five to an item."""
    rng = random.Random(seed)
    skill = {n: k / len(names) * 0.9 for k, n in enumerate(names)}
    rows = []
    for q in range(offset, offset + items):
        truth = rng.choice(["model_1", "model_2", "tie"])
        for n in rng.sample(names, 5):
            rows.append((q, "a", "b", *[truth if rng.random() < skill[n] else rng.choice(["model_1", "model_2", "tie"]) for _ in range(2)], [n], 1))
    return skill, rows


@pytest.mark.parametrize("items,bound", [(180, 0.16), (1800, 0.05), (20_000, 0.03)])
def test_reliabilities_converge_to_the_known_ones(spark, items, bound):
    skill, rows = known_skill(spark, items, seed=5)
    _, annotators = consensus(judged(spark, rows))
    found = {x.annotator: x.reliability for x in annotators.collect()}
    assert sum(abs(found[n] - skill[n]) for n in skill) / len(skill) < bound


def test_groups_without_shared_items_have_reliabilities_of_their_own(spark):
    one, rows = known_skill(spark, 600, seed=1, names="abcdef")
    two, more = known_skill(spark, 200, seed=2, offset=600, names="uvwxyz")
    _, annotators = consensus(judged(spark, rows + more + [(9000, "a", "b", "tie", "tie", ["alone"], 1)]))
    found = {x.annotator: x.reliability for x in annotators.collect()}
    assert found["alone"] == 0
    for skill in (one, two):
        assert max(abs(found[n] - skill[n]) for n in skill) < 0.25


def test_two_annotators_do_not_swing(spark):
    rows = [(q, "a", "b", *(["model_1"] * 2 if q % 2 else ["model_2"] * 2), [n], 1) for q in range(40) for n in "xy"]
    _, annotators = consensus(judged(spark, rows))
    assert all(x.reliability > 0.8 for x in annotators.collect())
    rows = [(q, "a", "b", *(["model_1"] * 2 if (q % 2) == (n == "x") else ["model_2"] * 2), [n], 1) for q in range(40) for n in "xy"]
    _, annotators = consensus(judged(spark, rows))
    assert all(x.reliability == 0 for x in annotators.collect())


def test_raises_where_it_does_not_settle(spark):
    _, rows = known_skill(spark, 60, seed=3)
    with pytest.raises(NotConverged):
        consensus(judged(spark, rows), rounds=1, tol=1e-9)
