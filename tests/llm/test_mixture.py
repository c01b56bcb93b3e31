import os
import random

import numpy as np
import pytest

from palaver.llm.mixture import TOKENIZER, encoding, fit_budget, mix, plan, token_counts

needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")


def test_fit_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(2, 40), 5))
        counts = [rng.randint(1, 6) for _ in lengths]
        budget = rng.randint(1, sum(a * n for a, n in zip(lengths, counts, strict=True)))
        sums = {0}
        for a, n in zip(lengths, counts, strict=True):
            sums = {s + k * a for s in sums for k in range(n + 1)}
        best = max(s for s in sums if s <= budget)
        take, total = fit_budget(np.array(lengths), np.array(counts), budget)
        assert total == best == int((take * np.array(lengths)).sum())
        assert (take <= np.array(counts)).all()


def test_fit_of_large_budgets_is_near():
    lengths, counts = np.arange(50, 900), np.full(850, 1000)
    take, total = fit_budget(lengths, counts, 123_456_789)
    assert total == 123_456_789 and (take <= counts).all()


def test_fit_keeps_the_mean_length_at_every_size():
    lengths, counts = np.arange(20, 420), np.ones(400, np.int64)
    mean = float((lengths * counts).sum() / counts.sum())
    for times, budget in ((1, 3000), (1, 20_000), (1, 60_000), (50, 300_000), (5000, 30_000_000)):
        take, total = fit_budget(lengths, counts * times, budget)
        assert total == budget and abs((take * lengths).sum() / take.sum() - mean) < 0.15 * mean, budget
        assert take[200:].sum() > 0.4 * take.sum(), budget


def test_fit_asks_every_length():
    """One pair of very long texts gives the budget; no length may be left out to save room."""
    lengths = np.array([*range(200_000, 200_400, 2), 300_001, 300_003])
    take, total = fit_budget(lengths, np.ones(len(lengths), np.int64), 600_004)
    assert total == 600_004 and take[-1] == take[-2] == 1


def test_fit_meets_budgets_of_sparse_lengths():
    lengths = np.arange(2, 60_000, 3)
    take, total = fit_budget(lengths, np.ones(len(lengths), np.int64), 5_000_000)
    assert total == 5_000_000 == int((take * lengths).sum()) and take.max() == 1


def test_fit_stops_at_the_common_divisor():
    lengths, counts = np.array([6, 10, 14]), np.array([10**9, 10**9, 10**9])
    assert fit_budget(lengths, counts, 10**9 + 1)[1] == 10**9
    # 1000 and 1001: the budget needs one certain mixture of the two
    lengths = np.array([1000, 1001])
    take, total = fit_budget(lengths, np.array([10**6, 10**6]), 500_000_777)
    assert total == 500_000_777 == int((take * lengths).sum())


def test_plan():
    shares, repeats = {"a": 0.5, "b": 0.4, "c": 0.05, "d": 0.05}, {"a": 1, "b": 2, "c": 4, "d": 3}
    total, budgets = plan({"a": 1000, "b": 1000, "c": 10}, shares, repeats)
    assert budgets["c"] == 40 and budgets["d"] == 0 and budgets["a"] == 1000 and budgets["b"] == 800 and total == 2000
    assert plan({"a": 1000, "b": 1000, "c": 10}, shares, repeats, slack=0.05)[0] == 800
    assert plan({"a": 1000, "b": 1000, "c": 10}, shares, repeats, slack=0.0)[0] == 0
    assert plan({}, shares, repeats) == (0, dict.fromkeys(shares, 0))
    assert plan({"a": 10, "b": 10, "c": 10, "d": 10}, shares, repeats, total=100)[1] == {"a": 10, "b": 20, "c": 5, "d": 5}
    assert plan({}, {}, {}) == (0, {})


def test_plan_never_jumps():
    """A scarce source grows from nothing: the total moves in step, and doubles with all sizes."""
    shares, repeats = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, dict.fromkeys("abcd", 1)
    last = None
    for d in range(0, 3000, 5):
        sizes = {"a": 4000, "b": 3000, "c": 2000, "d": d}
        total, budgets = plan(sizes, shares, repeats)
        assert last is None or abs(total - last) <= 51, d
        assert budgets["d"] == min(d, round(total * 0.1))
        last = total
        assert abs(plan({s: 10 * n for s, n in sizes.items()}, shares, repeats)[0] - 10 * total) <= 10
    for slack in (0.0, 0.12, 0.5):
        steps = [plan({"a": 4000, "b": 3000, "c": c, "d": 400}, shares, repeats, slack)[0] for c in range(0, 3000, 5)]
        assert max(abs(x - y) for x, y in zip(steps, steps[1:], strict=False)) <= 26


@needs_tokenizer
def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("word" for _ in range(rng.randint(3, 60))), rng.choice(["Big", " big ", "small", "other", None]) if k % 5 else "big", "x") for k in range(400)]
    rows += [(900, None, "big", "x"), (901, "", "small", "x"), (902, "word " * 20_000, "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens string")
    goal = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("missing", 0.0, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix(docs, goal, slack=0.0)
    got = chosen.collect()
    assert {r.source for r in got} == {"big", "small"} and max(r.repeats for r in got if r.source == "big") == 1 and max(r.repeats for r in got) <= 3
    assert len({r.doc_id for r in got}) == len(got)
    rep = {r.source: r for r in report.collect()}
    assert abs(rep["big"].reached_share - 0.6) < 0.01 and abs(rep["small"].reached_share - 0.4) < 0.01
    assert rep["big"].used_tokens <= rep["big"].budget_tokens
    assert sorted(tuple(r) for r in mix(docs.repartition(7), goal, slack=0.0)[0].collect()) == sorted(tuple(r) for r in got)
    assert mix(docs.limit(0), goal)[0].count() == 0
    twice = mix(docs.union(docs), goal, total=10**6)[0].collect()
    assert len({(r.doc_id, r.source, r.tokens) for r in twice}) == len(twice)


@needs_tokenizer
def test_tokens_round_trip(spark):
    texts = ["Hello  world!\n日本 😀", "it's 12345", None, ""]
    enc = encoding(TOKENIZER)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    n = {r.id: r.tokens for r in token_counts(df).collect()}
    for k, t in enumerate(texts):
        assert n[k] == (len(enc.encode_ordinary(t)) if t else 0)
        assert not t or enc.decode(enc.encode_ordinary(t)) == t
