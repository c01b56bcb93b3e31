from palaver.operators.ratings import bootstrap_elo, interval, online_elo


def battles(spark, n=300):
    rows = [(k, f"m{k % 5}", f"m{(k * 7 + 1) % 5}", ["model_a", "model_b", "tie", "tie (bothbad)"][k * k % 4], float(k % 50)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "battle_id bigint, model_a string, model_b string, winner string, tstamp double")


def test_online_elo_equals_the_fold_and_keeps_the_sum(spark):
    rows, df = battles(spark)
    r = {}
    for _, a, b, w, _ in sorted(rows, key=lambda x: (x[4], x[0])):
        ra, rb = r.get(a, 1000.0), r.get(b, 1000.0)
        ea, eb = 1 / (1 + 10 ** ((rb - ra) / 400)), 1 / (1 + 10 ** ((ra - rb) / 400))
        p = {"model_a": 1.0, "model_b": 0.0}.get(w, 0.5)
        r[a] = ra + 4 * (p - ea)
        r[b] = rb + 4 * (1 - p - eb)
    got = {x.model: x.rating for x in online_elo(df.repartition(7), ["tstamp", "battle_id"]).collect()}
    assert got == r


def test_bootstrap_surrounds_the_rating(spark):
    _, df = battles(spark)
    rows = interval(bootstrap_elo(df.where("model_a <> model_b"), 30)).collect()
    assert rows and all(x.lower <= x.rating + 1 and x.rating <= x.upper + 1 for x in rows)


def test_the_query_draws_1000_rounds(spark, tmp_path, monkeypatch):
    from palaver.operators import ratings
    from palaver.plans import queries

    _, df = battles(spark)
    df.write.parquet(f"{tmp_path}/battles.parquet")
    samples = []
    monkeypatch.setattr(ratings, "interval", lambda s, own=ratings.interval: samples.append(s) or own(s))
    monkeypatch.setattr("palaver.plans.arena.battles", lambda s, d: s.read.parquet(f"{d}/battles.parquet"))
    rows = queries()["elo_bootstrap_ci"](spark, str(tmp_path)).collect()
    assert len(rows) == 4 and samples[0].select("round").distinct().count() == 1000


def test_bootstrap_equals_resampling_the_battles(spark):
    """Quantiles of the drawn outcomes against battles drawn and folded one by one."""
    import numpy as np

    rows, df = battles(spark)
    rows = [(a, b, {"model_a": 1.0, "model_b": 0.0}.get(w, 0.5)) for _, a, b, w, _ in rows if a != b]
    rng, want = np.random.default_rng(1), {}
    for _ in range(1000):
        r = {}
        for k in rng.integers(0, len(rows), len(rows)):
            a, b, p = rows[k]
            ra, rb = r.get(a, 1000.0), r.get(b, 1000.0)
            e = 1 / (1 + 10 ** ((rb - ra) / 400))
            r[a], r[b] = ra + 4 * (p - e), rb - 4 * (p - e)
        for m, x in r.items():
            want.setdefault(m, []).append(x)
    one = bootstrap_elo(df.where("model_a <> model_b"))
    got = {r.model: r for r in interval(one).collect()}
    assert set(got) == set(want)
    for m, xs in want.items():
        lower, upper = np.quantile(xs, (0.025, 0.975))
        spread = float(np.std(xs))
        assert abs(got[m].lower - lower) < spread / 2 and abs(got[m].upper - upper) < spread / 2
    again = bootstrap_elo(df.where("model_a <> model_b").repartition(7), 20)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, one.where("round < 20").collect()))
