"""Elo ratings: the online fold and its bootstrap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.curate import drawn
from palaver.session import materialise

K, SCALE, BASE, INIT = 4.0, 400.0, 10.0, 1000.0


def _fold(ratings: dict, a: str, b: str, points: float, k: float, scale: float, base: float, init: float) -> None:
    ra, rb = ratings.get(a, init), ratings.get(b, init)
    ea = 1 / (1 + base ** ((rb - ra) / scale))
    eb = 1 / (1 + base ** ((ra - rb) / scale))
    ratings[a] = ra + k * (points - ea)
    ratings[b] = rb + k * (1 - points - eb)


def _points() -> Column:
    return F.when(F.col("winner") == "model_a", 1.0).when(F.col("winner") == "model_b", 0.0).when(F.col("winner").isin("tie", "tie (bothbad)"), 0.5)


def online_elo(battles: DataFrame, order: list[str], k: float = K, scale: float = SCALE, base: float = BASE, init: float = INIT, start: dict[str, float] | None = None, portion: int = 5_000_000) -> DataFrame:
    """(model, rating) after all battles in order; ``start`` has ratings from before (a list of models).

    The fold is serial by its definition. Battles are cut by range into parts of about ``portion``,
    so no task sorts more than that; the parts are folded one after the other, three narrow
    columns in sorted order, and only the ratings are handed on. Rows without winner or
    model are left out."""
    rows = battles.select(*order, "model_a", "model_b", _points().alias("points")).where("points is not null and model_a is not null and model_b is not null")

    def run(batches: Iterator[pa.RecordBatch], start: dict[str, float] | None = None) -> Iterator[pa.RecordBatch]:
        ratings: dict[str, float] = dict(start or {})
        for b in batches:
            for x, y, p in zip(*(b.column(c).to_pylist() for c in ("model_a", "model_b", "points")), strict=True):
                _fold(ratings, x, y, p, k, scale, base, init)
        if ratings:
            yield pa.RecordBatch.from_arrays([pa.array(list(ratings), pa.string()), pa.array(list(ratings.values()), pa.float64())], names=["model", "rating"])

    def folded(part: DataFrame) -> DataFrame:
        before = dict(start or {})
        return part.repartition(1).sortWithinPartitions(*order).select("model_a", "model_b", "points").mapInArrow(lambda batches: run(batches, before), "model string, rating double")

    parts = -(-rows.count() // portion)
    if parts > 1:
        ranged = materialise(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
        held = [r[0] for r in ranged.select("part").distinct().orderBy("part").collect()]
        for number in held[:-1]:
            start = {r["model"]: r["rating"] for r in folded(ranged.where(F.col("part") == number)).collect()}
        rows = ranged.where(F.col("part") == held[-1])
    return folded(rows)


def bootstrap_elo(battles: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(round, model, rating) of ``rounds`` resamples with replacement in random order.

    A resample of n battles in random order is n independent draws from the battles, so only
    the numbers of the different outcomes (two models and the points) are needed: they are
    counted once, and each task draws and folds its rounds side by side. Outcomes are at
    most three times the ordered pairs of models, whatever the number of battles; no battle
    table is exploded, collected or broadcast. Every round has its own random stream, so
    the result does not depend on the partitions.
    """
    spark = battles.sparkSession
    points = battles.select("model_a", "model_b", _points().alias("points")).where("points is not null and model_a is not null and model_b is not null")
    outcomes = points.groupBy("model_a", "model_b", "points").agg(F.count(F.lit(1)).alias("n"))
    parts = min(rounds, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    each = outcomes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    ordered = each.repartition(parts, "part").sortWithinPartitions("part", "model_a", "model_b", "points").select("part", "model_a", "model_b", "points", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for part, *outcome in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now and held:
                    yield _drawn_rounds(held, range(now, rounds, parts), seed)
                    held = []
                now = part
                held.append(outcome)
        if held:
            yield _drawn_rounds(held, range(now, rounds, parts), seed)

    return ordered.mapInArrow(run, "round int, model string, rating double")


def _drawn_rounds(outcomes: list, rounds: range, seed: int, chunk: int = 4096) -> pa.RecordBatch:
    """The ratings of some rounds, each a fold over as many draws as there are battles."""
    models = sorted({m for a, b, _, _ in outcomes for m in (a, b)})
    at = {m: k for k, m in enumerate(models)}
    side_a, side_b = (np.array([at[o[k]] for o in outcomes]) for k in (0, 1))
    points = np.array([o[2] for o in outcomes])
    up_to = np.cumsum([o[3] for o in outcomes])
    total = int(up_to[-1])
    streams = [np.random.default_rng([seed, r]) for r in rounds]
    ratings = np.full(len(rounds) * len(models), INIT)
    seen = np.zeros(len(ratings), bool)
    first = np.arange(len(rounds)) * len(models)  # place of each round's first model
    for begin in range(0, total, chunk):
        steps = min(chunk, total - begin)
        drawn = np.searchsorted(up_to, np.stack([g.integers(0, total, steps) for g in streams], axis=1), side="right")
        a, b, p = side_a[drawn] + first, side_b[drawn] + first, points[drawn]
        seen[a] = seen[b] = True
        for ia, ib, won in zip(a, b, p, strict=True):
            ra, rb = ratings[ia], ratings[ib]
            ratings[ia] = ra + K * (won - 1 / (1 + BASE ** ((rb - ra) / SCALE)))
            ratings[ib] = rb + K * (1 - won - 1 / (1 + BASE ** ((ra - rb) / SCALE)))
    places = np.flatnonzero(seen)
    return pa.RecordBatch.from_arrays([pa.array([rounds[k] for k in (places // len(models)).tolist()], pa.int32()), pa.array([models[k] for k in (places % len(models)).tolist()], pa.string()), pa.array(ratings[places], pa.float64())], names=["round", "model", "rating"])


def bootstrap(battles: DataFrame, rating: Callable[[DataFrame], DataFrame], rounds: int, seed: int = 42, key: str = "battle_id") -> DataFrame:
    """(round, ...) of any rating function over resamples with replacement; see ``curate.drawn``.

    The function is handed one resample at a time, so it may be any DataFrame program; for the
    online Elo with many rounds ``bootstrap_elo`` needs the counts of outcomes only.
    """
    out = None
    for k in range(rounds):
        resample = drawn(battles, key, seed + k).withColumn("_copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "_copy")
        part = rating(resample).withColumn("round", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def interval(samples: DataFrame) -> DataFrame:
    """Median (nearest integer) and 95 % interval of bootstrap ratings."""
    q = F.percentile("rating", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return samples.groupBy("model").agg(q.alias("q")).select("model", F.col("q")[0].alias("lower"), F.floor(F.col("q")[1] + 0.5).cast("int").alias("rating"), F.col("q")[2].alias("upper"))
