"""Global ranking from pairwise comparisons by spring energy.

Every win is a spring that pulls the winner one unit above the loser; a tie counts as
half a win each way. The strengths minimise the total spring energy plus a small
anchor, i.e. they solve (alpha I + D - W) s = out - in, where W holds the numbers of
comparisons between two items and D their row sums. The system is solved by
Jacobi-preconditioned conjugate gradients on DataFrames: the edge table is aggregated
once, each round joins it with the direction vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.session import canonical_name, cut, join_side, materialise


def clean_votes(battles: DataFrame) -> DataFrame:
    """Valid votes, each once: (model_a, model_b, points) with points 1, 0.5 or 0 for a.

    A vote delivered again (all fields but ``battle_id`` and ``received_at`` equal)
    counts once; a row without ``question_id`` cannot be recognised as such and is its
    own vote. Names are compared without case and outer blanks. Null winners, unknown
    winners, missing names and fights of a model against itself do not count.
    """
    keys = [c for c in ("question_id", "model_a", "model_b", "winner", "judge", "turn", "anony", "rounds", "language", "tstamp", "ip", "server") if c in battles.columns]
    own = F.when(F.col("question_id").isNull(), F.col("battle_id"))
    rows = battles.select(*keys, own.alias("own")).dropDuplicates()
    points = F.when(F.col("winner") == "model_a", 1.0).when(F.col("winner") == "model_b", 0.0).when(F.col("winner").isin("tie", "tie (bothbad)"), 0.5)
    return rows.select(canonical_name("model_a").alias("model_a"), canonical_name("model_b").alias("model_b"), points.alias("points")).where("points is not null and model_a <> model_b")


def edges(votes: DataFrame) -> DataFrame:
    """Both directions of every compared pair: (i, j, n comparisons, w points of i)."""
    pair = votes.groupBy("model_a", "model_b").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("points").alias("w"), F.sum((F.col("points") == 0.5).cast("double")).alias("t"))
    both = F.explode(F.array(F.struct(F.col("model_a").alias("i"), F.col("model_b").alias("j"), "n", "w", "t"), F.struct(F.col("model_b").alias("i"), F.col("model_a").alias("j"), "n", (F.col("n") - F.col("w")).alias("w"), "t")))
    return pair.select(both.alias("e")).select("e.*").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("t").alias("t"))


def spring_rank(votes: DataFrame, alpha: float = 0.1, rounds: int = 1000, tol: float = 1e-9) -> DataFrame:
    """Strengths of all compared items: (model, strength, rank, battles, wins, losses, ties).

    Strengths have mean 0; equal strengths (to 9 places) share a rank. ``alpha``
    anchors items of separate components. No comparison gives an empty result.
    ``RuntimeError`` if the residual is not ``tol`` of the first one after ``rounds``.
    """
    e = materialise(edges(votes))
    base = materialise(e.groupBy("i").agg(F.sum("n").alias("deg"), (2 * F.sum("w") - F.sum("n")).alias("b"), F.sum("w").alias("w"), F.sum("t").alias("t")))
    size = base.count()
    diag = F.col("deg") + alpha
    links = e.select("i", "j", "n")
    state = cut(base.select("i", "deg", F.lit(0.0).alias("x"), F.col("b").alias("r"), (F.col("b") / diag).alias("p")))
    rz0 = rz = state.agg(F.sum(F.col("r") ** 2 / diag)).first()[0] or 0.0
    for k in range(rounds + 1):
        if not size or rz <= tol * tol * max(rz0, 1e-300):
            break
        if k == rounds:
            raise RuntimeError(f"ranking: residual {(rz / rz0) ** 0.5} of the first one after {rounds} rounds")
        p = state.select(F.col("i").alias("j"), F.col("p").alias("pj"))
        pulled = links.join(join_side(p, size), "j").groupBy("i").agg(F.sum(F.col("n") * F.col("pj")).alias("pull"))
        q = cut(state.join(join_side(pulled, size), "i").withColumn("q", diag * F.col("p") - F.col("pull")).drop("pull"))
        pq = q.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        step = rz / pq
        moved = q.select("i", "deg", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p")
        new = moved.agg(F.sum(F.col("r") ** 2 / diag)).first()[0]
        state = moved.withColumn("p", F.col("r") / diag + (new / rz) * F.col("p"))
        rz = new
    mean = state.agg(F.avg("x")).first()[0] or 0.0
    ranked = state.select("i", F.round(F.col("x") - mean, 9).alias("strength")).join(base, "i")
    # equal strengths share the rank
    levels = ranked.groupBy("strength").agg(F.count(F.lit(1)).alias("k"))
    return with_rank(ranked, levels).select(
        F.col("i").alias("model"), "strength", "rank", F.col("deg").cast("long").alias("battles"), (F.col("w") - F.col("t") / 2).cast("long").alias("wins"), (F.col("deg") - F.col("w") - F.col("t") / 2).cast("long").alias("losses"), F.col("t").cast("long").alias("ties")
    )


def with_rank(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Competition rank (largest strength first) by range partitions: each partition's
    count goes to the driver (one number per partition), ranks inside run in parallel."""
    from pyspark.sql import Window as W

    parts = materialise(levels.repartitionByRange(F.desc("strength")).withColumn("part", F.spark_partition_id()))
    offsets, before = [], 0
    for part, k in sorted(tuple(x) for x in parts.groupBy("part").agg(F.sum("k")).collect()):
        offsets.append((part, before))
        before += k
    spark = rows.sparkSession
    off = spark.createDataFrame(offsets, "part int, before long")
    w = W.partitionBy("part").orderBy(F.desc("strength")).rowsBetween(W.unboundedPreceding, -1)
    ranks = parts.join(F.broadcast(off), "part").select("strength", (F.col("before") + F.coalesce(F.sum("k").over(w), F.lit(0)) + 1).cast("long").alias("rank"))
    return rows.join(ranks, "strength")
