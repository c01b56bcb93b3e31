"""Consensus from several annotators' labels by spectral reliability.

Each verdict is centred by what its annotator would say by chance (own rates of
"first shown", "second shown" and "tie"), so a position-biased annotator carries no
signal. The agreement matrix M of centred votes, corrected for the numbers d of shared
items, D^-1/2 M D^-1/2, is approximately rank one; its leading eigenvector x gives the
reliabilities as x / sqrt(d), up to one scale that the Rayleigh quotient fixes. It is found
by power iteration without ever building annotator pairs: per item a weighted sum of the
votes, per annotator the inner product with it, i.e. two joins and two aggregations over
the vote table in each round, normalised each round. Groups of annotators that share no
item have an eigenvector of their own each; the groups are found in the same rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.session import cut, join_side, materialise

ITEM = ["question_id", "turn", "model_1", "model_2"]
LABELS = ("model_1", "model_2", "tie")
SIDES = ("c1", "c2", "c3")


class NotConverged(RuntimeError):
    """The power iteration did not settle within its rounds."""


def verdicts(judgments: DataFrame) -> DataFrame:
    """One row per (item, annotator, game) with a valid verdict.

    Rows repeated whole count once. The pair is put in name order, null ``turn`` is 1,
    ``error``, null and unknown verdicts are dropped, rows without annotator, question
    or model names as well. ``first`` tells whether the label is the model shown first.
    """
    text = [c for c in ("g1_user_prompt", "g2_user_prompt", "g1_judgment", "g2_judgment") if c in judgments.columns]
    rows = (
        judgments.select(
            "question_id",
            F.coalesce(F.col("turn"), F.lit(1)).cast("int").alias("turn"),
            F.trim("model_1").alias("m1"),
            F.trim("model_2").alias("m2"),
            F.get(F.col("judge"), F.lit(0)).alias("annotator"),
            F.to_json(F.struct("judge")).alias("judge_key"),
            "tstamp",
            "turn",
            "g1_winner",
            "g2_winner",
            F.xxhash64(*text).alias("text_key") if text else F.lit(0).alias("text_key"),
        )
        .toDF("question_id", "turn", "m1", "m2", "annotator", "judge_key", "tstamp", "raw_turn", "g1_winner", "g2_winner", "text_key")
        .where("question_id is not null and m1 is not null and m2 is not null and annotator is not null")
        .dropDuplicates()
    )
    flip = F.col("m1") > F.col("m2")
    label = lambda c: F.when(F.col(c) == "tie", "tie").when(F.col(c).isin("model_1", "model_2"), F.when((F.col(c) == "model_1") == ~flip, "model_1").otherwise("model_2"))
    game = lambda n: F.struct(
        label(f"g{n}_winner").alias("label"),
        # canonical model_1 is on the first seat in game 1 unless flipped, and the other way round in game 2
        (flip if n == 2 else ~flip).alias("one_first"),
    )
    return (
        rows.select("question_id", "turn", F.least("m1", "m2").alias("model_1"), F.greatest("m1", "m2").alias("model_2"), "annotator", F.explode(F.array(game(1), game(2))).alias("g"))
        .select(*ITEM, "annotator", "g.label", "g.one_first")
    )


def _profile(votes: DataFrame, smooth: float) -> DataFrame:
    """Chance rates of each annotator by seat, smoothed towards one third."""
    first = ((F.col("label") == "model_1") & F.col("one_first")) | ((F.col("label") == "model_2") & ~F.col("one_first"))
    tie = F.col("label") == "tie"
    n = F.count(F.lit(1))
    rate = lambda hit: (F.sum(hit.cast("double")) + smooth / 3) / (n + smooth)
    return votes.groupBy("annotator").agg(rate(first).alias("p_first"), rate(~first & ~tie).alias("p_second"), rate(tie).alias("p_tie"), n.alias("verdicts"))


def _leading(slim: DataFrame, size: int, rounds: int, tol: float) -> DataFrame:
    """(annotator, d, x, value, group): the leading eigenvector of each group of annotators.

    ``slim`` has (item, annotator, c1, c2, c3), each item and annotator once; ``d`` is the
    number of verdicts shared with others. A round keeps a quarter of the old vector, so a
    negative eigenvalue as large as the leading one does not make the vector swing.
    Done when the residual of every group is at most ``tol`` of its eigenvalue and no group
    label moves any more; power iteration reaches that in at most about 0.5 / ``tol`` rounds
    however close the next eigenvalue is. ``NotConverged`` after ``rounds``.
    """
    others = slim.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    state = cut(slim.join(others, "item").groupBy("annotator").agg(F.sum(F.col("n") - 1).cast("double").alias("d")).select("annotator", "d", F.sqrt("d").alias("x"), F.xxhash64("annotator").alias("group"), F.lit(0.0).alias("value")))
    state = _unit(state)
    for _ in range(rounds):
        side = state.where("d > 0").select("annotator", "x", "value", "group", "d", (F.col("x") / F.sqrt("d")).alias("y"))
        held = slim.join(join_side(side, size), "annotator")
        sums = held.groupBy("item").agg(*[F.sum(F.col("y") * F.col(c)).alias(f"t{c}") for c in SIDES], F.min("group").alias("least"))
        inner = sum(F.col(c) * (F.col(f"t{c}") - F.col("y") * F.col(c)) for c in SIDES)
        image = held.join(sums, "item").groupBy("annotator").agg((F.sum(inner) / F.sqrt(F.max("d"))).alias("mx"), F.max("x").alias("x"), F.max("d").alias("d"), F.max("group").alias("group"), F.min("least").alias("least"))
        image = cut(image)
        per = image.groupBy("group").agg(F.sum(F.col("x") * F.col("mx")).alias("value"), F.sum(F.col("mx") ** 2).alias("square"), F.count_if(F.col("group") != F.col("least")).alias("moved"))
        moved, residual = per.agg(F.coalesce(F.sum("moved"), F.lit(0)), F.max(F.sqrt(F.greatest(F.col("square") - F.col("value") ** 2, F.lit(0.0))) / F.abs("value"))).first()
        per = per.select("group", "value")
        if not moved and (residual is None or residual <= tol):
            return image.join(join_side(per, size), "group").select("annotator", "d", "x", "value", "group")
        step = image.join(join_side(per, size), "group").withColumn("next", F.col("mx") + 0.25 * F.abs("value") * F.col("x"))
        state = _unit(step.select("annotator", "d", F.col("least").alias("group"), F.when(F.col("next") == 0, F.col("x")).otherwise(F.col("next")).alias("x"), "value"))
    raise NotConverged(f"no leading vector after {rounds} rounds: residual {residual} of the eigenvalue, {moved} annotators change their group")


def _unit(state: DataFrame) -> DataFrame:
    """Vector of length one in each group."""
    norms = state.groupBy("group").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    return state.join(norms, "group").select("annotator", "d", F.coalesce(F.try_divide("x", "norm"), F.lit(0.0)).alias("x"), "group", "value")


def consensus(judgments: DataFrame, min_annotators: int = 1, rounds: int = 400, tol: float = 2e-3, smooth: float = 6.0, shrink: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Return (items, annotators).

    items: the item key, ``winner`` (model_1, model_2 or tie), ``agreement`` (share of
    the reliability weight behind the winner), ``observed`` (share of equal verdicts
    among the pairs of verdicts of different annotators, computed from counts),
    ``annotators`` (distinct annotators with any row, valid or not).
    annotators: ``annotator``, ``reliability``, ``verdicts``, ``items``.

    A reliability r says that the annotator knows the answer with probability r and else
    answers by their own chance rates p of the seat; so a verdict weighs
    log(1 + r / ((1 - r) p)), a negative r the other way. Reliabilities of few shared
    verdicts are shrunk towards 0 by ``shrink`` verdicts.

    Defined cases: an item whose annotators gave no valid verdict is a tie with null
    agreement; equal scores fall to the larger plain count, then to model_1 before
    model_2 before tie; an empty table gives empty results; extra columns are ignored.
    Reliability is 0 for an annotator who shares no item with another one, and in a group
    that agrees no better than chance. ``NotConverged`` if the iteration does not settle.
    """
    votes_all = verdicts(judgments)
    seen = votes_all.groupBy(*ITEM).agg(F.countDistinct("annotator").alias("annotators"))
    votes = materialise(votes_all.where("label is not null"))
    profile = materialise(_profile(votes, smooth))
    size = profile.count()
    one = lambda name: (F.col("label") == name).cast("double")
    e1 = F.when(F.col("one_first"), F.col("p_first")).otherwise(F.col("p_second"))
    e2 = F.when(F.col("one_first"), F.col("p_second")).otherwise(F.col("p_first"))
    count = lambda label, seat: F.count_if((F.col("label") == label) & seat).alias
    centred = materialise(
        votes.join(join_side(profile, size), "annotator")
        .groupBy(*ITEM, "annotator")
        .agg(
            F.avg(one("model_1") - e1).alias("c1"),
            F.avg(one("model_2") - e2).alias("c2"),
            F.avg(one("tie") - F.col("p_tie")).alias("c3"),
            # verdicts for either model by the seat it was shown on
            count("model_1", F.col("one_first"))("f1"),
            count("model_1", ~F.col("one_first"))("s1"),
            count("model_2", ~F.col("one_first"))("f2"),
            count("model_2", F.col("one_first"))("s2"),
            count("tie", F.lit(True))("n3"),
            F.count(F.lit(1)).alias("games"),
        )
        .withColumn("item", F.xxhash64(*ITEM))
    )
    slim = centred.select("item", "annotator", *SIDES)
    lead = _leading(slim, size, rounds, tol)
    # M y = value d y, and M is about scale y y' off the diagonal: the scale is value over the shared weight
    side = join_side(lead.where("d > 0").select("annotator", "group", (F.col("x") ** 2 / F.col("d")).alias("q")), size)
    shared = slim.select("item", "annotator").join(side, "annotator").groupBy("item").agg(F.first("group").alias("group"), (F.sum("q") ** 2 - F.sum(F.col("q") ** 2)).alias("w")).groupBy("group").agg(F.sum("w").alias("w"))
    sign = lead.groupBy("group").agg(F.signum(F.sum(F.sqrt("d") * F.col("x"))).alias("sign"))
    raw = F.col("sign") * F.sqrt(F.greatest(F.try_divide("value", "w"), F.lit(0.0))) * F.col("x") * F.sqrt("d") / (F.col("d") + shrink)
    known = lead.join(shared, "group").join(sign, "group").select("annotator", raw.alias("raw"))
    energy = 1 - F.col("p_first") ** 2 - F.col("p_second") ** 2 - F.col("p_tie") ** 2
    r = F.greatest(F.lit(-0.95), F.least(F.lit(0.95), F.coalesce(F.try_divide("raw", F.sqrt(energy)), F.lit(0.0))))
    weight = lambda p: F.when(F.col("r") >= 0, F.log(1 + F.col("r") / ((1 - F.col("r")) * F.col(p)))).otherwise(-F.log(1 - F.col("r") / ((1 + F.col("r")) * (1 - F.col(p)))))
    scale = cut(profile.join(known, "annotator", "left").select("annotator", "verdicts", "p_first", "p_second", "p_tie", r.alias("r")).select("*", *[weight(f"p_{k}").alias(f"w_{k}") for k in ("first", "second", "tie")]))
    counts = {1: F.col("f1") + F.col("s1"), 2: F.col("f2") + F.col("s2"), 3: F.col("n3")}
    points = {1: F.col("f1") * F.col("w_first") + F.col("s1") * F.col("w_second"), 2: F.col("f2") * F.col("w_first") + F.col("s2") * F.col("w_second"), 3: F.col("n3") * F.col("w_tie")}
    same_own = sum(n**2 for n in counts.values())
    best = F.array_max(F.array(*[F.struct(F.round(F.col(f"t{i}"), 9).alias("s"), F.col(f"k{i}").alias("k"), F.lit(-i).alias("o"), F.lit(LABELS[i - 1]).alias("label"), F.col(f"w{i}").alias("w")) for i in (1, 2, 3)]))
    n_all, n_own = sum(F.col(f"k{i}") for i in (1, 2, 3)), F.col("own")
    scored = (
        centred.join(join_side(scale, size), "annotator")
        .groupBy(*ITEM)
        .agg(
            *[F.sum(points[i]).alias(f"t{i}") for i in points],
            *[F.sum(counts[i]).alias(f"k{i}") for i in counts],
            *[F.sum(F.greatest(points[i], F.lit(0.0))).alias(f"w{i}") for i in points],
            F.sum(same_own).alias("same_own"),
            F.sum(F.col("games") ** 2).alias("own"),
        )
        .withColumn("best", best)
        .select(
            *ITEM,
            F.col("best.label").alias("winner"),
            F.try_divide(F.col("best.w"), F.col("w1") + F.col("w2") + F.col("w3")).alias("agreement"),
            F.try_divide(sum(F.col(f"k{i}") ** 2 for i in (1, 2, 3)) - F.col("same_own"), n_all**2 - n_own).alias("observed"),
        )
    )
    items = seen.join(scored, ITEM, "left").select(*ITEM, F.coalesce("winner", F.lit("tie")).alias("winner"), "agreement", "observed", "annotators")
    if min_annotators > 1:
        items = items.where(F.col("annotators") >= min_annotators)
    items_per = centred.groupBy("annotator").agg(F.count(F.lit(1)).alias("items"))
    annotators = scale.join(items_per, "annotator", "left").select("annotator", F.col("r").alias("reliability"), "verdicts", F.coalesce("items", F.lit(0)).alias("items"), "p_first", "p_second", "p_tie")
    return items, annotators


def chance_rates(judgments: DataFrame, smooth: float = 6.0) -> DataFrame:
    """The annotators' seat and tie rates that the centring uses."""
    votes = verdicts(judgments).where("label is not null")
    return _profile(votes, smooth)


__all__: list[str] = ["NotConverged", "chance_rates", "consensus", "verdicts"]
