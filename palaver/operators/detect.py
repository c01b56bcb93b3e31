"""Answer consistency features: grouping, clustering, entropy, log-probabilities, similarity, labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Tasks and the instruction each stands for.
TASKS = {"commonsense": "Choose the right option.", "arc": "Choose the right option.", "math": "Solve the problem.", "gsm8k": "Solve the problem.", "truthful": "Answer truthfully.", "faviq": "Answer the question.", "comqa": "Answer the question."}


def exploded(sets: DataFrame, questions: str = "questions", duplicate: int | None = None) -> DataFrame:
    """One row per paraphrase: (id, n, input, gold); with ``duplicate`` the first question that often."""
    flat = F.filter(F.flatten(F.filter(questions, lambda q: q.isNotNull() & (F.size(q) > 0))), lambda q: q.isNotNull())
    items = F.array_repeat(F.get(flat, F.lit(0)), duplicate) if duplicate else flat
    return sets.select("id", "gold", F.posexplode(items).alias("n", "input"))


def with_instruction(rows: DataFrame, task: str) -> DataFrame:
    """Add the instruction that the row's task stands for; null for an unknown task."""
    return rows.withColumn("instruction", F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])[F.col(task)])


def grouped(rows: DataFrame, key: str, order: str, text: str, gold: str) -> DataFrame:
    """Groups in order: inputs as an ordered array, the first gold and id. A group is the set of
    generations for one instruction, which is small by construction; see ``group_counts``
    for statistics of groups of any size."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("texts"), F.min_by(gold, order).alias("gold"), F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def entropy(sizes: Column) -> Column:
    """Natural-log entropy of an array of cluster sizes."""
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(sizes, F.lit(0.0), lambda a, x: F.when(x > 0, a - x / total * F.log(x / total)).otherwise(a))


def cluster_entropy(rows: DataFrame, group: str, cluster: str) -> DataFrame:
    """(group, entropy, max_ratio, contradiction) from counts in two aggregations, for groups of
    any size: contradiction is the share outside the first cluster (by cluster name)."""
    counts = rows.groupBy(group, cluster).agg(F.count(F.lit(1)).alias("k"))
    n = F.sum("k")
    # -sum p ln p = ln n - sum k ln k / n
    return counts.groupBy(group).agg((F.log(n) - F.sum(F.col("k") * F.log("k")) / n).alias("entropy"), (F.max("k") / n).alias("max_ratio"), (1 - F.min_by("k", cluster) / n).alias("contradiction"))


def logprob_features(logps: Column) -> dict[str, Column]:
    """Token probability (mean, max, min), perplexity (-1 if empty) and negative log-probability
    (mean, max); sequence log-likelihood (sum, mean)."""
    n = F.size(logps)
    total = F.aggregate(logps, F.lit(0.0), lambda a, x: a + x)
    probs = F.transform(logps, F.exp)
    mean = total / F.nullif(n, F.lit(0))
    return {
        "prob_mean": F.aggregate(probs, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0)),
        "prob_max": F.array_max(probs),
        "prob_min": F.array_min(probs),
        "perplexity": F.when(n > 0, F.exp(-mean)).otherwise(-1.0),
        "neglog_mean": -mean,
        "neglog_max": -F.array_min(logps),
        "likelihood": total,
        "likelihood_avg": mean,
    }


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def pooled(vectors: DataFrame, group: str, vector: str, dim: int, mask: Column | None = None) -> DataFrame:
    """Mean of the vectors of each group, of those only that ``mask`` holds for, scaled to length 1,
    element by element so that it aggregates partially. A group without any has nulls."""
    one = lambda k: F.get(vector, F.lit(k)) if mask is None else F.when(mask, F.get(vector, F.lit(k)))
    parts = vectors.groupBy(group).agg(*[F.avg(one(k)).alias(f"v{k}") for k in range(dim)])
    mean = F.array(*[F.col(f"v{k}") for k in range(dim)])
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x * x))
    return parts.select(group, F.transform(mean, lambda x: x / norm).alias("vector"))


def contradiction(rows: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """1 - mean over the later vectors of a group of max(0, cosine with the first one); null for
    a group of one."""
    first = rows.groupBy(group).agg(F.min_by(vector, order).alias("v0"), F.min(order).alias("o0"))
    later = rows.join(first, group).where(F.col(order) > F.col("o0"))
    scored = later.groupBy(group).agg((1 - F.avg(F.greatest(F.lit(0.0), cosine(F.col("v0"), F.col(vector))))).alias("contradiction"))
    return first.select(group).join(scored, group, "left")


def line_contradiction(lines: DataFrame, group: str, answer: str, vector: str) -> DataFrame:
    """1 - mean over the later answers of a group of max(0, best cosine of one of their lines with
    the first answer), whose own vector is that of its first line; null for a group of one answer.
    ``lines`` has a row for each line that is not empty, ``line`` orders them."""
    first = lines.groupBy(group).agg(F.min_by(vector, F.struct(answer, "line")).alias("v0"), F.min(answer).alias("a0"))
    later = lines.join(first, group).where(F.col(answer) > F.col("a0"))
    best = later.groupBy(group, answer).agg(F.max(cosine(F.col("v0"), F.col(vector))).alias("c"))
    scored = best.groupBy(group).agg((1 - F.avg(F.greatest(F.lit(0.0), F.col("c")))).alias("contradiction"))
    return first.select(group).join(scored, group, "left")


def leader_clusters(rows: DataFrame, group: str, order: str, vector: str, threshold: float) -> DataFrame:
    """Greedy leader clustering in order: each item joins the first cluster whose first member
    has at least the cosine ``threshold`` with it, else founds one: (group, order, leader).

    The scan is serial within a group by its definition: the items of a group go through one
    task in sorted order as a stream, and only the leaders of one group are held, so a
    group may have any number of items and leaders cost no rounds. An item whose cosine is
    undefined (null, a null element, length 0 or differing) counts as cosine 0.
    """
    kind = dict(rows.dtypes)
    schema = f"`{group}` {kind[group]}, `{order}` {kind[order]}, leader {kind[order]}"
    held = rows.select(group, order, F.transform(vector, lambda x: x.cast("double")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, scan = None, False, LeaderScan(threshold)
        for b in batches:
            groups, orders, vectors = (c.to_pylist() for c in b.columns)
            leaders = []
            for begin, end in _runs(groups):
                if not started or groups[begin] != now:
                    now, started, scan = groups[begin], True, LeaderScan(threshold)
                leaders += scan.add(orders[begin:end], vectors[begin:end])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaders, b.column(1).type)], names=[group, order, "leader"])

    return held.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, schema)


def _runs(values: list) -> Iterator[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    begin = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[begin]:
            yield begin, k
            begin = k


class LeaderScan:
    """The scan of one group; items are compared with all leaders so far in blocks."""

    def __init__(self, threshold: float, block: int = 256) -> None:
        self.threshold, self.block = threshold, block
        self.ids: list = []
        self.units: dict[int, tuple[list[int], np.ndarray]] = {}  # by dimension: numbers of the leaders, their directions (spare rows at the end)

    def add(self, orders: list, vectors: list) -> list:
        """The leaders of the next items."""
        out: list = []
        for at in range(0, len(orders), self.block):
            part = list(zip(orders[at : at + self.block], map(self._unit, vectors[at : at + self.block]), strict=True))
            # the leaders from before the block, for all its items of one dimension at once
            first: dict[int, int] = {}
            before = {d: len(numbers) for d, (numbers, _) in self.units.items()}
            for d, n in before.items():
                own = [k for k, (_, u) in enumerate(part) if u is not None and len(u) == d]
                if own:
                    near = np.stack([part[k][1] for k in own]) @ self.units[d][1][:n].T >= self.threshold
                    for k, hit, j in zip(own, near.any(axis=1), near.argmax(axis=1), strict=True):
                        if hit:
                            first[k] = self.units[d][0][j]
            for k, (order, unit) in enumerate(part):
                number = first.get(k)
                if self.threshold <= 0:  # any leader of undefined cosine (0) is near enough, so all are looked at in order
                    number = self._scan(unit)
                elif number is None and unit is not None and len(unit) in self.units:
                    numbers, known = self.units[len(unit)]
                    begin = before.get(len(unit), 0)
                    near = known[begin : len(numbers)] @ unit >= self.threshold
                    number = numbers[begin + int(near.argmax())] if near.any() else None
                if number is None:
                    number = len(self.ids)
                    self.ids.append(order)
                    self._found(number, unit)
                out.append(self.ids[number])
        return out

    @staticmethod
    def _unit(vector: list | None) -> np.ndarray | None:
        """The direction of a vector, None where it has none."""
        if not vector or any(x is None for x in vector):
            return None
        v = np.array(vector, np.float64)
        norm = float(np.sqrt(v @ v))
        return v / norm if norm > 0 else None

    def _scan(self, unit: np.ndarray | None) -> int | None:
        """The first leader near enough where the threshold is 0 or less."""
        defined = dict(zip(*self.units[len(unit)], strict=False)) if unit is not None and len(unit) in self.units else {}
        return next((n for n in range(len(self.ids)) if n not in defined or float(defined[n] @ unit) >= self.threshold), None)

    def _found(self, number: int, unit: np.ndarray | None) -> None:
        if unit is None:
            return
        numbers, known = self.units.get(len(unit), ([], np.empty((16, len(unit)))))
        if len(numbers) == len(known):
            known = np.concatenate([known, np.empty_like(known)])
        known[len(numbers)] = unit
        numbers.append(number)
        self.units[len(unit)] = numbers, known


def feature_join(generations: DataFrame, groups: DataFrame, labels: DataFrame, key: str, text: str, own: DataFrame | None = None) -> DataFrame:
    """Generations with the features of their group and their label, and with ``own`` those of the
    group of answers to the question itself (columns get the end ``_self``); on repeated keys of a
    right side the row with the last ``pos`` counts; generations without one of them are left out."""
    last = lambda df, by, end="": df.groupBy(by).agg(*[F.max_by(c, "pos").alias(c + end) for c in df.columns if c not in (by, "pos")])
    joined = generations.join(last(groups, key), key).join(last(labels, text), text)
    return joined.join(last(own, key, "_self"), key) if own is not None else joined


def usable_gold(c: str = "gold") -> Column:
    return (F.coalesce(F.col(c), F.lit("")) != "") & ~F.contains(F.col(c), F.lit("en.wikipedia.org"))


def mixed_groups(rows: DataFrame, group: str, label: str, value: str) -> DataFrame:
    """For groups that hold both labels: sums over the groups of the mean value by label."""
    per = rows.groupBy(group).agg(F.avg(F.when(F.col(label) == 0, F.col(value))).alias("m0"), F.avg(F.when(F.col(label) == 1, F.col(value))).alias("m1"), F.countDistinct(label).alias("k")).where("k = 2")
    return per.agg(F.count(F.lit(1)).alias("groups"), F.sum("m0").alias("sum_0"), F.sum("m1").alias("sum_1"))


# Names of feature sets and the places of their columns in a feature file; first those for generations, then those for
# the answers to a question's own paraphrases. Any other name is the first seven columns.
FEATURE_SETS = {
    "ALL": (0, 1, 2, 3, 4, 5, 6), "4_combination": (0, 1, 2, 3), "atypicality": (0,), "entropy": (1,), "token_probs": (2,), "perplexity": (5,), "atypicality_avg": (3,), "atypicalities": (0, 3),
    "ALL_merges": (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10), "ALL_wo_selfGPT": (0, 1, 2, 3, 4, 5, 9, 10), "ALL_wo_selfcons": (0, 1, 2, 3, 4, 5, 6, 7, 8),
}
OWN_FEATURE_SETS = {"self_consistency": (2, 3), "selfCheckGPT": (4, 5, 6)}


def feature_set(name: str, columns: list[str], own: bool = False) -> list[str]:
    """The columns of a named feature set, out of those of a feature file."""
    places = (OWN_FEATURE_SETS if own else FEATURE_SETS).get(name, tuple(range(7)))
    return [columns[k] for k in places]


def random_baseline(df: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """Add ``prediction``, 0 or 1 by a seeded digest of the key: what a classifier must beat."""
    return df.withColumn("prediction", (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 1), 16, 10).cast("int") >= 8).cast("int"))


def hash_split(df: DataFrame, key: str, share: float, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1e6
    return df.where(place < share), df.where(place >= share)


def boosted(train: DataFrame, test: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Predictions of gradient-boosted trees with default parameters on the test rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    pack = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    model = GBTClassifier(labelCol=label, featuresCol="features", seed=7, maxIter=10).fit(pack.transform(train))
    return model.transform(pack.transform(test)).select(label, F.col("prediction").cast("int").alias("prediction"))


def binary_metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """AUC, average precision and accuracy in percent of hard 0/1 predictions, from the counts
    of the four cells; the average precision is the step-wise one."""
    c = rows.agg(*[F.count_if((F.col(label) == a) & (F.col(prediction) == b)).cast("double").alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    tpr, fpr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("fp", F.col("fp") + F.col("tn"))
    base = F.try_divide(F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    return c.select((100 * (tpr - fpr + 1) / 2).alias("auc"), (100 * (tpr * precision + (1 - tpr) * base)).alias("ap"), (100 * F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"))


def paraphrase_lines(text: Column) -> Column:
    """Lines whose first integer is above 0, without leading digits and dots."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.coalesce(F.regexp_extract(x, r"(\d+)", 1).try_cast("int"), F.lit(0)) > 0)
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[\s\d.]+", "")))


def last_in_batches(df: DataFrame, pos: str, size: int = 4) -> DataFrame:
    """Batches of ``size`` rows by place, with the place inside."""
    return df.withColumn("batch", F.floor(F.col(pos) / size)).withColumn("index", F.col(pos) % size)


def top_instances(rows: DataFrame, task: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(task).orderBy(order))).where(F.col("_k") <= n).drop("_k")


def weighted_pick(df: DataFrame, weight: str, key: str, u: float) -> DataFrame:
    """The item at ``u`` (0 to 1) of the cumulative weights, in key order: a list of models."""
    total = F.sum(weight).over(W.partitionBy(F.lit(0)))
    cum = F.sum(weight).over(W.orderBy(key))
    return df.select("*", (cum / total).alias("c"), ((cum - F.col(weight)) / total).alias("c0")).where((F.col("c0") <= u) & (F.col("c") > u)).drop("c", "c0")
