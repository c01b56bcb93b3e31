"""Mixing sources to target weights: subset-sum budget fitting by exact token lengths.

Sizes are tokens of a public tokenizer. From the documents only a histogram (source, token
length, count) is made. The total is the largest at which the sources that cannot give their
share with their allowed repeats hold little of the shares together. Per source the budget
is cut into whole repeats and a rest; the rest is fitted by a bounded-knapsack dynamic
program over the distinct lengths, which gives a count for each length, and that many
documents of each length are chosen by a seeded hash.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.session import canonical_name, materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern of the byte-level vocabulary, as its description gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file; its path is a parameter, the file is never copied."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str = "text", out: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` without ``text``, with the number of tokens; null and empty texts have 0. The
    vocabulary file is read on the driver's machine only and sent to the executors."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    held = os.path.basename(tokenizer)
    keep = [c for c in df.columns if c not in (text, out)]
    schema = df.select(*keep, F.lit(0).cast("bigint").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(SparkFiles.get(held))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(run, schema)


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """How many documents of each length to take so that their tokens come as near below
    ``budget`` as any choice can: (numbers, total).

    Most of the budget is taken in proportion to the counts, and only a rest is fitted by
    the knapsack over the documents left. Where that misses the budget, less is taken in
    proportion: first a rest of two mean texts, doubled up to four of the longest, then of
    every length a number of documents less, doubled as well. An exact choice and the
    proportional one differ by signed documents whose order can be such that all partial
    sums stay within the longest text L; were there more than 3 L of them, two sums would be
    equal and the documents between could be left as they were. So with 3 L documents less of
    each length nothing comes nearer, and the search ends there, where nothing is taken in
    proportion any more, or at the largest multiple of the lengths' common divisor. Its cost
    is bounded by the lengths, not by the number of documents or the budget.
    """
    counts = counts.astype(np.int64)
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return take, 0
    whole = int((lengths * counts).sum())
    if whole <= budget:
        return counts.copy(), whole
    divisor = int(np.gcd.reduce(lengths[(counts > 0) & (lengths > 0)]))
    goal = budget - budget % divisor
    best = (take, 0)
    for base in _bases(lengths, counts, budget, whole):
        left = budget - int((base * lengths).sum())
        if left < 0:
            continue
        fitted = base + _fit_rest(lengths, counts - base, left)
        total = int((fitted * lengths).sum())
        if total > best[1]:
            best = fitted, total
        if best[1] == goal:
            break
    return best


def _bases(lengths: np.ndarray, counts: np.ndarray, budget: int, whole: int) -> Iterator[np.ndarray]:
    """The proportional parts to try, each smaller than the one before; see ``fit_budget``."""
    longest = int(lengths.max())
    rest = 2 * -(-whole // int(counts.sum()))
    while rest < min(budget, 4 * longest):
        yield _in_proportion(counts, (budget - rest) / whole)
        rest *= 2
    full, less = _in_proportion(counts, budget / whole), 1
    while less < 3 * longest and (full > less).any():
        yield np.maximum(full - less, 0)
        less *= 2
    yield np.maximum(full - 3 * longest, 0)


def _in_proportion(counts: np.ndarray, share: float) -> np.ndarray:
    """That share of the documents, even over the lengths: of the documents up to any length
    the number taken is the share to within one document."""
    up_to = np.floor(np.cumsum(counts) * share + 0.5).astype(np.int64)
    return np.minimum(np.diff(up_to, prepend=0), counts)


def _fit_rest(lengths: np.ndarray, free: np.ndarray, left: int) -> np.ndarray:
    """Bounded knapsack: numbers of documents of each length with the largest sum up to ``left``.

    The copies of a length are items of 1, 2, 4, ... documents. Of each sum only the first
    item that reached it is held: the sum without it was reached by earlier items, so every
    length can be asked however long the texts are. Single documents come first, in an
    order spread over the lengths, since the search stops when ``left`` is reached.
    """
    use = [k for k in range(len(lengths)) if free[k] > 0 and 0 < lengths[k] <= left]
    use = [use[k] for k in np.argsort(np.arange(1, len(use) + 1) * 0.6180339887498949 % 1.0, kind="stable")]
    rest = {k: min(int(free[k]), left // int(lengths[k])) for k in use}
    items: list[tuple[int, int]] = []
    copies = 1
    while rest:
        items += [(k, min(copies, n)) for k, n in rest.items()]
        rest = {k: n - copies for k, n in rest.items() if n > copies}
        copies *= 2
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    first = np.full(left + 1, -1, np.int64)
    for at, (k, n) in enumerate(items):
        if reached[left]:
            break
        size = n * int(lengths[k])
        new = np.flatnonzero(reached[: left + 1 - size] & ~reached[size:]) + size
        reached[new] = True
        first[new] = at
    take = np.zeros(len(lengths), np.int64)
    s = int(np.flatnonzero(reached)[-1])
    while s:
        k, n = items[first[s]]
        take[k] += n
        s -= n * int(lengths[k])
    return take


def plan(sizes: dict[str, int], shares: dict[str, float], repeats: dict[str, int], slack: float = 0.15, total: int | None = None) -> tuple[int, dict[str, int]]:
    """(total, budgets in tokens): each source's budget is its share of the total, or all it can
    give (``repeats`` times its tokens) where that is less.

    The total is the largest at which the sources that fall short hold no more than
    ``slack`` of the wanted shares together: the largest, over all sets of sources of at
    most that share, of what the scarcest source outside the set can bear (capacity over
    share). Being a maximum of minima it moves in step with the sizes and never jumps; sources
    without documents are no special case. Sources wanted but empty that hold more than
    ``slack`` make the total 0; a larger ``slack`` or a stated ``total`` helps there.
    """
    can = {s: sizes.get(s, 0) * max(1, repeats[s]) for s in shares}
    if total is None:
        short, total = 0.0, 0
        for s in sorted((s for s in shares if shares[s] > 0), key=lambda s: (can[s] / shares[s], s)):
            short += shares[s]
            total = int(can[s] / shares[s])
            if short > slack * sum(shares.values()) + 1e-9:
                break
    return total, {s: min(can[s], round(total * shares[s])) for s in shares}


def mix(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, tokenizer: str = TOKENIZER, slack: float = 0.15, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Return (chosen, report).

    chosen: (doc_id, source, tokens, repeats): every chosen document with how often it is
    used; no source more than its ``max_repeats`` times. report: (source, target_share,
    max_repeats, documents, available_tokens, budget_tokens, used_tokens, reached_share).

    Source names are compared without case and outer blanks; documents of other or null
    sources, and documents without tokens, are not used. Repeated rows of one id are
    separate documents; in ``chosen`` those of one source and length are one row, their
    repeats added. ``slack`` and ``total`` as in ``plan``. Targets: at most a few thousand rows (they go to the driver, as does
    the histogram's row count per source); a null share is 0, null repeats are 1.
    """
    spark = documents.sparkSession
    goal = {}
    for r in targets.select(canonical_name(source).alias("s"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most")).orderBy("s").collect():
        if r["s"] is not None and r["s"] not in goal:
            goal[r["s"]] = (float(r["share"]), max(1, int(r["most"])))
    sized = materialise(token_counts(documents.select(F.col(id_col).alias("id"), canonical_name(source).alias("source"), F.col(text).alias("text")).where(F.col("source").isin(*goal) if goal else F.lit(False)), "text", "tokens", tokenizer).where("tokens > 0"))
    histogram = materialise(sized.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    totals = {r["source"]: (int(r["t"]), int(r["n"])) for r in histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    _, budgets = plan({s: t for s, (t, _) in totals.items()}, {s: g[0] for s, g in goal.items()}, {s: g[1] for s, g in goal.items()}, slack, total)
    whole = {s: budgets.get(s, 0) // totals[s][0] for s in totals}
    rest = {s: budgets.get(s, 0) - whole[s] * totals[s][0] for s in totals}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one row for each source: its distinct lengths (bounded by the longest text) and counts
        for b in batches:
            ss, ls, ks = [], [], []
            for s, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pairs = sorted((p["tokens"], p["n"]) for p in pairs)
                lengths, ns = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
                take, _ = fit_budget(lengths, ns, rest[s])
                for length, k in zip(lengths.tolist(), take.tolist(), strict=True):
                    if k:
                        ss.append(s)
                        ls.append(length)
                        ks.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ss, pa.string()), pa.array(ls, pa.int64()), pa.array(ks, pa.int64())], names=["source", "tokens", "take"])

    per_source = histogram.groupBy("source").agg(F.collect_list(F.struct("tokens", "n")).alias("pairs"))
    quota = materialise(per_source.mapInArrow(counts, "source string, tokens bigint, take bigint"))
    # the documents of one (source, length) may be many: they are ranked by hash in parts, a part's count moves the next part's ranks
    keyed = sized.withColumn("h", F.xxhash64("id", F.lit(seed)))
    part = F.shiftright("h", 58)
    ranked = keyed.join(quota, ["source", "tokens"]).withColumn("part", part)
    in_part = ranked.groupBy("source", "tokens", "part").agg(F.count(F.lit(1)).alias("k"))
    before = in_part.withColumn("before", F.coalesce(F.sum("k").over(W.partitionBy("source", "tokens").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("k")
    rank = F.row_number().over(W.partitionBy("source", "tokens", "part").orderBy("h", "id"))
    extra = ranked.withColumn("rank", rank).join(before, ["source", "tokens", "part"]).where(F.col("before") + F.col("rank") <= F.col("take")).select("id", "source", "tokens", F.lit(1).alias("repeats"))
    times = spark.createDataFrame([(s, k) for s, k in sorted(whole.items()) if k], "source string, repeats int")
    base = sized.join(F.broadcast(times), "source").select("id", "source", "tokens", "repeats")
    chosen = materialise(base.unionByName(extra).groupBy("id", "source", "tokens").agg(F.sum("repeats").cast("int").alias("repeats")))
    used = {r["source"]: int(r["t"]) for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t")).collect()}
    reached = sum(used.values())
    rows = [(s, goal[s][0], goal[s][1], totals.get(s, (0, 0))[1], totals.get(s, (0, 0))[0], int(budgets.get(s, 0)), used.get(s, 0), round(used.get(s, 0) / reached, 6) if reached else 0.0) for s in sorted(goal)]
    report = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, documents bigint, available_tokens bigint, budget_tokens bigint, used_tokens bigint, reached_share double")
    return chosen.withColumnRenamed("id", id_col), report
