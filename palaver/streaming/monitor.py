"""Streams over vote logs: counts, windows, a worker registry with expiry, session leases, deltas.

The batch programs have no watermark and recompute everything; ``type_counts`` does the
same incrementally in complete mode. Watermarks and windows are an extension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EXPIRY, LEASE = 90.0, 3600.0


def type_counts(events: DataFrame, kind: str) -> DataFrame:
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def hourly(events: DataFrame, ts: str, late: str | None = "2 days") -> DataFrame:
    """Tumbling hours of event time; with ``late`` a watermark bounds the state."""
    held = events.withWatermark(ts, late) if late else events
    return held.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "n")


def trailing(events: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Sliding hour, every quarter: the stream form of the trailing window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.end").alias("until"), "n")


def registry(beats: DataFrame, expiry: float = EXPIRY) -> DataFrame:
    """Worker registry over a stream of heartbeats (worker, at, speed, queue): for each batch the
    worker's latest beat; a worker silent for ``expiry`` seconds of processing time is reported as gone."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, speed, queue = state.get
            state.remove()
            yield pd.DataFrame({"worker": [key[0]], "last": [last], "speed": [speed], "queue": [queue], "alive": [False]})
            return
        last, speed, queue = state.get if state.exists else (float("-inf"), 0.0, 0)
        for b in batches:
            if len(b) and b["at"].max() >= last:
                r = b.loc[b["at"].idxmax()]
                last, speed, queue = float(r["at"]), float(r["speed"]), int(r["queue"])
        state.update((last, speed, queue))
        state.setTimeoutDuration(int(expiry * 1000))
        yield pd.DataFrame({"worker": [key[0]], "last": [last], "speed": [speed], "queue": [queue], "alive": [True]})

    return beats.groupBy("worker").applyInPandasWithState(update, "worker string, last double, speed double, queue long, alive boolean", "last double, speed double, queue long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def registry_batch(beats: DataFrame, now: float, expiry: float = EXPIRY) -> DataFrame:
    """The registry at a moment: latest beat per worker, without those silent for longer than ``expiry``."""
    last = beats.groupBy("worker").agg(F.max_by(F.struct("at", "speed", "queue"), "at").alias("b"))
    return last.select("worker", F.col("b.at").alias("last"), F.col("b.speed").alias("speed"), F.col("b.queue").alias("queue")).where(F.col("last") >= now - expiry)


def status(workers: DataFrame) -> DataFrame:
    return workers.agg(F.count(F.lit(1)).alias("workers"), F.sum("speed").alias("speed"), F.sum("queue").alias("queue"))


def shortest_queue(workers: DataFrame) -> DataFrame:
    """The worker with the least queue for its speed; the first by name on ties."""
    return workers.agg(F.min_by("worker", F.struct(F.col("queue") / F.col("speed"), "worker")).alias("worker"))


def leases(events: DataFrame, key: str, at: str, lease: float = LEASE) -> DataFrame:
    """Sessions with a fixed lease from their first event, not extended by activity: an event
    after the lease begins a new one: (key, start, events).

    Events are first counted by key and second, sorted within partitions, and folded in a
    stream with the current lease as the only state, so a hot key is never held as a whole.
    """
    counted = events.where(F.col(at).isNotNull() & F.col(key).isNotNull()).groupBy(key, F.col(at).cast("double").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.repartition(key).sortWithinPartitions(key, "t")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, n = None, 0.0, 0
        for b in batches:
            out = []
            for k, t, c in zip(b[key], b["t"], b["n"], strict=True):
                if k != now or t >= start + lease:
                    if n:
                        out.append((now, start, n))
                    now, start, n = k, t, 0
                n += c
            yield pd.DataFrame(out, columns=[key, "start", "events"])
        if n:
            yield pd.DataFrame([(now, start, n)], columns=[key, "start", "events"])

    return ordered.mapInPandas(fold, f"{key} string, start double, events bigint")


def lease_stream(events: DataFrame, key: str, at: str, lease: float = LEASE) -> DataFrame:
    """The stream form of ``leases``: state is the start of the current lease."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = state.get[0] if state.exists else None
        out = []
        for b in batches:
            for t in sorted(b[at].dropna()):
                if start is None or t >= start + lease:
                    start = float(t)
                    out.append(start)
        if start is not None:
            state.update((start,))
        yield pd.DataFrame({key: [k[0]] * len(out), "start": out})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} string, start double", "start double", "append", GroupStateTimeout.NoTimeout)


def deltas(chunks: DataFrame, request: str, seq: str, text: str) -> DataFrame:
    """New part of each cumulative chunk; an empty part is null."""
    before = F.coalesce(F.lag(text).over(W.partitionBy(request).orderBy(seq)), F.lit(""))
    new = F.substring(F.col(text), F.char_length(before) + 1, F.char_length(F.col(text)))
    return chunks.withColumn("delta", F.when(new != "", new))


def last_chunks(chunks: DataFrame, request: str, seq: str, text: str) -> DataFrame:
    return chunks.groupBy(request).agg(F.max_by(text, seq).alias(text), F.count(F.lit(1)).alias("chunks"))


def stopped(chunks: DataFrame, text: str, stop: str) -> DataFrame:
    """Chunks of a growing reply as they may be shown: cut before the first stop string, and without
    an end that may become one; ``finished`` tells whether the stop was found."""
    at, size = F.instr(F.col(text), stop), F.char_length(text)
    # the longest beginning of the stop string that the text ends with
    held = F.coalesce(*[F.when(F.col(text).endswith(stop[:k]), F.substring(F.col(text), F.lit(1), size - k)) for k in range(len(stop) - 1, 0, -1)], F.col(text))
    return chunks.withColumn("shown", F.when(at > 0, F.substring(F.col(text), F.lit(1), at - 1)).otherwise(held)).withColumn("finished", at > 0)


def elo_batches(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that carries the online Elo on: the ratings of each batch start from
    those of the batch before, which are read back from ``path``; a batch that is run again
    starts from the same ones. Batches come in the order of their battles."""
    from palaver.operators.ratings import online_elo

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        start = {r["model"]: r["rating"] for r in spark.read.parquet(f"{path}/{epoch - 1}").collect()} if epoch else {}  # a list of models
        online_elo(batch, order, start=start).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return fold


def refreshed(events: DataFrame, report: Callable[[DataFrame, int], None], seconds: int = 300):
    """A query that calls ``report`` with each batch every ``seconds``."""
    return events.writeStream.foreachBatch(report).trigger(processingTime=f"{seconds} seconds")
