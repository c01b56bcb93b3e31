"""Calls of outside models as strategies: judge, consistency check, moderation, paraphrase, embedding, reward.

The caller hands in a client; a batch of rows goes to it at a time, on the executors. The
operators know nothing of the model behind it, so tests and queries use plain functions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.session import ship

#: A client takes the requests of a batch and returns one reply for each; a factory makes it once on each executor.
Client = Callable[[list[Any]], list[Any]]

# Attempts and seconds between them; what stands for a reply that never came.
ATTEMPTS, WAIT, FAILED = 16, 10.0, "$ERROR$"


def called(df: DataFrame, request: Column, make: Callable[[], Client], out: str, kind: str = "string", attempts: int = ATTEMPTS, wait: float = WAIT, failed: Any = FAILED) -> DataFrame:
    """Add ``out``, the client's reply to ``request``; null requests are not sent and stay null.

    A batch that fails is sent again up to ``attempts`` times, ``wait`` seconds apart, then row
    by row once, so one bad request costs only its own reply, which is ``failed``.
    """
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != out]
    held = df.select(*keep, request.alias("_request"))
    schema = df.select(*keep, F.lit(None).cast(kind).alias(out)).schema
    arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}[kind]

    def ask(client: Client, requests: list) -> list:
        for k in range(attempts):
            try:
                return client(requests)
            except Exception:  # noqa: BLE001 - whatever the client raises is a failed attempt
                if k + 1 < attempts:
                    time.sleep(wait)
        replies = []
        for r in requests:
            try:
                replies += client([r])
            except Exception:  # noqa: BLE001
                replies.append(failed)
        return replies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for b in batches:
            requests = b.column(len(keep)).to_pylist()
            replies = iter(ask(client, [r for r in requests if r is not None])) if any(r is not None for r in requests) else iter(())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([None if r is None else next(replies) for r in requests], arrow)], names=[*keep, out])

    return held.mapInArrow(run, schema)


def embedded(df: DataFrame, text: str, encoder: Callable[[], Client], out: str = "embedding") -> DataFrame:
    """Add the vector of each text by an encoder; a text that cannot be encoded gets null."""
    return called(df, F.col(text), encoder, out, "array<double>", attempts=1, failed=None)


def scored(df: DataFrame, prompt: str, answer: str, scorer: Callable[[], Client], out: str = "reward") -> DataFrame:
    """Add a reward by a scorer of (prompt, answer) pairs; null if either is."""
    pair = F.when(F.col(prompt).isNotNull() & F.col(answer).isNotNull(), F.struct(F.col(prompt).alias("prompt"), F.col(answer).alias("answer")))
    return called(df, pair, scorer, out, "double", attempts=1, failed=None)
