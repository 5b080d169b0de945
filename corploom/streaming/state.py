"""Streaming forms of the keyed rolling states: last values a stream, and words in progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def memory_stream(rows: DataFrame, key: str, step: str, value: str, mem_len: int) -> DataFrame:
    """(key, step, value, memory) for a stream of rows: the mem_len values before each in its key, kept across micro-batches.

    Rows of a key are taken in order of step within a micro-batch; the state is mem_len values a key.
    """
    kinds = dict(rows.dtypes)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for part in [pd.concat(list(parts)).sort_values(step)]:
            memories = []
            for v in part[value]:
                memories.append(list(kept))
                kept = [*kept, v][-mem_len:] if mem_len else []
            yield pd.DataFrame({key: k[0], step: part[step], value: part[value], "memory": memories})
        state.update((kept,))

    out = f"{key} {kinds[key]}, {step} {kinds[step]}, {value} {kinds[value]}, memory array<{kinds[value]}>"
    return rows.select(key, step, value).groupBy(key).applyInPandasWithState(run, out, f"kept array<{kinds[value]}>", "append", GroupStateTimeout.NoTimeout)


def prefix_stream(rows: DataFrame, key: str, step: str, token: str, heads: list[int]) -> DataFrame:
    """(key, step, token, prefix) for a stream of pieces: the pieces since the last head, null before the first, kept across micro-batches."""
    kinds, first = dict(rows.dtypes), frozenset(heads)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists and state.get[0] is not None else None
        part = pd.concat(list(parts)).sort_values(step)
        found = []
        for t in part[token]:
            if t in first:
                kept = []
            if kept is not None:
                kept = [*kept, int(t)]
            found.append(None if kept is None else list(kept))
        state.update((kept,))
        yield pd.DataFrame({key: k[0], step: part[step], token: part[token], "prefix": found})

    out = f"{key} {kinds[key]}, {step} {kinds[step]}, {token} {kinds[token]}, prefix array<bigint>"
    return rows.select(key, step, token).groupBy(key).applyInPandasWithState(run, out, "kept array<bigint>", "append", GroupStateTimeout.NoTimeout)


def loss_windows(rows: DataFrame, ts: str, value: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean and count of value by event-time window of a stream, with a watermark; each window is emitted once, when it is closed."""
    from pyspark.sql import functions as F

    return rows.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))
