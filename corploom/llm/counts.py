"""Tables of a fixed number of counters summed over all rows: each task sends slices, and no task or driver gets more than one table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Counters in a slice: 16 KB, so that a table of 2**20 is dealt out as 256 rows.
SLICE = 4096


def _sliced(table: np.ndarray) -> pa.RecordBatch:
    used = [k for k in range(len(table) // SLICE) if table[k * SLICE : (k + 1) * SLICE].any()]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([table[k * SLICE : (k + 1) * SLICE].astype("<i8").tobytes() for k in used], pa.binary())], names=["slice", "counts"])


def count_table(df: DataFrame, size: int, indices: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> np.ndarray:
    """counts[i] = how often indices() names i over all of df's batches. size: a multiple of SLICE, and fixed, never by the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for found in indices(batch):
                table += np.bincount(found, minlength=size)
        yield _sliced(table)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(blob, dtype="<i8")
                if k in sums:
                    sums[k] += got
                else:
                    sums[k] = got.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    parts = max(1, min(size // SLICE, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = np.zeros(size, dtype=np.int64)
    for row in df.mapInArrow(count, schema).repartition(parts, "slice").mapInArrow(add, schema).collect():  # size counters in all
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], dtype="<i8")
    return out
