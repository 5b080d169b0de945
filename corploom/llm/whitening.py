"""Whitening of embeddings by a tall-skinny QR factorisation.

Vectors become whole numbers, their sums are exact, and each distinct vector is centred by them before anything is multiplied. Every
task factors its rows into one triangle R, triangles are merged by a tree of further factorisations, and the singular values and right
vectors of the last one give variances and components: no covariance matrix is formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.llm.scratch import Scratch

#: Triangles that one merge takes, and rows that are centred and factored at once.
FAN_IN, BLOCK_ROWS = 16, 8192


def whole_numbers(embedding: Column) -> Column:
    """floor(256 c) of every entry c as a double (beyond a long: its nearest end); null for an array that is null or has null or non-finite entries."""
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda c: F.floor(c.cast("double") * 256.0).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as whole numbers; shorter ones end in zeros."""
    flat, sizes = np.asarray(column.flatten(), dtype=np.int64), np.asarray(column.value_lengths())
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows of fit (x) and the sum of each dimension, exact: a row of sums for each task, added up by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        for batch in _blocks(batches):
            x = _matrix(batch.column(0), width)
            n += len(x)
            high += (x >> 31).sum(axis=0)  # in two parts, so that large entries don't overflow
            low += (x & 0x7FFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([0, *high.tolist()], pa.int64()), pa.array([n, *low.tolist()], pa.int64())], names=["dim", "high", "low"])

    wide = "decimal(38,0)"
    rows = fit.select("x").mapInArrow(add, "dim int, high long, low long").groupBy("dim").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).collect()  # a row a dimension
    got = {r["dim"]: int(r["high"]) * 2**31 + int(r["low"]) for r in rows}
    return got.get(-1, 0), [got.get(k, 0) for k in range(width)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray | None]:
    """x - S/n as doubles, of whole numbers n x - S where these fit, and those (None where they don't)."""
    most = max(1, int(np.abs(x).max(initial=0)), -int(x.min(initial=0)))
    if n * most < 2**61 and max(map(abs, sums), default=0) < 2**61:
        whole = x * np.int64(n) - np.array(sums, dtype=np.int64)
        return whole / float(n), whole
    whole = x.astype(object) * n - np.array(sums, dtype=object)
    return (whole / n).astype(np.float64), None


def triangle(fit: DataFrame, n: int, sums: list[int], scratch: Scratch) -> np.ndarray:
    """R of the QR factorisation of fit's centred rows: R'R is n times their covariance. A task holds a block of rows and one triangle."""
    width = len(sums)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for batch in _blocks(batches):
            x = _centred(_matrix(batch.column(0), width), n, sums)[0]
            if len(x):
                r = np.linalg.qr(np.vstack((r, x)), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["part", "r"])

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        stack = [np.frombuffer(x, dtype="<f8").reshape(-1, width) for x in group.sort_values("part")["r"]]
        r = np.linalg.qr(np.vstack(stack), mode="r")
        return pd.DataFrame({"part": [int(key[0])], "r": [r.astype("<f8").tobytes()]})

    rows = scratch.save(fit.select("x").mapInArrow(factor, "part int, r binary"))
    while (count := rows.count()) > FAN_IN:
        rows = scratch.save(rows.groupBy((F.col("part") / FAN_IN).cast("int").alias("part_")).applyInPandas(merge, "part int, r binary"))
        if rows.count() == count:  # numbers of tasks have gaps: the next merge takes wider ranges
            rows = scratch.save(rows.withColumn("part", (F.col("part") / FAN_IN).cast("int")))
    last = [np.frombuffer(x["r"], dtype="<f8").reshape(-1, width) for x in rows.orderBy("part").collect()]  # FAN_IN triangles at the most
    return np.linalg.qr(np.vstack(last), mode="r") if last else np.zeros((0, width))


def components(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, components as columns, trace) of the covariance whose n-fold is R'R, the largest first; the entry of a component that is largest is positive."""
    if not r.size:
        return np.zeros(0), np.zeros((r.shape[1], 0)), 0.0
    _, s, vt = np.linalg.svd(r, full_matrices=True)
    s = np.concatenate((s, np.zeros(len(vt) - len(s))))
    k = min(most, len(vt))
    v = vt[:k].T.copy()
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
    return (s * s / n)[:k], v, math.fsum(s * s) / n


def whiten(vectors: DataFrame, scratch: Scratch, most: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row of vectors (vec_id, embedding) and each
    component up to most (or the number of dimensions, if that is less).

    Usable vectors are not null and have no null or non-finite entry; zero vectors are usable. Each entry is floor(256 c). The fit list
    has each distinct vector once, so repeated rows don't weigh; each of them gets its rows all the same. Vectors shorter than the longest end
    in zeros. A component without variance (all vectors equal, or fewer than dimensions) whitens to 0, explains 0 and is left out of
    identity_error, which is 0 if no component varies. deviation is null where it exceeds a long. A null vec_id stays null, other
    columns are ignored, and no usable vectors give no rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double"
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    fit = scratch.save(usable.select("x").distinct())
    width = fit.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:  # no vector, or none with an entry
        return vectors.sparkSession.createDataFrame([], schema + ", identity_error double")
    # shorter vectors may be equal once they end in zeros
    if fit.where(F.size("x") < width).limit(1).count():
        fit = scratch.save(fit.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x")).distinct())
    n, sums = exact_sums(fit, width)
    values, v, trace = components(triangle(fit, n, sums, scratch), n, most)
    varies = values > (values[0] if len(values) else 0.0) * 1e-24
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    shares = np.where(varies, values / (trace or 1.0), 0.0)
    projection = v * scale

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(scale)
        for batch in _blocks(batches):
            x = _matrix(batch.column(1), width)
            centred, whole = _centred(x, n, sums)
            if whole is not None and width * int(np.abs(whole).max(initial=0)) ** 2 < 2**63:
                deviation = pa.array((whole * whole).sum(axis=1), pa.int64())
            else:
                exact = x.astype(object) * n - np.array(sums, dtype=object)
                found = [sum(int(c) ** 2 for c in row) for row in exact]
                deviation = pa.array([d if d < 2**63 else None for d in found], pa.int64())
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n, dtype=np.int64)), deviation.take(pa.array(rows)), pa.array((centred @ projection).ravel()), pa.array(np.tile(shares, len(x)))],
                names=[c.split()[0] for c in schema.split(", ")],
            )

    used = [k for k in range(len(scale)) if varies[k]]
    error = 0.0
    if used:
        # the fit list's own covariance after whitening, centred by Spark's covar_pop
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _blocks(batches):
                w = _centred(_matrix(batch.column(0), width), n, sums)[0] @ projection
                yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in used], names=[f"w{k}" for k in used])

        white = fit.select("x").mapInArrow(own, ", ".join(f"w{k} double" for k in used))
        row = white.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a in used for b in used if a <= b]).first()
        error = max(abs(row[f"c{a}_{b}"] - (a == b)) for a in used for b in used if a <= b)
    return usable.mapInArrow(project, schema).withColumn("identity_error", F.lit(float(error)))
