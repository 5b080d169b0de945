"""Approximate nearest neighbours by collision counting over single projections.

Each of LINES random lines orders a block's vectors by their projection. Around a query's own projection a window opens on every
sorted line and widens (virtual rehashing); a vector that lies in the windows of enough lines is verified by its exact
distance. A vector at distance s lies within h of the query on one line with probability erf(h / (s sqrt 2)), so there is a
half-width at which one at the k-th best distance collides often enough with probability CERTAIN: a block ends there, and
nothing caps candidates.

Vectors don't move: a task reads its part of the table into blocks and searches each for a bounded set of queries that all
tasks get; the best distances that a task has found so far narrow its later windows. Tables of more queries take several passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corploom.llm.scratch import Scratch
from corploom.llm.vectors import finite, matrix

#: At most 255: collisions are counted in bytes.
LINES = 240
#: Part of the lines whose windows a candidate lies in, and the least probability that one at the k-th distance does.
THRESHOLD, CERTAIN = 0.78, 0.92
#: Vectors of one block (below 2**15: places on a line are 16-bit numbers) and queries of one pass.
BLOCK_ROWS, QUERY_ROWS = 32000, 8192


def reach(lines: int = LINES, threshold: float = THRESHOLD, certain: float = CERTAIN) -> float:
    """The least window half-width, in units of the distance, at which a vector at that distance collides on enough lines with probability certain."""
    need = math.ceil(threshold * lines)
    low, high = 0.0, 6.0
    for _ in range(40):
        mid = (low + high) / 2
        p = math.erf(mid / math.sqrt(2))
        logs = [math.lgamma(lines + 1) - math.lgamma(i + 1) - math.lgamma(lines - i + 1) + i * math.log(p) + (lines - i) * math.log1p(-p) for i in range(need, lines + 1)] if 0 < p < 1 else [0.0 if p else -math.inf]
        low, high = (low, mid) if sum(map(math.exp, logs)) >= certain else (mid, high)
    return high


class Block:
    """Sorted projections of some vectors. Equal vectors are one place, with their ids in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lines: np.ndarray, k: int):
        order = np.lexsort((ids, *x.T[::-1])) if len(x) > 1 else np.zeros(len(x), dtype=np.int64)
        ids, x = ids[order], x[order]
        first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1))))
        size = np.diff(np.concatenate((first, [len(ids)])))
        self.x, self.first, self.size = x[first], first, np.minimum(size, k)  # of equal vectors no more than the first k ids count
        self.ids, self.k = ids, k
        along = (self.x @ lines).astype(np.float32)
        turn = np.argsort(along, axis=0)
        self.sorted = np.take_along_axis(along, turn, axis=0).T.copy()
        self.rank = np.empty(self.sorted.shape, dtype=np.uint16)
        np.put_along_axis(self.rank, turn.T, np.arange(len(self.x), dtype=np.uint16)[None], axis=1)
        self.few = self.x[:: max(1, len(self.x) // 512)]
        self.verified = self.asked = 0

    def collisions(self, centre: np.ndarray, width: float) -> np.ndarray:
        """On how many lines each place lies in the query's window of the sorted array."""
        hits = np.zeros(len(self.x), dtype=np.uint8)
        work = np.empty(len(self.x), dtype=np.uint16)
        inside = np.empty(len(self.x), dtype=bool)
        ones = inside.view(np.uint8)
        for line, rank, c in zip(self.sorted, self.rank, centre, strict=True):
            a, b = line.searchsorted(np.float32(c - width)), line.searchsorted(np.float32(c + width), "right")
            if b > a:  # places from a to before b: one unsigned comparison
                np.subtract(rank, np.uint16(a), out=work)
                np.less(work, np.uint16(b - a), out=inside)
                np.add(hits, ones, out=hits)
        return hits

    def search(self, q: np.ndarray, centre: np.ndarray, known: float, step: float, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of rows among the k nearest of the block and of what is known: known is the k-th best distance so far."""
        self.asked += len(self.x)
        if math.isfinite(known):
            width = step * known
        else:  # the k-th distance that a few rows suggest
            d2 = ((self.few - q) ** 2).sum(axis=1)
            share = min(0.5, self.k / max(1, len(self.ids)))
            tail = math.sqrt(max(0.0, -2 * math.log(2 * share)))
            width = step * math.sqrt(max(float(d2.mean() - tail * d2.std()), float(d2.mean()) / 16, 1e-18))
        tried = np.zeros(len(self.x), dtype=bool)
        at, far = np.zeros(0, dtype=np.int64), np.zeros(0)
        while True:
            new = np.flatnonzero((self.collisions(centre, width) >= need) & ~tried)
            if len(new):
                tried[new] = True
                self.verified += len(new)
                d = np.sqrt(((self.x[new] - q) ** 2).sum(axis=1))
                at, far = np.concatenate((at, new)), np.concatenate((far, d))
                order = np.argsort(far, kind="stable")
                at, far = at[order], far[order]
            reached = np.cumsum(self.size[at])
            kth = far[np.searchsorted(reached, self.k)] if len(at) and reached[-1] >= self.k else math.inf
            kth = min(kth, known)
            if width >= step * kth or tried.all():
                break
            # once k are found their distance says how far to go; until then windows grow
            width = step * kth * (1 + 1e-9) if math.isfinite(kth) else width * 1.3
        keep = far <= kth
        at, far = at[keep], far[keep]
        where = np.concatenate([np.arange(self.first[i], self.first[i] + self.size[i]) for i in at]) if len(at) else np.zeros(0, dtype=np.int64)
        return np.repeat(far, self.size[at]), self.ids[where]


class Search:
    """The k nearest of some queries over successive blocks."""

    def __init__(self, queries: np.ndarray, k: int, seed: int = 29):
        self.q, self.k = queries, k
        self.lines = np.random.default_rng(seed).standard_normal((queries.shape[1], LINES))
        self.centres = queries @ self.lines
        self.need, self.step = math.ceil(THRESHOLD * LINES), reach()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(queries)
        self.verified = self.asked = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        block = Block(ids, x, self.lines, self.k)
        for i, (q, centre) in enumerate(zip(self.q, self.centres, strict=True)):
            far, own = self.best[i]
            d, found = block.search(q, centre, far[-1] if len(far) == self.k else math.inf, self.step, self.need)
            far, own = np.concatenate((far, d)), np.concatenate((own, found))
            order = np.lexsort((own, far))[: self.k]
            self.best[i] = far[order], own[order]
        self.verified += block.verified
        self.asked += block.asked


def search_part(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """(query, vec_id, score) of the k nearest of each query among the batches' rows (vec_id, embedding). queries: length -> (numbers, vectors)."""
    searches = {dims: Search(q, k) for dims, (_, q) in queries.items()}
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {dims: [] for dims in queries}

    def flush(dims: int, least: int) -> None:
        if sum(len(i) for i, _ in waiting[dims]) >= least:
            ids, x = (np.concatenate(p) for p in zip(*waiting[dims], strict=True))
            for at in range(0, len(ids), BLOCK_ROWS):
                searches[dims].add(ids[at : at + BLOCK_ROWS], x[at : at + BLOCK_ROWS])
            waiting[dims] = []

    for batch in batches:
        sizes = np.asarray(batch.column(1).value_lengths())
        for dims in queries:
            part = batch.filter(pa.array(sizes == dims))
            if part.num_rows:
                waiting[dims].append((np.asarray(part.column(0)), matrix(part.column(1))))
                flush(dims, BLOCK_ROWS - batch.num_rows)
    for dims, (numbers, _) in queries.items():
        flush(dims, 1)
        best = searches[dims].best
        n = [len(d) for d, _ in best]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, n), pa.int64()), pa.array(np.concatenate([i for _, i in best]), pa.int64()), pa.array(np.concatenate([d for d, _ in best]), pa.float64())], names=["query", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of vectors by Euclidean distance, nearest first, ties to smaller vec_id.

    Both tables are (vec_id, embedding). Vectors and queries that are null, zero or hold null or non-finite components, or have a null
    id, take no part; vectors of another length aren't compared. A query's own row, that is one row of vectors with its id and its
    vector, is no candidate; other rows with its id are. Fewer than k candidates give them all. Repeated rows of vectors are candidates
    each; repeated rows of queries give their rows each. Empty tables give no rows; other columns are ignored.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))

    x = usable(vectors)
    # equal queries are asked once; numbers are told apart later by what they were asked for
    q = scratch.save(usable(queries).groupBy("vec_id", "embedding").agg(F.count("*").alias("times")).withColumn("query", F.monotonically_increasing_id()))
    passes = max(1, math.ceil(q.count() / QUERY_ROWS))
    parts = []
    for turn in range(passes):
        # a bounded number of rows: QUERY_ROWS, give or take chance
        held = q.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == turn).select("query", "embedding").toArrow().combine_chunks()
        numbers, column = np.asarray(held["query"]), held["embedding"].combine_chunks() if held.num_rows else None
        if column is None:
            continue
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        sizes = np.asarray(column.value_lengths())
        sets = {int(dims): (numbers[sizes == dims], matrix(column.filter(pa.array(sizes == dims)))) for dims in np.unique(sizes)}
        shared = q.sparkSession.sparkContext.broadcast(sets)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            # one more than asked for: the query's own row is among them, or as near as k others with smaller ids
            return search_part(batches, shared.value, k + 1)

        parts.append(scratch.save(x.mapInArrow(run, "query long, vec_id long, score double")))
    schema = "query_id long, rank int, vec_id long, score double"
    if not parts:
        return scratch.save(q.sparkSession.createDataFrame([], schema), keep=True)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    by = Window.partitionBy("query").orderBy("score", "vec_id")
    # Spark keeps the first rows of each query before the shuffle as well
    top = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1)
    named = top.join(q.select("query", F.col("vec_id").alias("query_id"), "times"), "query")
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0), F.col("place"))).over(Window.partitionBy("query"))
    ranked = named.withColumn("own", own).where(F.col("own").isNull() | (F.col("place") != F.col("own")))
    ranked = ranked.withColumn("rank", (F.col("place") - F.when(F.col("place") > F.col("own"), 1).otherwise(0)).cast("int")).where(F.col("rank") <= k)
    again = ranked.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return scratch.save(again.select("query_id", "rank", "vec_id", "score"), keep=True)
