"""Embedding near-duplicates by product quantisation.

A coarse quantiser of K centroids makes inverted lists; a vector's residual from its list's centroid is coded by
subspaces. Distances from a query to a list's members are sums of table look-ups (asymmetric: the query isn't coded):
|v - c|^2 + (|w|^2 + 2 c w) - 2 v w, for a member coded as c + w, where only the last term depends on both and comes from the query's
table. Each member keeps the norm of its coding error, so a look-up distance that exceeds the limit by more than that norm
proves that the true distance does. Survivors are compared by exact cosine in double precision.

A query visits the lists whose cell a vector within the limit may lie in. Two vectors within reach r differ along the
line between two centroids by r at the most, and by r / sqrt(d) times a standard normal if their difference has no preferred
direction; lists whose bisecting plane is farther than DEVIATIONS of these aren't visited. So few lists are probed, and a link at the very limit
is lost with the probability of such a deviation, one of a closer pair with much less; recall against brute force is in the README and tested.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.llm.components import components
from corploom.llm.scratch import Scratch
from corploom.llm.vectors import finite, matrix

#: Rows that the quantisers are fitted on: SAMPLE_ROWS, or SAMPLE_PER_LIST for each list if that is more; every row is indexed.
SAMPLE_ROWS, SAMPLE_PER_LIST = 40_000, 5
#: Lists: LISTS_ROOT times the root of the number of vectors, at most MOST_LISTS (reached at some 700 million vectors of one length). Beyond FLAT_LISTS
#: the centroids are fitted in two levels.
LISTS_ROOT, MOST_LISTS, FLAT_LISTS = 2.5, 65536, 4096
#: See above; math.inf visits every list that can hold a vector within the limit, so that no link is lost.
DEVIATIONS = 2.0
#: Entries of a block of distances from rows to centroids.
DISTANCES = 1 << 21
#: Members of one list and label that are compared at once; of longer ones each block is compared. Rows of one task, about.
BLOCK_ROWS, TASK_ROWS = 2048, 16384
#: Pairs looked up at once.
PAIRS = 1 << 17
SUBSPACE = 4
CODES = 256


def _blocks(rows: int, lists: int) -> Iterator[slice]:
    """Slices of rows such that a block's distances to all lists stay within DISTANCES entries."""
    step = max(16, min(1024, DISTANCES // max(1, lists)))
    return (slice(at, at + step) for at in range(0, rows, step))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroid that is nearest to each row."""
    square = (c * c).sum(axis=1)
    own = np.zeros(len(x), dtype=np.int64)
    for rows in _blocks(len(x), len(c)):
        own[rows] = (square - 2 * x[rows] @ c.T).argmin(axis=1)
    return own


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centroids of Lloyd's rounds from a random start; fewer rows than k give a centroid each."""
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator, flat: int = FLAT_LISTS) -> np.ndarray:
    """About k centroids, at most one a row. More than flat of them are fitted in two levels: some root of k first, then inside each of their cells
    as many as its share of rows, so that a row is compared with about two roots of k centroids and not with k."""
    if k <= flat or len(x) <= k:
        return _kmeans(x, k, rng)
    own = _nearest(x, upper := _kmeans(x, math.ceil(math.sqrt(k)), rng))
    size = np.bincount(own, minlength=len(upper))
    share = np.diff(np.floor(np.cumsum(size) * (k / len(x)) + 1e-9).astype(np.int64), prepend=0)
    order = np.argsort(own, kind="stable")
    cells = np.split(order, np.cumsum(size)[:-1])
    return np.concatenate([_kmeans(x[cell], max(1, int(n)), rng) for cell, n in zip(cells, share, strict=True) if len(cell)])


@dataclass
class Index:
    """centroids (K, d) and, for each subspace, codewords."""

    centroids: np.ndarray
    words: list[np.ndarray]

    def parts(self) -> list[slice]:
        d = self.centroids.shape[1]
        return [slice(a, min(a + SUBSPACE, d)) for a in range(0, d, SUBSPACE)]

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, subspaces) and the norm of each row's coding error."""
        codes, error = [], np.zeros(len(residuals))
        for part, words in zip(self.parts(), self.words, strict=True):
            r = residuals[:, part]
            far = (r * r).sum(axis=1)[:, None] - 2 * r @ words.T + (words * words).sum(axis=1)
            best = far.argmin(axis=1)
            codes.append(best)
            error += np.maximum(far[np.arange(len(r)), best], 0)
        return np.stack(codes, axis=1), np.sqrt(error)

    def terms(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """|w|^2 + 2 c w of members of lists home with these codes."""
        out = np.zeros(len(home))
        for s, (part, words) in enumerate(zip(self.parts(), self.words, strict=True)):
            w = words[codes[:, s]]
            out += (w * w).sum(axis=1) + 2 * (self.centroids[home][:, part] * w).sum(axis=1)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query with each codeword: (queries, subspaces * CODES)."""
        out = np.zeros((len(queries), len(self.words), CODES), dtype=np.float32)
        for s, (part, words) in enumerate(zip(self.parts(), self.words, strict=True)):
            out[:, s, : len(words)] = queries[:, part] @ words.T
        return out.reshape(len(queries), -1)


def fit(sample: np.ndarray, lists: int, seed: int = 17) -> Index:
    """Fit on unit vectors."""
    rng = np.random.default_rng(seed)
    c = _centroids(sample, lists, rng)
    r = sample - c[_nearest(sample, c)]
    index = Index(c, [])
    index.words = [_kmeans(r[:, part], CODES, rng, 4) for part in index.parts()]
    return index


_PLACED = "home int, probes array<int>, code binary, error float, term float"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _assign(rows: DataFrame, index: Index, reach: float, deviations: float = DEVIATIONS) -> DataFrame:
    """rows (node, label, embedding, copies) with home, the list, its code, and probes: home and later lists that may hold a vector within reach."""
    c = index.centroids
    margin = 2 * (reach + 1e-9) * min(1.0, deviations / math.sqrt(c.shape[1]))
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        c = index.centroids
        square = (c * c).sum(axis=1)
        for batch in batches:
            for rows in _blocks(batch.num_rows, len(c)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                x = _unit(matrix(part.column(2)))
                far = 1 - 2 * x @ c.T + square
                home = far.argmin(axis=1)
                gap = np.sqrt(np.maximum(square[home][:, None] + square - 2 * c[home] @ c.T, 0))
                # the distance to the plane halfway between home and another list
                near = far - far[np.arange(len(x)), home][:, None] <= margin * gap
                near[np.arange(len(x)), home] = True
                near &= np.arange(len(c)) >= home[:, None]
                row, lists = np.nonzero(near)
                probes = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x) + 1)), pa.int32()), pa.array(lists, pa.int32()))
                codes, error = index.encode(x - c[home])
                code = [r.tobytes() for r in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home, pa.int32()), probes, pa.array(code, pa.binary()), pa.array(error, pa.float32()), pa.array(index.terms(home, codes), pa.float32())], names=["node", "label", "embedding", "copies", "home", "probes", "code", "error", "term"])

    fields = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, {_PLACED}")


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, the least place that links reach, after links a-b between places."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]
    return label


def _compare(shared, limit: float):
    reach = math.sqrt(max(0.0, 2 - 2 * limit)) + 1e-6

    def run(table: pa.Table) -> pa.Table:
        """Links of queries to members of the cells (a list's block) that they probe: a count a vector, and a forest of links."""
        index = shared.value
        member = np.asarray(table["member"])
        split = [table.filter(pa.array(member == flag)).combine_chunks() for flag in (True, False)]
        own = {name: [np.asarray(t[name]) for t in split] for name in ("node", "copies", "home")}
        cells = [pa.concat_arrays(t["cells"].chunks) if t.num_rows else None for t in split]
        none = pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if cells[0] is None or cells[1] is None:
            return none
        m, q = (matrix(pa.concat_arrays(t["embedding"].chunks)) for t in split)
        cell = np.asarray(cells[0].flatten().field("cell"))
        order = np.argsort(cell, kind="stable")
        cell, m = cell[order], m[order]
        node, copies = own["node"][0][order], own["copies"][0][order]
        code = np.stack([np.frombuffer(b, dtype=np.uint8) for b in split[0]["code"].to_pylist()])[order].astype(np.int64) + np.arange(len(index.words)) * CODES
        error, term = np.asarray(split[0]["error"])[order], np.asarray(split[0]["term"])[order]
        length, q_length = np.sqrt((m * m).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        limits = (reach + error) ** 2 + 1e-4 - term
        asked = cells[1].flatten()
        begin, list_ = np.asarray(asked.field("cell")), np.asarray(asked.field("list"))
        row = np.repeat(np.arange(len(q)), np.asarray(cells[1].value_lengths()))
        first, end = cell.searchsorted(begin, "left"), cell.searchsorted(begin, "right")
        nodes = np.unique(np.concatenate((node, own["node"][1])))
        here, there = np.searchsorted(nodes, own["node"][1]), np.searchsorted(nodes, node)
        label, links = np.arange(len(nodes)), np.zeros(len(nodes), dtype=np.int64)
        for at in range(0, len(q), 512):
            rows = slice(*np.searchsorted(row, (at, min(at + 512, len(q)))))
            v = _unit(q[at : at + 512])
            tables = index.tables(v)
            r, f, n, k = row[rows], first[rows], (end - first)[rows], list_[rows]
            base = ((v[r - at] - index.centroids[k]) ** 2).sum(axis=1)
            cuts = [0, *(np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum(), PAIRS)) + 1).tolist(), len(n)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                size = n[lo:hi]
                if not size.sum():
                    continue
                which = np.repeat(np.arange(lo, hi), size)
                b = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + f[which]
                a = r[which]
                # each pair of one list once
                once = (own["home"][1][a] != k[which]) | (own["node"][1][a] < node[b])
                which, a, b = which[once], a[once], b[once]
                sums = np.zeros(len(a), dtype=np.float32)
                for s in range(code.shape[1]):
                    sums += tables[a - at, code[b, s]]
                near = base[which] - 2 * sums <= limits[b]
                a, b = a[near], b[near]
                cosine = np.concatenate([(q[a[i : i + 8192]] * m[b[i : i + 8192]]).sum(axis=1) for i in range(0, len(a), 8192)] or [np.zeros(0)]) / (q_length[a] * length[b])
                a, b = a[cosine >= limit], b[cosine >= limit]
                links += np.bincount(here[a], weights=copies[b], minlength=len(nodes)).astype(np.int64) + np.bincount(there[b], weights=own["copies"][1][a], minlength=len(nodes)).astype(np.int64)
                label = _joined(label, here[a], there[b])
        linked, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({
            "node": pa.array(np.concatenate((nodes[linked], nodes[moved])), pa.int64()),
            "other": pa.array(np.concatenate((np.full(len(linked), -1), nodes[label[moved]])), pa.int64()),
            "links": pa.array(np.concatenate((links[linked], np.zeros(len(moved), dtype=np.int64))), pa.int64()),
        })

    return run


def _small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, sent to all executors if it has few rows; otherwise Spark shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def _links(nodes: DataFrame, n: int, limit: float, scratch: Scratch, deviations: float = DEVIATIONS) -> DataFrame:
    """(node, other, links) of nodes of one length: links a node, or with other a link of a forest."""
    lists = max(1, min(MOST_LISTS, math.ceil(LISTS_ROOT * math.sqrt(n))))
    wanted = max(SAMPLE_ROWS, SAMPLE_PER_LIST * lists)
    # a hash chooses about as many rows as are wanted; a chance excess is cut
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < max(1, min(1_000_000, math.ceil(1.05e6 * wanted / n)))).select("embedding").limit(2 * wanted).toArrow()
    if not sample.num_rows:
        sample = nodes.select("embedding").limit(wanted).toArrow()
    index = fit(_unit(matrix(pa.concat_arrays(sample["embedding"].chunks))), lists)
    placed = scratch.save(_assign(nodes.select("node", "label", "embedding", "copies"), index, math.sqrt(2 - 2 * limit), deviations))
    # a list's members of one label in blocks of about BLOCK_ROWS, and likewise those that probe it
    sizes = placed.groupBy("label", "home").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    probing = placed.select("node", "label", F.explode("probes").alias("home"))
    asked = probing.groupBy("label", "home").agg(F.ceil(F.count("*") / (4 * BLOCK_ROWS)).cast("int").alias("query_blocks"))
    grid = _small(scratch.save(sizes.join(asked, ["label", "home"])))
    salt, tasks = F.xxhash64("node"), max(1, math.ceil(2 * n / TASK_ROWS))
    cell = F.xxhash64("label", "home", "block", "query_block")
    keyed = lambda df: df.withColumn("cell", cell).withColumn("key", F.pmod("cell", F.lit(tasks)).cast("int"))
    range_ = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    members = keyed(placed.drop("probes").join(grid, ["label", "home"]).withColumn("block", F.pmod(salt, F.col("blocks")).cast("int")).withColumn("query_block", range_("query_blocks")))
    kinds = ("key", "member", "node", "embedding", "copies", "home", "code", "error", "term", "cells")
    one = F.array(F.struct("cell", F.col("home").alias("list")))
    members = members.withColumn("member", F.lit(True)).withColumn("cells", one).select(*kinds)
    # a vector goes to each task once, whatever the number of its cells there
    asks = keyed(probing.join(grid, ["label", "home"]).withColumn("query_block", F.pmod(salt, F.col("query_blocks")).cast("int")).withColumn("block", range_("blocks")))
    asks = asks.groupBy("node", "key").agg(F.collect_list(F.struct("cell", F.col("home").alias("list"))).alias("cells"))
    queries = placed.drop("probes", "code", "error", "term").join(asks, "node").withColumn("member", F.lit(False))
    queries = queries.withColumn("code", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("float")).withColumn("term", F.lit(None).cast("float")).select(*kinds)
    shared = nodes.sparkSession.sparkContext.broadcast(index)
    return scratch.save(members.unionByName(queries).groupBy("key").applyInArrow(_compare(shared, limit), "node long, other long, links long"))


def near_vectors(vectors: DataFrame, scratch: Scratch, limit: float = 0.93, deviations: float = DEVIATIONS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label).

    Rows link when labels are equal and not null, both have as many components, and cosine >= limit. Vectors that are null,
    zero or hold null or non-finite components link with nothing, nor do rows with a null label or id: their component is
    their own id, and kept is true (null for a null id). Components of floats are compared as they are, others as doubles. Repeated rows and equal vectors of one label link with each other.
    Equal vectors are compared once and count by their number. An empty table gives no rows. deviations: how far lists are
    probed (see the module); with math.inf no link can be lost.
    """
    double = not vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # floats stay as small as they are
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"), F.col("label").cast("string").alias("label"))
    able = finite(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # equal rows meet by a hash of the vector and the vector itself; sums are made before they move
    classes = rows.where(able).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")))
    links, edges = [], []
    for r in nodes.groupBy("dims").count().orderBy("dims").collect():  # one pass for each length of vectors; tables have one as a rule
        found = _links(nodes.where(F.col("dims") == r["dims"]), r["count"], limit, scratch, deviations)
        links.append(found.where("other < 0").select("node", "links"))
        edges.append(found.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    if links:
        every, forest = links[0], edges[0]
        for a, b in zip(links[1:], edges[1:], strict=True):
            every, forest = every.union(a), forest.union(b)
        counted = every.groupBy("node").agg(F.sum("links").alias("links"))
        joined = nodes.select("node", "label", "embedding", "least", "copies").join(counted, "node", "left").join(components(forest, scratch), "node", "left").withColumn("component", F.coalesce("component", "node"))
        joined = scratch.save(joined)
        least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
        known = joined.join(least, "component").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        out = rows.where(able).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    else:
        out = rows.where(able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(rows.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return scratch.save(out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")), keep=True)
