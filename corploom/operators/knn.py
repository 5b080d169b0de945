"""Nearest-neighbour retrieval over a datastore (vec_id, embedding, label) and mixing with a model's distribution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Datastore rows that a task scores against a block of queries at a time, and queries in a block.
BLOCK_ROWS, QUERY_ROWS = 16384, 1024


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def signed_root(d: Column) -> Column:
    return F.signum(d) * F.sqrt(F.abs(d))


def mips_augment(store: DataFrame) -> DataFrame:
    """store with one component more, sqrt(max norm^2 - norm^2): the largest dot product becomes the least distance (queries get a 0)."""
    normed = store.withColumn("_n", dot(F.col("embedding"), F.col("embedding")))
    top = normed.agg(F.max("_n").alias("_max"))
    out = normed.crossJoin(F.broadcast(top))  # one row
    return out.withColumn("embedding", F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.sqrt(F.greatest(F.col("_max") - F.col("_n"), F.lit(0.0)))))).drop("_n", "_max")


def search(queries: DataFrame, store: DataFrame, k: int = 256, metric: str = "l2") -> DataFrame:
    """(query_id, rank, vec_id, label, distance): exact nearest rows of store of each query (query_id, embedding), ties to smaller vec_id.

    Both sides are dealt into blocks; each pair of blocks is one matrix product and keeps k a query, so that no more than k rows a
    query and block move. metric: l2, or dot for signed roots of negative products.
    """
    n, m = store.count(), queries.count()
    blocks, sets = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(m / QUERY_ROWS))
    x = store.select("vec_id", "label", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("qset"))
    q = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int").alias("qset"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return _ranked(_block_nearest(x, q, ["qset", "block"], k, metric), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "label", "distance")


def _block_nearest(x: DataFrame, q: DataFrame, keys: list[str], k: int, metric: str = "l2") -> DataFrame:
    """(query_id, vec_id, label, distance): of each block of rows (keys.., vec_id, label, embedding) the k nearest to each query (keys.., query_id, embedding) of the block, by a matrix product."""
    kind = dict(x.dtypes)["label"]
    x, q = (df.withColumn("embedding", F.col("embedding").cast("array<double>")) for df in (x, q))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "label", "distance"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names}).astype({"query_id": "int64", "vec_id": "int64", "distance": "float64"})
        left = left.sort_values("vec_id", ignore_index=True)
        a, b = np.stack(right["embedding"]), np.stack(left["embedding"])
        query, near, far = [], [], []
        for i in range(0, len(a), 128):
            part = a[i : i + 128]
            rough = (b * b).sum(axis=1) - 2 * part @ b.T if metric == "l2" else -part @ b.T
            r, c = np.nonzero(np.ones(rough.shape, dtype=bool))
            if len(b) > k:  # by products first, then exactly for those that may be among the k
                limit = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
                r, c = np.nonzero(rough <= limit + 1e-9 * (1 + np.abs(limit)))
            exact = rough[r, c]
            exact = np.sign(exact) * np.sqrt(np.abs(exact))
            if metric == "l2":
                exact = np.concatenate([np.sqrt(((b[c[j : j + 8192]] - part[r[j : j + 8192]]) ** 2).sum(axis=1)) for j in range(0, len(r), 8192)])
            order = np.lexsort((c, exact, r))
            r, c, exact = r[order], c[order], exact[order]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            query.append(i + r[best])
            near.append(c[best])
            far.append(exact[best])
        near = np.concatenate(near)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[np.concatenate(query)], "vec_id": left["vec_id"].to_numpy()[near], "label": left["label"].to_numpy()[near], "distance": np.concatenate(far)})

    return x.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(run, f"query_id long, vec_id long, label {kind}, distance double")


def build_ivf(store: DataFrame, lists: int | None = None, sample: int = 50_000, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """(store with list_id, centroids): coarse centroids from a bounded sample, 10 sqrt(n) of them unless told; write the table partitioned by list_id."""
    n = store.count()
    lists = lists or max(1, int(10 * math.sqrt(n)))
    part = store.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < min(1_000_000, round(1.05e6 * sample / max(1, n))))
    x = np.array([r["embedding"] for r in part.select("embedding").limit(2 * sample).toLocalIterator()], dtype=np.float64)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(5):
        own = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        for j in np.unique(own):
            c[j] = x[own == j].mean(axis=0)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        y = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(((c * c).sum(axis=1) - 2 * y @ c.T).argmin(axis=1))

    return store.withColumn("list_id", place("embedding")), c


def search_ivf(queries: DataFrame, indexed: DataFrame, centroids: np.ndarray, k: int = 256, nprobe: int = 32) -> DataFrame:
    """As search(), over the nprobe lists nearest to each query only. A list's rows and the queries that probe it meet in blocks of a bounded size, each
    block is one matrix product and keeps k rows a query: no row is made for a pair."""
    @F.pandas_udf("array<int>")
    def probes(v: pd.Series) -> pd.Series:
        y = np.stack(v.to_numpy()).astype(np.float64)
        far = (centroids * centroids).sum(axis=1) - 2 * y @ centroids.T
        return pd.Series(list(np.argsort(far, axis=1)[:, :nprobe].astype(np.int32)))

    n, m = indexed.count(), queries.count()
    # lists differ in size: blocks are cut for those of four times the mean
    blocks = max(1, math.ceil(4 * n / len(centroids) / BLOCK_ROWS))
    sets = max(1, math.ceil(m * min(1.0, 4 * nprobe / len(centroids)) / QUERY_ROWS))
    number = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    x = indexed.select("list_id", "vec_id", "label", "embedding", number("vec_id", blocks).alias("block"), every(sets).alias("qset"))
    q = queries.select("query_id", "embedding", number("query_id", sets).alias("qset"), F.explode(probes("embedding")).alias("list_id")).select("*", every(blocks).alias("block"))
    return _ranked(_block_nearest(x, q, ["list_id", "block", "qset"], k), k)


def distribution(neighbours: DataFrame) -> DataFrame:
    """(query_id, label, p_knn): exp(-distance) of neighbours summed by label and normalised, stabilised by each query's least distance."""
    w = Window.partitionBy("query_id")
    weighed = neighbours.withColumn("_w", F.exp(F.min("distance").over(w) - F.col("distance")))
    summed = weighed.groupBy("query_id", "label").agg(F.sum("_w").alias("_w"))
    return summed.select("query_id", "label", (F.col("_w") / F.sum("_w").over(w)).alias("p_knn"))


def interpolate(p_knn: DataFrame, p_model: DataFrame, lam: float = 0.1) -> DataFrame:
    """(query_id, label, p): lam * p_knn + (1 - lam) * p_model, what one side lacks is 0; lam <= 0 is the model alone."""
    if lam <= 0:
        return p_model.withColumnRenamed("p_model", "p")
    joined = p_knn.join(p_model, ["query_id", "label"], "full")
    return joined.select("query_id", "label", (F.coalesce("p_knn", F.lit(0.0)) * lam + F.coalesce("p_model", F.lit(0.0)) * (1 - lam)).alias("p"))
