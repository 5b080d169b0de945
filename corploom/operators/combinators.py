"""Dataset combinators over explicit order columns: shuffles, repeats, mixes, zips, folds."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.functions.rng import keyed_bits, keyed_uniform


def shuffle_key(df: DataFrame, key: list[str], seed: int = 0, epoch: Column | None = None) -> DataFrame:
    """df with shuffle_key, which any sort or range partitioning can use: a full shuffle that doesn't depend on partitions."""
    return df.withColumn("shuffle_key", keyed_bits(seed, "shuffle", epoch if epoch is not None else F.lit(0), *[F.col(k) for k in key]))


def shuffled(df: DataFrame, key: list[str], seed: int = 0, buffer_size: int | None = None) -> DataFrame:
    """df in keyed random order, ties by key. buffer_size is accepted and has no effect: the order is always of all rows."""
    return shuffle_key(df, key, seed).orderBy("shuffle_key", *key).drop("shuffle_key")


def buffered_shuffle(df: DataFrame, index: str, buffer_size: int, key: list[str], seed: int = 0, epoch: Column | None = None) -> DataFrame:
    """df with slot, its contiguous index (from 0) after a shuffle that moves no row by buffer_size places or more.

    Two keyed permutations of blocks of half a buffer, the second one's blocks beginning in the middle of the first one's: each block is
    a group of its own, so that there is no sort of all rows, and rows still pass from block to block. buffer_size below 4 moves nothing.
    """
    half = buffer_size // 2
    if half < 2:
        return df.withColumn("slot", F.col(index).cast("long"))
    draw = lambda tag: keyed_bits(seed, tag, epoch if epoch is not None else F.lit(0), *[F.col(k) for k in key])

    def permuted(rows: DataFrame, place: str, shift: int, tag: str) -> DataFrame:
        block = F.floor((F.col(place) + shift) / half).cast("long")
        rows = rows.withColumn("_block", block).withColumn("_draw", draw(tag))
        rank = F.row_number().over(Window.partitionBy("_block").orderBy("_draw", place))
        # the first block of a shifted pass begins before the first row
        return rows.withColumn("_at", (F.greatest(F.col("_block") * half - shift, F.lit(0)) + rank - 1).cast("long")).drop("_block", "_draw")

    once = permuted(df, index, 0, "buffer1").withColumnRenamed("_at", "_once")
    return permuted(once, "_once", half // 2, "buffer2").withColumnRenamed("_at", "slot").drop("_once")


def repeat(df: DataFrame, epochs: int) -> DataFrame:
    """df's rows once for each epoch; the order within is the same in all."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def take(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows by order; -1 takes all."""
    return df if n < 0 else df.orderBy(*order).limit(n)


def shard(df: DataFrame, index: str, n: int, i: int) -> DataFrame:
    return df.where(F.col(index) % n == i)


def interleaved_task(df: DataFrame, index: str, n: int, task: int) -> DataFrame:
    """Files (index from 1) of one of n tasks."""
    return df.where((F.col(index) - 1) % n == task)


def host_split(df: DataFrame, index: str, n_files: int, hosts: int, host: int) -> DataFrame:
    """A host's share of files, or all of them if there are fewer files than hosts."""
    return shard(df, index, hosts, host) if n_files >= hosts else df


def zipped(streams: list[DataFrame], index: str) -> DataFrame:
    """Rows of equal index of all streams, side by side; columns get the stream's number. Ends with the shortest."""
    out = None
    for k, s in enumerate(streams):
        own = s.select(index, *[F.col(c).alias(f"{c}_{k}") for c in s.columns if c != index])
        out = own if out is None else out.join(own, index)
    return out


def sample_from(streams: list[DataFrame], index: str, slots: int, seed: int = 0, weights: list[float] | None = None) -> DataFrame:
    """slots rows, each the next of a stream drawn by weight (columns slot, stream and the stream's); a stream that has run out leaves its slots empty."""
    spark = streams[0].sparkSession
    total = sum(weights or [1.0] * len(streams))
    edges, run = [], 0.0
    for w in weights or [1.0] * len(streams):
        run += w / total
        edges.append(run)
    u = keyed_uniform(seed, "mix", F.col("slot"))
    choice = F.lit(len(streams) - 1)
    for k in range(len(streams) - 2, -1, -1):
        choice = F.when(u < edges[k], F.lit(k)).otherwise(choice)
    drawn = spark.range(slots).withColumnRenamed("id", "slot").withColumn("stream", choice)
    drawn = drawn.withColumn(index, F.row_number().over(Window.partitionBy("stream").orderBy("slot")).cast("long") - 1)
    pooled = None
    for k, s in enumerate(streams):
        own = s.withColumn(index, F.col(index).cast("long")).withColumn("stream", F.lit(k))
        pooled = own if pooled is None else pooled.unionByName(own)
    return drawn.join(pooled, ["stream", index])


def concatenate(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def unbatch(df: DataFrame, arrays: list[str], keys: list[str]) -> DataFrame:
    """A row for each place of the arrays, which have equal lengths."""
    return df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_z")).select(*keys, "pos", *[F.col(f"_z.{a}").alias(a) for a in arrays])


def scan(df: DataFrame, key: str, order: str, initial: Callable[[], object], step: Callable[[object, dict], tuple[object, list[dict]]], schema: str, finish: Callable[[object], list[dict]] | None = None) -> DataFrame:
    """A stateful fold of each group in order; step gives the next state and rows to emit, finish the last ones. A group is one task's work."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state, out = initial(), []
        for row in group.sort_values(order).to_dict("records"):
            state, rows = step(state, row)
            out += rows
        if finish:
            out += finish(state)
        return pd.DataFrame(out, columns=[x.strip().split()[0] for x in schema.split(",")])

    return df.groupBy(key).applyInPandas(run, schema)


def passes(df: DataFrame, n: int) -> DataFrame:
    """Rows of passes below n."""
    return df.where(F.col("pass_id") < n)


def pass_order(files: DataFrame, path: str, n_pass: int, task: int = 0) -> DataFrame:
    """(pass_id, path, rank): files in a keyed order of their own for each pass of a task; pass 0 keeps theirs."""
    w = Window.partitionBy("pass_id").orderBy(F.when(F.col("pass_id") == 0, F.lit(0)).otherwise(keyed_bits(0, "pass", F.lit(100 * task) + F.col("pass_id"), F.col(path))), path)
    return files.select(path).withColumn("pass_id", F.explode(F.sequence(F.lit(0), F.lit(n_pass - 1)))).withColumn("rank", F.row_number().over(w) - 1)


def regime(docs: DataFrame, kind: str, bsz: int, seq_len: int, seed: int = 0) -> DataFrame:
    """Batches of sequences from docs (doc_id, token_ids): (batch_id, row_id, token_ids).

    doc: documents are dealt into bsz streams and row i of every batch goes on where row i of the last one stopped.
    semidoc: order holds inside a sequence, sequences are then shuffled. sent: units are shuffled first.
    """
    from corploom.operators import windows
    from corploom.operators.batching import shard_zip
    from corploom.operators.positions import indexed
    from corploom.operators.tables import written

    order = keyed_bits(seed, kind, F.col("doc_id")) if kind == "sent" else F.col("doc_id").cast("long")
    lane = F.pmod(keyed_bits(seed, "lane", F.col("doc_id")), F.lit(bsz if kind == "doc" else 1)).cast("int")
    rows = docs.select(F.col("doc_id").alias("_tie"), "token_ids", lane.alias("shard"), order.alias("_o"))
    placed = windows.with_offsets(rows, "_o", "token_ids", ("shard",), "_tie")
    chunks = written(windows.chunks(placed, "token_ids", seq_len, by=("shard",)).withColumnRenamed("ids", "token_ids"))
    if kind == "doc":
        return shard_zip(chunks, bsz).select("batch_id", "row_id", "token_ids")
    # numbers alone are put in order; whole batches are those before the last incomplete one
    total = chunks.count()
    keys = indexed(chunks.select("seq_no", keyed_bits(seed, "sequence", F.col("seq_no")).alias("_k")), "_k", "_i", "seq_no", most=total)
    keys = keys.where(F.col("_i") < total // bsz * bsz).select("seq_no", "_i")
    keys = F.broadcast(keys) if total <= windows.BROADCAST_OFFSETS else keys.hint("shuffle_hash")
    return chunks.join(keys, "seq_no").select(F.floor(F.col("_i") / bsz).cast("long").alias("batch_id"), (F.col("_i") % bsz).cast("int").alias("row_id"), "token_ids")
