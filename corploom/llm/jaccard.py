"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Every text gives its set of distinct word shingles (64-bit hashes). Equal sets become one node.
2. A fixed-size table counts all shingles of all texts; each node's set is ordered by (count, hash), rare first.
   Two sets with Jaccard >= t share a shingle among the first n - ceil(t n) + 1 of each (the prefix), so joining
   on prefix shingles loses no pair.
3. Pairs that share a prefix shingle pass the length filter, the positional filter (what can still be
   common after the shared shingle) and the suffix filter (the Hamming distance of parity sketches never exceeds
   the sets' symmetric difference; sketches grow with the set), and are then verified on the full sets, once per pair.
4. First each prefix shingle's group is compared with one hub of its own, which is linear in the group; what
   that leaves in different components is then compared exhaustively, so that a group of near copies doesn't
   give all its pairs and yet no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.llm.components import components
from corploom.llm.counts import count_table
from corploom.llm.scratch import Scratch
from corploom.llm.words import document_shingles, flat_shingles, mix, signed

#: Counters of the table that orders shingles; a fixed 8 MB on the driver and in each Python worker.
COUNT_BITS = 20
#: Longs of the parity sketch of a set of at most SKETCHED shingles; one of twice as many has twice as long a sketch.
SKETCH, SKETCHED = 8, 1024
#: Below this many keys a side is sent to all executors (some 100 MB at most); above, Spark shuffles.
BROADCAST_ROWS = 500_000


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what comes out of one stays small too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _sketch(h: np.ndarray) -> list[int]:
    size = 64 * SKETCH
    while size * SKETCHED < len(h) * 64 * SKETCH:
        size *= 2
    bits = np.bincount((mix(h) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(">i8").tolist()


def _signatures(docs: DataFrame, width: int, t: Fraction, table: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, n, fp_a, fp_b, sketch, prefix): the set's size, two sums of hashes that name it, its sketch and its rare-first prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(table, 2**32 - 1).astype(np.uint32))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in _parts(batches):
            sizes, sums, others, sketches, prefixes = [], [], [], [], []
            for _, s in document_shingles(batch.column(1), width):
                n = len(s)
                sizes.append(n)
                sums.append(int(signed(np.atleast_1d(s.sum(dtype=np.uint64)))[0]))
                others.append(int(signed(np.atleast_1d(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))[0]))
                if n:
                    order = np.argsort(counts[_bucket(s)], kind="stable")  # s ascends: ties by hash
                    prefixes.append(signed(s[order[: n - math.ceil(t * n) + 1]]))
                    sketches.append(_sketch(s))
                else:
                    prefixes.append(np.zeros(0, dtype=np.int64))
                    sketches.append([0] * SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(others, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n", "fp_a", "fp_b", "sketch", "prefix"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(sign, "doc_id long, text_hash long, n long, fp_a long, fp_b long, sketch array<long>, prefix array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            n, a, b, blobs = [], [], [], []
            for _, s in document_shingles(batch.column(1), width):
                n.append(len(s))
                a.append(int(signed(np.atleast_1d(s.sum(dtype=np.uint64)))[0]))
                b.append(int(signed(np.atleast_1d(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))[0]))
                blobs.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(blobs, pa.binary())], names=["n", "fp_a", "fp_b", "blob"])

    return docs.mapInArrow(build, "n long, fp_a long, fp_b long, blob binary")


def _need(na: Column, nb: Column, t: Fraction) -> Column:
    """The least intersection with Jaccard >= t of sets of na and nb: ceil(t (na + nb) / (1 + t)) in whole numbers."""
    p, q = t.numerator, t.numerator + t.denominator
    top = (na + nb) * p + (q - 1)
    return ((top - F.pmod(top, F.lit(q))) / q).cast("long")


def _length(x: str, y: str, t: Fraction) -> Column:
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return F.least(nx, ny) * t.denominator >= F.greatest(nx, ny) * t.numerator


def _positional(x: str, y: str, t: Fraction) -> Column:
    """Length and positional filters for a shared prefix shingle at places x.pos and y.pos (from 0)."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))
    return _length(x, y, t) & (left >= _need(nx, ny, t))


def _suffix(x: str, y: str, t: Fraction) -> Column:
    """Suffix filter: sketches that differ in more bits than sets of that similarity can."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    # sets of nearly one size may lie on either side of a doubling: the longer sketch is folded in half
    half = lambda s, n: F.when(F.size(s) > n, F.zip_with(F.slice(s, 1, n), F.slice(s, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(s)
    a, b = F.col(f"{x}.sketch"), F.col(f"{y}.sketch")
    short = F.least(F.size(a), F.size(b))
    differ = F.aggregate(F.zip_with(half(a, short), half(b, short), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    return differ <= nx + ny - 2 * _need(nx, ny, t)


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Those of pairs (a, b) whose full sets have Jaccard >= t."""
    p, q = t.numerator, t.denominator

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                both = np.concatenate((x, y))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(q * common >= p * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("blob").alias("blob_b")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("blob").alias("blob_a")), "a")
    return two.select("a", "b", "blob_a", "blob_b").mapInArrow(check, "a long, b long")


def near_groups(docs: DataFrame, scratch: Scratch, width: int = 5, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, group) for each row of docs; component_id is the least doc_id that links reach, group a number
    of the component (null without shingles) that rows without ids have too, and text_hash is xxhash64 of the text.

    Rows link when the Jaccard similarity of their sets of width-word shingles is at least threshold (a decimal
    string, used exactly). Null, empty and blank texts have no shingles and link with nothing: their component is
    their own id. Repeated rows and equal texts share a component. A null id is never a component of others; a
    row with a null id has the component of its group, or null if nobody in it has an id. Other columns are ignored.
    The result is read from a table of scratch: save it before scratch ends.
    """
    t = Fraction(threshold)
    # Python needs only these two columns, whatever the names of others
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = count_table(texts.select("text"), 1 << COUNT_BITS, lambda batch: (_bucket(h) for h in flat_shingles(batch.column(0), width)))
    signed_docs = scratch.save(_signatures(texts, width, t, table))

    name = ["n", "fp_a", "fp_b"]
    nodes = scratch.save(
        signed_docs.where("n > 0").groupBy(*name).agg(F.min("doc_id").alias("least_id"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    prefixes = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    # the least node by one of three orders: so a group of near copies, which shares many shingles, has three hubs
    third = F.pmod("token", F.lit(3))
    mask = F.when(third == 0, F.lit(0)).when(third == 1, F.lit(2**62 - 1)).otherwise(F.lit(0x2AAAAAAAAAAAAAAA))
    key = F.col("node").bitwiseXOR(mask)
    groups = scratch.save(prefixes.select("token", key.alias("key")).groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("size")).where("size > 1"))
    two = groups.where("size = 2").select(F.col("lo").bitwiseXOR(mask).alias("a"), F.col("hi").bitwiseXOR(mask).alias("b"))
    many = groups.where("size > 2").select("token", F.col("lo").bitwiseXOR(mask).alias("hub"))
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    shared = scratch.save(prefixes.join(many, "token"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Verifies distinct pairs; only texts of rows in pairs are read into sets again."""
        pairs = scratch.save(pairs)
        used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least_id", *name), "node")
        used = scratch.save(used)
        wanted, known = used.select(F.col("least_id").alias("doc_id")).distinct(), used.select("node", *name)
        if used.count() <= BROADCAST_ROWS:
            wanted, known = F.broadcast(wanted), F.broadcast(known)
        around = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
        # a repeated row gives its set again, and its links again, which changes nothing
        sets = scratch.save(_sets(around, width).join(known, name).select("node", "blob"))
        return scratch.save(_verified(pairs, sets, t))

    sketches, lengths = nodes.select("node", "n", "sketch"), nodes.select("node", "n")
    starred = two.union(shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    starred = starred.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    starred = starred.join(lengths.alias("x"), F.col("a") == F.col("x.node")).join(lengths.alias("y"), F.col("b") == F.col("y.node")).where(_length("x", "y", t)).select("a", "b")
    both = starred.join(sketches.alias("x"), F.col("a") == F.col("x.node")).join(sketches.alias("y"), F.col("b") == F.col("y.node"))
    links = linked(both.where(_suffix("x", "y", t)).select("a", "b"))
    first = scratch.save(components(links, scratch))

    # every pair with a hub has been seen; of the others, those that span components are left
    placed = shared.where("node <> hub").join(first, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("hub")
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    open_rows = scratch.save(placed.join(mixed, "token", "left_semi").join(sketches.drop("n"), "node"))
    x, y = open_rows.alias("x"), open_rows.alias("y")
    crossing = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _positional("x", "y", t) & _suffix("x", "y", t))
    more = linked(crossing.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    final = first if more.isEmpty() else scratch.save(components(links.union(more), scratch))

    placed = nodes.select("node", "least_id", *name).join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    members = placed.join(least, "component").select(*name, "component_id", F.col("component").alias("group"))
    out = signed_docs.select("doc_id", "text_hash", *name).join(members, name, "left")
    return scratch.save(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash", "group"), keep=True)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: str = "0.8", **columns: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of near_groups, with tables of its own."""
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        return near_groups(docs, scratch, width, threshold, **columns).select("doc_id", "n_shingles", "component_id")
