"""Source divergence audit by a sorted stream of term counts.

1. Each task counts the terms of its documents: a row (lang, term, source, first document, documents, occurrences) for the documents
   that it read, so that a common term moves once a task and not once a document.
2. Rows are dealt out by (lang, term) and sorted by (lang, term, source, document), behind a hash of the first two. One pass over the runs sums documents and
   occurrences, drops terms in too few documents of the language and writes a row for each kept term.
3. Each language's sources and totals go in front of its terms in the sort order. A second pass turns the counts of each block of
   terms into shares, adds up what a pair of sources differs by, and emits partial pairs and single terms.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.llm.scratch import Scratch

#: Terms of one task that are counted before their rows go out, and rows of a batch.
MOST_TERMS, BATCH_ROWS = 1_000_000, 20_000
#: Numbers in the table of a block of terms and pairs, and in the sums of pairs that a task keeps.
BLOCK_CELLS, MOST_SUMS = 1 << 21, 1 << 22
UNIT = 1_000_000_000

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, term string, source string, document long, documents long, n long"
_PARTS = "lang string, source string, part string, item string, value long"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_TERM).split()


def term_counts(docs: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(lang, term, source, document, documents, n) of docs (doc_id, text, lang, source): for the documents of one task that have the term,
    the least id of the first ones, how many they are and how often it stands in them. Several rows a task where its terms are many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        first, size = None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (total, within) in held.items():
                found = list(total)
                for at in range(0, len(found), BATCH_ROWS):
                    some = found[at : at + BATCH_ROWS]
                    k = len(some)
                    columns = [pa.repeat(pa.scalar(lang, pa.string()), k), pa.array(some, pa.binary()).cast(pa.string()), pa.repeat(pa.scalar(source, pa.string()), k), pa.repeat(pa.scalar(first, pa.int64()), k)]
                    columns += [pa.array([x[w] for w in some], pa.int64()) for x in (within, total)]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _COUNTS.split(", ")])
            held.clear()

        for batch in batches:
            for doc, text, lang, source in zip(*(batch.column(k) for k in range(4)), strict=True):
                doc, key = doc.as_py(), (lang.as_py(), source.as_py())
                if doc is not None and (first is None or doc < first):
                    first = doc
                total, within = held.setdefault(key, (Counter(), Counter()))
                before = len(total)
                found = terms(text.as_py())
                total.update(found)
                within.update(set(found))
                size += len(total) - before
                if size > most:
                    yield from flush()
                    first, size = None, 0
        yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return rows.mapInArrow(count, _COUNTS)


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, sources, ns) of the terms in at least so many documents of a language: the sources that have the term, ascending, and its
    occurrences in each. Runs of rows sorted by (lang, term, source, document) are read once; a run's rows are never held, only a sum a source."""
    schema = "lang string, term string, sources array<string>, ns array<bigint>"
    names = ["lang", "term", "source", "documents", "n"]

    def changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
        """Where one of the columns differs from the row before, the first row included."""
        out = np.zeros(len(rows), dtype=bool)
        out[:1] = True
        for c in columns if len(rows) > 1 else ():
            x = rows[c].combine_chunks()
            out[1:] |= np.asarray(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)))
        return out

    def summed(rows: pa.Table) -> pa.Table:
        """A row for each run of (lang, term, source)."""
        starts = np.flatnonzero(changes(rows, names[:3]))
        sums = [pa.array(np.add.reduceat(np.asarray(rows[c]), starts) if len(starts) else np.zeros(0, dtype=np.int64)) for c in names[3:]]
        return pa.Table.from_arrays([rows[c].take(pa.array(starts)) for c in names[:3]] + sums, names=names)

    def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole runs of (lang, term), as summed() gives them."""
        starts = np.flatnonzero(changes(rows, names[:2]))
        if not len(starts):
            return
        enough = np.add.reduceat(np.asarray(rows["documents"]), starts) >= least
        sizes = np.diff(np.append(starts, len(rows)))
        some = rows.filter(pa.array(np.repeat(enough, sizes)))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[enough]))), pa.int32())
        heads = rows.take(pa.array(starts[enough]))
        lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays(some[c].chunks) if some[c].num_chunks else pa.array([], t)) for c, t in (("source", pa.string()), ("n", pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(heads[c].chunks) if heads[c].num_chunks else pa.array([], pa.string()) for c in names[:2]] + lists, names=["lang", "term", "sources", "ns"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last run, which may go on: a row a source
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(names)
            rows = summed(rows if held is None else pa.concat_tables([held, rows]))
            if len(rows):
                last = int(np.flatnonzero(changes(rows, names[:2]))[-1])
                yield from kept(rows.slice(0, last))
                held = rows.slice(last)
        if held is not None:
            yield from kept(held)

    # the hash comes first so that sorting compares numbers, not texts, wherever they differ
    return counts.repartition("lang", "term").sortWithinPartitions(F.xxhash64("lang", "term"), "lang", "term", "source", "document").mapInArrow(scan, schema)


def _shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT (n + 1) / whole), by three digits at a time, so that numbers up to 9 * 10^15 don't overflow."""
    left, out = n + 1, np.zeros(np.broadcast_shapes(n.shape, whole.shape), dtype=np.int64)
    out += left // whole
    left = left % whole
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // whole
        left = left % whole
    return out + 1


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _parts(stream: DataFrame, most_sums: int = MOST_SUMS) -> DataFrame:
    """Partial pairs and single terms of a stream (lang, bucket, term, sources, ns, kept): the row without a term comes first in each language
    and bucket and has all sources, their totals and the number of kept terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, names, place, totals, own, sums, waiting = None, [], {}, None, None, None, []

        def pairs(at: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows of the sums table of sources at, at + 1, .. with all sources."""
            for k, row in enumerate(table):
                some = [j for j in range(len(names)) if j != at + k]
                for b in range(0, len(some), BATCH_ROWS):
                    part = some[b : b + BATCH_ROWS]
                    yield _batch([[lang] * len(part), [names[at + k]] * len(part), ["pair"] * len(part), [names[j] for j in part], row[part].tolist()], _PARTS)

        def block() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            width = len(names)
            n = np.zeros((len(waiting), width), dtype=np.int64)
            for r, (_, sources, ns) in enumerate(waiting):
                n[r, [place[x] for x in sources]] = ns
            p, q = _shares(n, totals), _shares(n.sum(axis=1, keepdims=True), own)
            value = _excess(p, q)
            r, c = np.nonzero((n > 0) & (p > q))
            for at in range(0, len(r), BATCH_ROWS):
                x, y = r[at : at + BATCH_ROWS], c[at : at + BATCH_ROWS]
                yield _batch([[lang] * len(x), [names[k] for k in y], ["term"] * len(x), [waiting[k][0] for k in x], value[x, y].tolist()], _PARTS)
            step = max(1, BLOCK_CELLS // (len(waiting) * width))
            for at in range(0, width, step):
                table = _excess(p[:, at : at + step, None], p[:, None, :]).sum(axis=0)
                if sums is None:
                    yield from pairs(at, table)
                else:
                    sums[at : at + step] += table
            waiting.clear()

        def close() -> Iterator[pa.RecordBatch]:
            yield from block()
            if sums is not None:
                yield from pairs(0, sums)

        for batch in batches:
            for now, bucket, term, sources, ns, kept in zip(*(batch.column(c).to_pylist() for c in ("lang", "bucket", "term", "sources", "ns", "kept")), strict=True):
                if term is None:
                    yield from close()
                    lang, names, place = now, sources, {x: k for k, x in enumerate(sources)}
                    totals, own = np.array(ns, dtype=np.int64) + kept, np.array([[sum(ns) + kept]], dtype=np.int64)
                    sums = np.zeros((len(names), len(names)), dtype=np.int64) if len(names) ** 2 <= most_sums else None
                    limit = max(1, min(4096, BLOCK_CELLS // max(1, len(names) ** 2)))
                    if sums is None and bucket == 0:  # a language may have no terms
                        for at in range(len(names)):
                            yield from pairs(at, np.zeros((1, len(names)), dtype=np.int64))
                else:
                    waiting.append((term, sources, ns))
                    if len(waiting) >= limit:
                        yield from block()
        yield from close()

    return stream.select("lang", "bucket", "term", "sources", "ns", "kept").mapInArrow(scan, _PARTS)


def _rank(*keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("value").desc(), "item"))


def divergence(docs: DataFrame, scratch: Scratch, least: int = 3, most_terms: int = 200, most_sums: int = MOST_SUMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from every other source of it (part pair, item the other
    source) and which terms it has more of than the language (part term, item the term, ranks to most_terms).

    docs (doc_id, text, lang, source): every row is a document, repeated rows too; null text, lang and source are empty strings; an empty
    text has no terms, but its language and source occur. Terms in fewer than least documents of a language don't count. Values are equal
    for equal counts, ranks then go by the item's bytes. No documents give no rows; other columns and ids don't matter.
    """
    spark = docs.sparkSession
    kept = scratch.save(kept_terms(term_counts(docs), least))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    used = kept.select("lang", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("ns").alias("n"))).alias("z")).groupBy("lang", "z.source").agg(F.sum("z.n").alias("n"))
    groups = every.join(used, ["lang", "source"], "left").na.fill(0, ["n"])
    # a row for each language, as wide as its pairs of sources are many in each source's result
    listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("z")).select("lang", F.col("z.source").alias("sources"), F.col("z.n").alias("ns"))
    heads = listed.join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").na.fill(0, ["kept"])
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    front = scratch.save(heads.select("lang", F.lit(None).cast("string").alias("term"), "sources", "ns", "kept")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    rows = kept.select("lang", "term", "sources", "ns", F.lit(0).cast("long").alias("kept"), F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
    stream = front.unionByName(rows).repartition(buckets, "lang", "bucket").sortWithinPartitions("lang", "bucket", F.col("term").asc_nulls_first())
    parts = scratch.save(_parts(stream, most_sums), keep=True)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", _rank("lang", "source"))
    single = parts.where("part = 'term'").withColumn("rank", _rank("lang", "source")).where(F.col("rank") <= most_terms)
    return pairs.unionByName(single).select("lang", "source", "part", "item", "value", "rank")
