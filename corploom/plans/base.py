"""Tables that several queries start from."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.functions import text as tx
from corploom.operators import positions, vocab, windows
from corploom.operators.tables import written

EOS = "<eos>"
SPECIALS = ["<unk>", EOS]


#: Bytes of a table for each core below which its rows are dealt out anew: a small file is often one row group, which one task reads.
SMALL_SHARE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its rows on all cores. What has more than SMALL_SHARE bytes a core stays where it is read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if 1 << 20 < size < SMALL_SHARE * cores else df


def lines_with_eos(text: Column) -> Column:
    """All words of a text's lines, each line that has any closed by the end mark."""
    each = F.filter(F.transform(F.split(text, "\n"), tx.words), lambda w: F.size(w) > 0)
    return F.flatten(F.transform(each, lambda w: F.concat(w, F.array(F.lit(EOS)))))


def token_stream(spark: SparkSession, sf_dir: str, eos: bool = False) -> DataFrame:
    """(gpos, token) of all documents in order of doc_id."""
    docs = table(spark, sf_dir, "documents")
    return positions.stream_positions(docs.select("doc_id", (lines_with_eos(F.col("text")) if eos else tx.words(F.col("text"))).alias("w")), "doc_id", "w", "token")


def documents_vocab(spark: SparkSession, sf_dir: str, max_size: int = 5000) -> DataFrame:
    """The commonest words of all documents after two marks. A word's first place is its document and its place in it: no global positions are needed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.words(F.col("text"))).alias("p", "token"))
    counts = docs.groupBy("token").agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "p")).alias("first_pos"))
    return vocab.build_vocab(counts, SPECIALS, max_size)


def encoded_stream(spark: SparkSession, sf_dir: str, max_size: int = 5000) -> DataFrame:
    """(gpos, token_id)."""
    return vocab.encode(token_stream(spark, sf_dir), documents_vocab(spark, sf_dir, max_size), 0, max_size + len(SPECIALS)).select("gpos", "token_id")


def hashed_ids(words: Column, size: int = 1000, first: int = 10) -> Column:
    """Ids of words by md5: a stand-in vocabulary of size ids from first."""
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint") % size + first).cast("int"))


class _HashedIds(dict):
    """Ids of words by hashed_ids; the first words that a task meets are remembered."""

    def __missing__(self, word: str) -> int:
        found = int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % 1000 + 10
        if len(self) < 500_000:
            self[word] = found
        return found


def hashed_documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, more.., ids) of all documents, ids their words by hashed_ids (none for null texts): read, split and hashed once, a
    word that comes again is looked up."""
    rows = table(spark, sf_dir, "documents").select("doc_id", *more, "text")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _HashedIds()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.fromiter(map(known.__getitem__, (text or "").split()), dtype=np.int32) for text in part.column(part.num_columns - 1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=["doc_id", *more, "ids"])

    return written(rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *more)) + ", ids array<int>"))


def encoded_documents(spark: SparkSession, sf_dir: str, max_size: int = 5000) -> DataFrame:
    """(doc_id, ids, offset): documents as ids, with their places in the stream of all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    return windows.encoded_arrays(windows.with_offsets(docs, "doc_id", "w"), "w", documents_vocab(spark, sf_dir, max_size), 0)


def n_tokens(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").agg(F.sum(F.size(tx.words(F.col("text"))))).first()[0] or 0


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: SQL twins of the above, to begin a WITH clause.
SQL_WORDS = r"""words AS (SELECT doc_id, source, lang, w AS token, p FROM (
  SELECT doc_id, source, lang, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (
    SELECT doc_id, source, lang, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)))"""
SQL_STREAM = SQL_WORDS + ", stream AS (SELECT row_number() OVER (ORDER BY doc_id, p) - 1 AS gpos, token FROM words)"
SQL_VOCAB = """counts AS (SELECT token, count(*) AS cnt, min(gpos) AS first_pos FROM stream GROUP BY token),
top AS (SELECT * FROM counts ORDER BY cnt DESC, first_pos LIMIT {size}),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, first_pos) + 1 AS INTEGER) AS token_id, cnt FROM top WHERE token NOT IN ('<unk>', '<eos>')
  UNION ALL SELECT s, i, coalesce((SELECT cnt FROM counts WHERE token = s), 0) FROM (VALUES ('<unk>', 0), ('<eos>', 1)) v(s, i))"""
SQL_ENCODED = SQL_STREAM + ", " + SQL_VOCAB + ", ids AS (SELECT gpos, coalesce(token_id, 0) AS token_id FROM stream LEFT JOIN vocab USING (token))"


def sql_ids(size: int = 5000) -> str:
    return SQL_ENCODED.replace("{size}", str(size))


#: (seq_id, pos, token_id): hashed ids of each document's first lines, as in hashed_ids().
SQL_HASHED = SQL_WORDS + ", h AS (SELECT doc_id, p, CAST(('0x' || substr(md5(token), 1, 7))::BIGINT % 1000 + 10 AS INTEGER) AS token_id FROM words)"
