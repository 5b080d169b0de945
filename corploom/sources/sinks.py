"""Sinks: example tables partitioned for pruning, manifests, split texts, hidden-state dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.functions.arrays import indices
from corploom.operators.positions import indexed


def document_records(docs: DataFrame, sents: str = "sents", type_id: int = 0) -> DataFrame:
    """(keys.., inputs, pos_seq, type_id) of documents with arrays of sentence ids: positions start anew with each sentence."""
    pos = F.flatten(F.transform(sents, lambda s: indices(F.size(s))))
    keep = [c for c in docs.columns if c != sents]
    return docs.select(*keep, F.flatten(sents).alias("inputs"), pos.alias("pos_seq"), F.array(F.lit(type_id)).alias("type_id"))


def sentence_records(sents: DataFrame, ids: str = "ids", type_id: int = 0) -> DataFrame:
    keep = [c for c in sents.columns if c != ids]
    return sents.select(*keep, F.col(ids).alias("inputs"), F.array(F.lit(type_id)).alias("type_id"))


def seq2seq_records(pairs: DataFrame, eos: int) -> DataFrame:
    """source + [eos] and [eos] + target."""
    mark = F.array(F.lit(eos).cast("int"))
    return pairs.withColumn("source", F.concat("source", mark)).withColumn("target", F.concat(mark, "target"))


def write_store(rows: DataFrame, path: str, split: str, kind: str, uncased: bool, mode: str = "append") -> None:
    """Parquet partitioned by split, kind and uncased."""
    rows.withColumns({"split": F.lit(split), "kind": F.lit(kind), "uncased": F.lit(uncased)}).write.mode(mode).partitionBy("split", "kind", "uncased").parquet(path)


def write_batches(batches: DataFrame, path: str) -> None:
    """Rows of each batch next to each other and in order, batches in order, by range partitions."""
    batches.repartitionByRange("batch_id").sortWithinPartitions("batch_id", "row").write.mode("overwrite").parquet(path)


def manifest(rows: DataFrame, file: str = "path") -> DataFrame:
    """(filename, num_example) of the files that rows come from."""
    return rows.groupBy(F.regexp_extract(file, "([^/]*)$", 1).alias("filename")).agg(F.count("*").alias("num_example"))


def manifest_json(counts: DataFrame, count: str = "num_example") -> DataFrame:
    """One row {filenames, count} of a manifest's rows: as many names as files."""
    return counts.agg(F.array_sort(F.collect_list("filename")).alias("filenames"), F.sum(count).cast("long").alias(count))


def write_texts(lines: DataFrame, path: str, by: str, order: str, text: str = "line") -> None:
    """A text folder for each value of by, its lines in order."""
    lines.repartition(by).sortWithinPartitions(by, order).select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def dump_parts(store: DataFrame, order: str, parts: int = 10) -> DataFrame:
    """store with part from 1: parts runs of near-equal size in order, the first ones taking one row more."""
    each, more = divmod(store.count(), parts)
    i, big = F.col("_i"), (each + 1) * more
    part = F.when(i < big, F.floor(i / (each + 1))).otherwise(more + F.floor((i - big) / max(each, 1)))
    return indexed(store, order, "_i").withColumn("part", (part + 1).cast("int")).drop("_i")


def write_dump(store: DataFrame, path: str, order: str, parts: int = 10) -> None:
    """The datastore in parts range partitions of order; float vectors and labels stay in one table, so that they can't come apart."""
    store.repartitionByRange(parts, order).sortWithinPartitions(order).write.mode("overwrite").parquet(path)
