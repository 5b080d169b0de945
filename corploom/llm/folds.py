"""The fold rule shared by everything that learns from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5: 0 is held out. A null id counts as the empty text, whose fold is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def labelled(labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, label, fold) of learnable rows: fold not 0, label and id not null, one row an id (the largest label).

    If there are more than most, a sample of about most by a hash of the id. most is the documented bound of every
    classifier here: what is learnt from a bounded sample of labelled rows doesn't grow with the corpus.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0").groupBy("doc_id", "fold").agg(F.max("label").alias("label"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < round(1_000_000 * most / n))
    return rows
