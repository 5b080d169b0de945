"""The corpus pipeline: documents pass toxicity, language, near-copy and mixing stages and are packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.llm import langid, mixing, toxicity
from corploom.llm.jaccard import near_groups
from corploom.llm.packing import pack_documents
from corploom.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose toxicity score is below 0.5; labels of sf_dir teach."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in a language that docs themselves declare and teach."""
    with Scratch(spark, "languages") as scratch:
        return langid.keep_known(docs, langid.fit_text(docs), scratch)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs for each group of near copies (five words, Jaccard 0.8): the least by id (none last) and hash of the text.

    A row is told by its id and its text, so one id on several texts stands for several rows, and rows without an id belong to
    groups too. Of rows that repeat both, one stays. Rows without words have no copies and stay.
    """
    with Scratch(spark, "groups") as scratch:
        # ids and hashes alone are kept; texts are read once more when the result is
        rows = near_groups(docs, scratch).where("group IS NOT NULL").groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("times"))
        rows = scratch.save(rows)
        first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))).alias("first")).select("group", "first.i", "first.h")
        named = rows.join(first, "group").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "times", (F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))).alias("stays"))
        named = scratch.save(named, keep=True)
        lost = named.where("NOT stays").select("_id", "_hash")
        if lost.count() <= 1_000_000:  # 16 bytes each; beyond, Spark shuffles
            lost = F.broadcast(lost)
        same = lambda df, keys: df["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (F.xxhash64(df["text"]) == keys["_hash"])
        kept = docs.join(lost, same(docs, lost), "left_anti")
        again = named.where("stays AND times > 1").select("_id", "_hash")
        if not again.isEmpty():
            twice = kept.join(again, same(kept, again), "left_semi")
            one = twice.groupBy("doc_id", F.xxhash64("text").alias("_corploom_same")).agg(F.min_by(F.struct(*docs.columns), F.struct("source", "lang")).alias("_corploom_row")).select("_corploom_row.*")
            kept = kept.join(again, same(kept, again), "left_anti").unionByName(one)
        return kept


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them (0 to 3 times); texts stay where they are read, but for rows that repeat."""
    with Scratch(spark, "mix") as scratch:
        sized = mixing.repeats_apart(scratch.save(mixing.sizes(docs)), scratch)
        plan = mixing.plan(sized, scratch, keep=True)
        numbered = mixing.numbered(docs, "_corploom_hash")
        joined, copies = mixing.with_copies(numbered, plan, numbered["source"].cast("string"), numbered["_corploom_hash"])
        return joined.select(F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_corploom_copy"), *[numbered[c] for c in docs.columns]).drop("_corploom_copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs' pieces in sequences of at most 2048 tokens."""
    with Scratch(spark, "pack") as scratch:
        return pack_documents(docs, scratch, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_copies", one_of_each_group), ("mixing", mix_sources), ("packing", pack)]

#: Two stages learn from the rows and one runs a tokenizer; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES:
            docs = scratch.save(stage(spark, docs, sf_dir), keep=name == STAGES[-1][0])
    return docs
