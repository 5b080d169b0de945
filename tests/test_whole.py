"""Queries handle every row and token of their tables, without a prefix or a sample of them."""

import os

import numpy as np

from corploom.functions import text as tx
from corploom.operators import renorm
from corploom.plans import corpus, evaluation, examples
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_sequences_hold_every_word(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").select(F.sum(F.size(tx.words(F.col("text")))).alias("n")).first()["n"]
    got = examples.sequences(spark, SF).orderBy("seq_id").collect()
    assert [r["seq_id"] for r in got] == list(range(-(-n // examples.WORDS))) and all(len(r["token_ids"]) == examples.L for r in got)
    assert sum(x != examples.EOS for r in got for x in r["token_ids"]) == n  # hashed ids begin at 10
    for name in ("permutation_lm", "sampled_spans", "span_mask_topped_up", "edit_sampled", "edit_span_sampled", "edit_noise", "mass_decoder", "sentinel_corruption", "array_functions"):
        assert examples.QUERIES[name](spark, SF).select("seq_id").distinct().count() == len(got), name


def test_renormalisation_of_every_piece(spark, tmp_path):
    texts = [(1, "to be or not to be"), (2, "<eos> " + " ".join(f"w{k}{'x' * (k % 5)}" for k in range(40))), (3, " "), (4, "a")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d, q = str(tmp_path), evaluation.QUERIES
    words, stream = evaluation._words(spark, d), evaluation._candidates(spark, d)[0].select("b", "t", "input", "target").cache()
    assert words.count() == 46 and {r["b"]: r["n"] for r in stream.groupBy("b").agg(F.count("*").alias("n")).collect()} == {i: sum(len(w) % 4 + 1 for w in t.split()) for i, t in texts if t.split()}
    by_row = renorm.allowed_next(stream, words, renorm.flags(words)).cache()
    key = lambda df: {(r["b"], r["t"]): tuple(r[2:]) for r in df.collect()}
    want = key(by_row.where("any_token = 0").groupBy("b", "t").agg(F.count("*"), F.sum("next_token")))
    assert key(q["allowed_next"](spark, d)) == want and len(want) == stream.count()
    logits = stream.select("b", "t", F.explode(F.sequence(F.lit(0), F.lit(359))).alias("token_id")).withColumn("logit", F.pmod(F.col("b") * 7919 + F.col("t") * 104729 + F.col("token_id").cast("long") * 1299709, F.lit(1000)) * F.lit(0.003))
    nll = key(renorm.renormalised_nll(logits, stream.where("target IS NOT NULL").select("b", "t", "target"), by_row).withColumn("nll", F.round("nll", 6)))
    got = key(q["renorm_nll"](spark, d))
    assert got.keys() == nll.keys() and len(got) == stream.where("target IS NOT NULL").count() and max(t for _, t in got) > 20
    assert all(abs(got[k][0] - nll[k][0]) < 2e-6 for k in got)
    assert q["allowed_next_by_end"](spark, d).select("b", "t").distinct().count() == stream.count()


def test_all_vectors_are_scored(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = evaluation.QUERIES["dot_products"](spark, SF).orderBy("query_id", "rank").collect()
    queries = [k for k, r in enumerate(rows) if r["vec_id"] % 100 == 0]
    want = [(rows[q]["vec_id"], rows[k]["vec_id"]) for q in queries for k in np.argsort(-(x @ x[q]), kind="stable")[:32]]
    assert [(r["query_id"], r["vec_id"]) for r in got] == want
    assert evaluation.QUERIES["binary_loss"](spark, SF).count() == 10 * len(rows)


def test_every_vector_enters_the_average(spark, tmp_path):
    rows = [(i, [float(i)], 0) for i in range(1000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["var_name"]: r["value"] for r in evaluation.QUERIES["ckpt_average"](spark, str(tmp_path)).collect()}
    assert got.keys() == {"w1", "w2", "w3", "w4"}
    for k in range(1, 5):
        of = [i for i in range(1000) if i % 8 >= 3 and i % 40 >= 8 and i // 8 % 5 == k]
        assert abs(got[f"w{k}"] - sum(of) / len(of)) < 1e-5


def test_padded_rows_hold_whole_texts(spark):
    got = {}
    for r in corpus.QUERIES["padded_batch"](spark, SF).orderBy("doc_id", "row_id").collect():
        row = r["padded"].split(" ")
        assert len(row) == 50
        got.setdefault(r["doc_id"], []).extend(x for x in row if x != "<pad>")
    assert got == {r["doc_id"]: list(r["w"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", tx.words(F.col("text")).alias("w")).collect()}
