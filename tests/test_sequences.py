"""Sequences whose operators work inside one row."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from corploom.functions import arrays
from corploom.functions.rng import numbered_bits
from corploom.plans import base, examples

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbered_bits_are_md5():
    for n in (0, 1, 10, 130):
        prefixes = ["0|x|5|", "0|x|123456789012|", "7|ins|3|0|", "|", "k" * 53 + "|", "k" * 80 + "|", "é|"]
        want = [[int(hashlib.md5(f"{p}{k}".encode()).hexdigest()[:8], 16) for k in range(n)] for p in prefixes]
        assert numbered_bits(prefixes, n).tolist() == want


def test_edits_need_no_window_and_no_join_of_places(spark):
    """A sequence's edits are drawn in its own row: no row a place is sorted, joined or shuffled."""
    plan = _plan(examples.edit_sampled(spark, SF))
    assert "row_number" not in plan and "posexplode" not in plan


def test_scatter_builds_no_map(spark):
    rows = spark.createDataFrame([([3, 0, 7], [30, None, 70]), ([], []), ([9, 1], [90, 10])], "at array<int>, v array<int>")
    out = rows.select(arrays.scatter(F.col("at"), F.col("v"), F.lit(8), -1).alias("x"))
    assert [r["x"] for r in out.collect()] == [[-1, -1, -1, 30, -1, -1, -1, 70], [-1] * 8, [-1, 10, -1, -1, -1, -1, -1, -1]]
    assert "map_from_arrays" not in _plan(out)


def test_hashed_documents_are_hashed_ids(spark):
    from corploom.functions import text as tx

    want = base.table(spark, SF, "documents").select("doc_id", base.hashed_ids(tx.words(F.col("text"))).alias("ids"))
    assert {r["doc_id"]: r["ids"] for r in base.hashed_documents(spark, SF).collect()} == {r["doc_id"]: r["ids"] for r in want.collect()}


def test_chunks_make_no_row_for_each_word(spark):
    from corploom.plans import corpus

    for name in ("regime_batches", "shard_zip_batches"):
        assert "posexplode" not in _plan(corpus.QUERIES[name](spark, SF))


def test_shard_zip_ends_with_the_shortest_shard(spark):
    from corploom.operators.batching import shard_zip

    rows = spark.createDataFrame([(s, k) for s, n in ((0, 3), (1, 2), (2, 4)) for k in range(n)], "shard int, seq_no long")
    assert sorted(tuple(r) for r in shard_zip(rows, 3).select("batch_id", "row_id").collect()) == [(k, s) for k in range(2) for s in range(3)]
    assert shard_zip(rows, 4).count() == 0
