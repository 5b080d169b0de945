import math

from corploom.functions import arrays
from corploom.operators import edits
from corploom.plans import examples, pipelines
from corploom.sources.text import CORPORA
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "line_no long, line string")


def test_lm_corpus(spark):
    splits = {"train": lines(spark, ["b a", "a c"]), "valid": lines(spark, ["c d"]), "test": lines(spark, ["a"])}
    c = pipelines.lm_corpus(splits, CORPORA["wt2"])
    ids = {r["token"]: r["token_id"] for r in c.vocab.collect()}
    assert ids == {"<eos>": 0, "a": 1, "c": 2, "b": 3, "d": 4}
    assert [r["token_id"] for r in c.splits["train"].orderBy("gpos").collect()] == [3, 1, 0, 1, 2, 0]
    bag = pipelines.lm_corpus(splits, CORPORA["lm1b"], ("<S>", "<UNK>"), "<UNK>", lines(spark, ["a 1", "b 2"]))
    assert [list(r["ids"]) for r in bag.splits["valid"].collect()] == [[2, 3, 3, 2]]


def test_masked_lm(spark):
    seqs = examples.sequences(spark, SF)
    for strategy in ("single_token", "token_span"):
        for r in pipelines.masked_lm(seqs, examples.L, examples.P, examples.MASK, examples.EOS, 1000, strategy).collect():
            assert len(r["target"]) == examples.P and sum(r["target_mask"]) == examples.P
            assert [r["inputs"][i] for i in r["target_index"]] == r["target"]
            changed = {i for i, (a, b) in enumerate(zip(r["inputs"], r["masked_input"], strict=True)) if a != b}
            assert changed <= set(r["target_index"])


def test_seq2seq_batches(spark):
    pairs = spark.createDataFrame([(k, [k + 1] * (k % 7 + 1), [k + 1] * (k % 5 + 1)) for k in range(200)], "k long, source array<int>, target array<int>")
    packed = pipelines.seq2seq_batches(pairs, ["k"], 16, 4, shift_target=True).collect()
    assert packed and all(len(r["source"]) == 16 for r in packed)
    assert sorted({r["batch_id"] for r in packed}) == list(range(len(packed) // 4))
    for r in packed:
        for s, t, p in zip(r["target_segmentation"], r["target"], r["target_position"], strict=True):
            assert (s == 0) == (t == 0) and (s == 0 or p >= r["source_segmentation"].count(s))
    plain = pipelines.seq2seq_batches(pairs, ["k"], 16, 4, packed=False).collect()
    assert len({r["k"] for r in plain}) == 200


def test_knn_evaluation(spark):
    store = spark.createDataFrame([(0, [0.0, 1.0], 1), (1, [1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    queries = spark.createDataFrame([(5, [0.0, 1.0])], "query_id long, embedding array<float>")
    model = spark.createDataFrame([(5, 1, 0.5), (5, 3, 0.5)], "query_id long, label int, p_model double")
    target = spark.createDataFrame([(5, 1)], "query_id long, label int")
    near = 1 / (1 + math.exp(-math.sqrt(2)))
    r = pipelines.knn_evaluation(spark, store, queries, model, target, 2, 0.25).first()
    assert abs(r["nll"] + math.log(0.25 * near + 0.75 * 0.5)) < 1e-9 and abs(r["perplexity"] - math.exp(r["nll"])) < 1e-9
    assert abs(pipelines.knn_evaluation(spark, store, queries, model, target, 2, 0.0).first()["nll"] - math.log(2)) < 1e-9


def test_materialised(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert pipelines.materialised(spark.range(3), path).count() == 3
    assert pipelines.materialised(spark.range(5), path).count() == 3
    assert pipelines.materialised(spark.range(5), path, fresh=True).count() == 5


def test_array_functions(spark):
    a = F.array(*map(F.lit, [0.5, 2.0, -1.0, 2.0]))
    row = spark.range(1).select(arrays.top_k(a, 3).alias("t"), arrays.softmax(a).alias("s"), arrays.gelu_erf(F.lit(0.5)).alias("g"), arrays.relu(F.lit(-2.0)).alias("r"), arrays.segment_sizes(F.array(*map(F.lit, [1, 1, 2, 0]))).alias("n")).first()
    assert row["t"] == [1, 3, 0] and abs(sum(row["s"]) - 1) < 1e-12 and row["r"] == 0 and row["n"] == {1: 2, 2: 1}
    assert abs(row["g"] - 0.5 * 0.5 * (1 + math.erf(0.5 / math.sqrt(2)))) < 1e-12


def test_replaced_tokens_are_aligned(spark):
    spec = edits.EditSpec(enc_len=200, dec_len=200)
    rows = edits.edit_examples(edits.sample_edits(examples.typed(spark, SF), examples.L, spec, 5), spec)
    out = rows.withColumn("al", edits.replaced_alignment(F.col("gen_index"), F.col("gen_tgt_mask"), F.col("dec_edit_index"), F.col("edit_label"), spec))
    for r in out.collect():
        assert r["al"] and all(r["gen_tgt"][x["gen"]] == r["dec_tgt"][x["dec"]] == r["dec_masked_tgt"][x["edit"]] for x in r["al"])
