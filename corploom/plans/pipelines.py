"""Whole pipelines: a corpus from raw lines, masked-LM and sequence-to-sequence examples, retrieval-augmented evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.functions import text as tx
from corploom.functions.arrays import pad
from corploom.operators import combinators, knn, metrics, packing, positions, spans, vocab
from corploom.sources.records import truncated, valid_length
from corploom.sources.text import CorpusSpec


@dataclass
class Corpus:
    """A vocabulary (token, token_id, cnt) and, for each split, an ordered stream (gpos, token_id) or a bag (line_no, ids)."""

    vocab: DataFrame
    splits: dict[str, DataFrame]


def materialised(df: DataFrame, path: str, fresh: bool = False) -> DataFrame:
    """df as a table at path, written if it isn't there yet or fresh is asked for. The path is the key: name it by what df depends on."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fresh or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lm_corpus(splits: dict[str, DataFrame], spec: CorpusSpec, specials: tuple[str, ...] = ("<eos>",), unk: str | None = None, vocab_lines: DataFrame | None = None, max_size: int | None = None, min_freq: int = 0) -> Corpus:
    """splits: (line_no, line) each. Counts the spec's splits without end marks (or reads the vocabulary's lines), encodes all with them."""
    delimiter = "" if spec.name in ("enwik8", "text8") else None
    tokens = lambda df, **marks: df.select("line_no", tx.tokenize_line(F.col("line"), delimiter, spec.lower, **marks).alias("w"))
    if spec.vocab_file:
        table = vocab.vocab_from_lines(vocab_lines, list(specials)).withColumn("cnt", F.lit(0).cast("long"))
    else:
        pooled, order = None, {s: k for k, s in enumerate(spec.count_splits)}
        for s in spec.count_splits:
            own = tokens(splits[s]).select(F.lit(order[s]).alias("s"), "line_no", F.posexplode("w").alias("p", "token"))
            pooled = own if pooled is None else pooled.unionByName(own)
        counts = pooled.groupBy("token").agg(F.count("*").alias("cnt"), F.min(F.struct("s", "line_no", "p")).alias("first_pos"))
        table = vocab.build_vocab(counts, list(specials), max_size, min_freq)
    unk_id = None
    if unk is not None:
        unk_id = table.where(F.col("token") == unk).first()["token_id"]
    out = {}
    for name, df in splits.items():
        marked = tokens(df, add_eos=spec.add_eos, add_double_eos=spec.add_double_eos)
        if spec.ordered:
            stream = positions.stream_positions(marked, "line_no", "w", "token")
            coded = vocab.encode_strict(stream, table) if unk_id is None else vocab.encode(stream, table, unk_id)
            out[name] = coded.select("gpos", "token_id")
        else:
            out[name] = vocab.encode_arrays(marked, "w", table, ["line_no"], unk_id if unk_id is not None else -1).select("line_no", "ids")
    return Corpus(table, out)


def masked_lm(seqs: DataFrame, seq_len: int, num_predict: int, mask_id: int, eos: int, vocab_size: int, strategy: str = "token_span", law: spans.SpanLaw = spans.MLM, leak: float = 0.1, rand: float = 0.1, seed: int = 0) -> DataFrame:
    """Masked-LM examples of seqs (seq_id, token_ids): single tokens, or spans topped up to num_predict places."""
    rows = spans.places(seqs)
    if strategy == "single_token":
        masked = spans.single_token_mask(rows, num_predict, eos, seed)
    elif strategy == "token_span":
        masked = spans.span_mask_topped_up(rows, spans.sample_spans(seqs, seq_len, num_predict, law, seed), num_predict, eos, seed)
    else:
        raise ValueError(f"no strategy {strategy}")
    return spans.mlm_examples(spans.corrupt(masked, mask_id, vocab_size, leak, rand, seed), num_predict, mask_id)


def seq2seq_batches(pairs: DataFrame, key: list[str], max_length: int, bsz: int, max_source: int = 0, max_target: int = 0, min_length: int = 1, packed: bool = True, shift_target: bool = False, seed: int = 0) -> DataFrame:
    """(batch_id, row_id, source.., target..) from pairs (key.., source, target): cut, shuffled, packed with segments and positions or padded,
    shuffled again, in whole batches."""
    kept = truncated(pairs, max_source, max_target).where(valid_length(["source", "target"], min_length, max_length))
    keyed = combinators.shuffle_key(kept, key, seed).withColumn("_tie", F.struct(*key))
    placed = positions.indexed(keyed, "shuffle_key", "_i", "_tie")
    if packed:
        out = packing.pack(placed, max_length, ["source", "target"], "_i")
        if shift_target:
            out = out.withColumn("target_position", packing.shift_target_position(F.col("target_position"), F.col("target_segmentation"), F.col("source_segmentation")))
        out, again = out.withColumn("_tie", F.struct("pack_window", "bin")), ["pack_window", "bin"]
    else:
        out, again = placed.select(*key, "_tie", pad(F.col("source"), max_length).alias("source"), pad(F.col("target"), max_length).alias("target")), key
    rows = positions.indexed(combinators.shuffle_key(out, again, seed + 1).withColumnRenamed("shuffle_key", "_k"), "_k", "_j", "_tie")
    from corploom.operators.batching import full_batches

    return full_batches(rows, "_j", bsz).drop("_k", "_j", "_tie")


def knn_evaluation(spark: SparkSession, store: DataFrame, queries: DataFrame, p_model: DataFrame, targets: DataFrame, k: int = 256, lam: float = 0.1) -> DataFrame:
    """(nll, perplexity, n): mean -ln p of targets (query_id, label) under the mixture of neighbours' labels and p_model (query_id, label, p_model)."""
    mixed = p_model.withColumnRenamed("p_model", "p") if lam <= 0 else knn.interpolate(knn.distribution(knn.search(queries, store, k)), p_model, lam)
    scored = targets.join(mixed, ["query_id", "label"], "left").select((-F.log(F.coalesce("p", F.lit(0.0)))).alias("nll"))
    mean = scored.agg(F.avg("nll").alias("nll"), F.count("*").alias("n"))
    return mean.select("nll", metrics.perplexity(F.col("nll")).alias("perplexity"), "n")
