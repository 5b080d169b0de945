"""Text sources with explicit order: lines, sentences, documents, articles, pairs, vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corploom.functions import text as tx
from corploom.operators.positions import offsets


@dataclass(frozen=True)
class CorpusSpec:
    """How a corpus is read: splits that are counted, end marks, ordered or a bag of sentences, vocabulary file."""

    name: str
    count_splits: tuple[str, ...] = ("train",)
    add_eos: bool = True
    add_double_eos: bool = False
    ordered: bool = True
    lower: bool = False
    vocab_file: bool = False
    count_eos: bool = False


_ALL = ("train", "valid", "test")
#: Known corpora (fixed values).
CORPORA = {
    "ptb": CorpusSpec("ptb", _ALL, lower=True),
    "wt2": CorpusSpec("wt2", _ALL),
    "enwik8": CorpusSpec("enwik8", _ALL, add_eos=False),
    "text8": CorpusSpec("text8", _ALL, add_eos=False),
    "wt103": CorpusSpec("wt103", ("train",)),
    "lm1b": CorpusSpec("lm1b", (), add_eos=False, add_double_eos=True, ordered=False, vocab_file=True),
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_idx from 1, line_no from 0, line) of text files. A file's lines are numbered by where they stand in its splits:
    each split's lines are numbered by themselves, and only the splits' sizes are summed."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"), F.col("value").alias("line"))
    split = raw.withColumn("_in", F.row_number().over(Window.partitionBy("path", "_block").orderBy("_m")) - 1)
    sizes = raw.groupBy("path", "_block").agg(F.count("*").alias("_n"))  # a row for each split of a file
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("path", "_block", before.alias("_start"), F.dense_rank().over(Window.orderBy("path")).alias("file_idx"))
    return split.join(starts, ["path", "_block"]).select("path", "file_idx", (F.col("_start") + F.col("_in")).cast("long").alias("line_no"), "line")


def document_lines(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys.., line_no, line) of a table of texts."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def sentences(rows: DataFrame, encode: Column, eos: int | None = None, double: bool = False) -> DataFrame:
    """rows with ids = encode of the line, framed by eos; rows without any token go before framing."""
    out = rows.withColumn("ids", encode).where(F.size("ids") > 0)
    return out if eos is None else out.withColumn("ids", tx.frame(F.col("ids"), eos, not double, double))


def documents(rows: DataFrame, keys: tuple[str, ...] = ("path",), min_doc_len: int = 1) -> DataFrame:
    """(keys.., doc_no, sents array<array<string>>, n_tokens): runs of lines between blank ones with at least max(min_doc_len, 1) tokens."""
    blank = tx.strip(F.col("line")) == ""
    marked = offsets(rows.withColumn("_b", blank.cast("long")), "line_no", "_b", keys).withColumn("doc_no", F.col("offset") + F.col("_b")).where("_b = 0")
    sent = marked.select(*keys, "doc_no", "line_no", tx.words(F.col("line")).alias("s"))
    grouped = sent.groupBy(*keys, "doc_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]).alias("sents"), F.sum(F.size("s")).cast("long").alias("n_tokens"))
    return grouped.where(F.col("n_tokens") >= max(min_doc_len, 1))


def articles(rows: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """rows with article: a title line ' = Title = ' between blank lines starts one a line earlier (0 before the first)."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    blank = lambda c: tx.strip(F.coalesce(c, F.lit(""))) == ""
    title = F.col("line").rlike("^ = [^=]+ = \\s*$") & blank(F.lag("line").over(w)) & blank(F.lead("line").over(w))
    marked = rows.withColumn("_title", title)
    starts = F.coalesce(F.lead("_title").over(w), F.lit(False)).cast("int") + F.when((F.col("line_no") == 0) & F.col("_title"), 1).otherwise(0)
    return marked.withColumn("article", F.sum(starts).over(w).cast("int")).drop("_title")


def pairs(rows: DataFrame) -> DataFrame:
    """rows with source and target of lines with exactly one tab; others go."""
    parts = F.split("line", "\t", -1)
    return rows.where(F.size(parts) == 2).withColumn("source", parts[0]).withColumn("target", parts[1])


def char_split(chars: DataFrame, n_chars: int, tail: int = 5_000_000) -> DataFrame:
    """(split, pos, ch) of a character stream (pos, ch): the last tail are test, those before valid, the rest train; a space is _."""
    split = F.when(F.col("pos") < n_chars - 2 * tail, "train").when(F.col("pos") < n_chars - tail, "valid").otherwise("test")
    return chars.select(split.alias("split"), "pos", F.when(F.col("ch") == " ", "_").otherwise(F.col("ch")).alias("ch"))


def fixed_char_split(text: Column, tail: int) -> tuple[Column, Column, Column]:
    """(train, valid, test) of one text as spaced characters with _ for spaces, each stripped first."""
    n = F.length(text)
    spaced = lambda s: F.array_join(F.filter(F.split(F.translate(tx.strip(s), " ", "_"), ""), lambda c: c != ""), " ")
    return spaced(F.substring(text, F.lit(1), n - 2 * tail)), spaced(F.substring(text, n - 2 * tail + 1, F.lit(tail))), spaced(F.substring(text, n - tail + 1, F.lit(tail)))
