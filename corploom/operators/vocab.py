"""Vocabulary: counts, ranking, encoding and decoding by dictionary joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.operators.bands import band_join
from corploom.operators.positions import indexed

#: A vocabulary up to this size is sent to all executors; a larger one is joined by shuffle.
BROADCAST_TOKENS = 2_000_000


@dataclass(frozen=True)
class SpecialIds:
    """Ids of the marks by role; None where a vocabulary has none."""

    unk: int | None = None
    bos: int | None = None
    eos: int | None = None
    cls: int | None = None
    sep: int | None = None
    pad: int | None = None
    eod: int | None = None
    eop: int | None = None
    mask: int | None = None
    ins: int | None = None
    placeholder_0: int | None = None

    def placeholder(self, k: int) -> int:
        if self.placeholder_0 is None:
            raise ValueError("the vocabulary has no placeholders")
        return self.placeholder_0 + k


#: Mark of each role (fixed values).
MARKS = {"unk": "<unk>", "bos": "<s>", "eos": "</s>", "cls": "<cls>", "sep": "<sep>", "pad": "<pad>", "eod": "<eod>", "eop": "<eop>", "mask": "<mask>", "ins": "<ins>"}


def special_ids(vocab: DataFrame, marks: dict[str, str] | None = None) -> SpecialIds:
    """Looks marks up; one that isn't in vocab (token, token_id) stays None, except that nothing takes unk's id in its place."""
    marks = marks or MARKS
    wanted = [*marks.values(), "<ph_id_0>"]
    found = {r["token"]: r["token_id"] for r in vocab.where(F.col("token").isin(wanted)).collect()}
    return SpecialIds(**{role: found.get(mark) for role, mark in marks.items()}, placeholder_0=found.get("<ph_id_0>"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """(token, cnt, first_pos) from tokens (gpos, token), summed before the shuffle."""
    return tokens.groupBy("token").agg(F.count("*").alias("cnt"), F.min("gpos").alias("first_pos"))


def build_vocab(counts: DataFrame, specials: list[str] = (), max_size: int | None = None, min_freq: int = 0) -> DataFrame:
    """(token, token_id, cnt): specials first, then the max_size commonest (ties by first occurrence) with cnt >= min_freq, without specials."""
    top = counts.where(F.col("cnt") >= min_freq).withColumn("_k", -F.col("cnt"))
    if max_size is not None:
        top = top.orderBy("_k", "first_pos").limit(max_size)
    ranked = indexed(top.where(~F.col("token").isin(list(specials))), "_k", "_rank", tie="first_pos", most=max_size)
    ranked = ranked.select("token", (F.col("_rank") + len(specials)).cast("int").alias("token_id"), "cnt")
    if not specials:
        return ranked
    spark = counts.sparkSession
    first = spark.createDataFrame([(s, k) for k, s in enumerate(specials)], "token string, token_id int")
    first = first.join(counts.select("token", "cnt"), "token", "left").select("token", "token_id", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))
    return first.unionByName(ranked)


def vocab_from_lines(lines: DataFrame, specials_after: list[str] = ()) -> DataFrame:
    """(token, token_id) from lines (line_no, line): the first field of each, the first of repeats stays; missing specials follow."""
    first = F.element_at(F.filter(F.split("line", "\\s+"), lambda w: w != ""), 1)
    kept = lines.select(first.alias("token"), "line_no").where("token IS NOT NULL").groupBy("token").agg(F.min("line_no").alias("line_no"))
    if specials_after:
        spark = lines.sparkSession
        more = spark.createDataFrame([(s, 2**62 + k) for k, s in enumerate(specials_after)], "token string, line_no long")
        kept = kept.unionByName(more.join(kept, "token", "left_anti"))
    return indexed(kept, "line_no", "token_id").select("token", F.col("token_id").cast("int").alias("token_id"))


def _side(vocab: DataFrame, most: int | None) -> DataFrame:
    """Broadcast if it has at most BROADCAST_TOKENS rows: known by most, or counted."""
    return F.broadcast(vocab) if (vocab.count() if most is None else most) <= BROADCAST_TOKENS else vocab


def encode(tokens: DataFrame, vocab: DataFrame, unk_id: int | None = None, most: int | None = None) -> DataFrame:
    """tokens with token_id: unk_id for unknown ones, or null without one (see encode_strict). most: a bound of the vocabulary's rows, if one is known."""
    ids = _side(vocab.select("token", "token_id"), most)
    out = tokens.join(ids, "token", "left")
    return out if unk_id is None else out.withColumn("token_id", F.coalesce("token_id", F.lit(unk_id)))


def encode_strict(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """tokens with token_id; an unknown token raises when the row is computed."""
    known = F.col("token_id").isNotNull()
    out = encode(tokens, vocab)
    return out.withColumn("token_id", F.when(known, F.col("token_id")).otherwise(F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.col("token"))).cast("int")))


def encode_arrays(rows: DataFrame, tokens: str, vocab: DataFrame, key: list[str], unk_id: int) -> DataFrame:
    """rows' token arrays as id arrays in column ids, order kept by position."""
    long = rows.select(*key, F.posexplode(tokens).alias("_p", "token"))
    sided = encode(long, vocab, unk_id)
    ids = sided.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "token_id"))), lambda s: s["token_id"]).alias("ids"))
    return rows.join(ids, key, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def decode(ids: DataFrame, vocab: DataFrame, most: int | None = None) -> DataFrame:
    """ids (.., token_id) with token; an id out of bounds raises."""
    out = ids.join(_side(vocab.select("token_id", "token"), most), "token_id", "left")
    return out.withColumn("token", F.when(F.col("token").isNotNull(), F.col("token")).otherwise(F.raise_error(F.concat(F.lit("no such id: "), F.col("token_id").cast("string")))))


def embedding_lookup(ids: DataFrame, table: DataFrame) -> DataFrame:
    """ids (.., token_id) with the vector of table (token_id, embedding)."""
    return ids.join(table, "token_id")


def adaptive_cluster(token_id: Column, cutoffs: list[int], vocab_size: int) -> tuple[Column, Column]:
    """(cluster, id in the cluster) for intervals [0, c1), [c1, c2) ... [.., vocab_size); null outside."""
    edges = [0, *cutoffs, vocab_size]
    cluster, local = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (token_id >= lo) & (token_id < hi)
        cluster, local = F.when(inside, F.lit(k)).otherwise(cluster), F.when(inside, (token_id - lo).cast("int")).otherwise(local)
    return cluster, local


def coverage_cutoffs(vocab: DataFrame, parts: list[int], of: int) -> DataFrame:
    """(cluster, first_id, end_id) of a vocabulary (token_id, cnt) whose ids are contiguous and begin with the commonest: cluster k holds the ids before which parts[k - 1] / of
    of all occurrences are counted, and parts[k] / of aren't. Clusters that hold no id are absent. The vocabulary is bounded; one window sums it."""
    before = F.coalesce(F.sum("cnt").over(Window.orderBy("token_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = vocab.select("token_id", before.alias("_before"), F.sum("cnt").over(Window.partitionBy()).alias("_all"))
    reached = [(F.col("_before") * of >= F.col("_all") * p).cast("int") for p in parts]
    cluster = sum(reached[1:], reached[0])
    return placed.groupBy(cluster.alias("cluster")).agg(F.min("token_id").cast("long").alias("first_id"), (F.max("token_id") + 1).cast("long").alias("end_id"))


def cluster_join(ids: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """ids (.., token_id) with cluster and local_id by a table of cutoffs (cluster, first_id, end_id); null where no interval holds the id."""
    out = band_join(ids, cutoffs.select("cluster", "first_id", "end_id"), "token_id", "first_id", "end_id", how="left")
    return out.withColumn("local_id", (F.col("token_id") - F.col("first_id")).cast("int")).drop("first_id", "end_id")
