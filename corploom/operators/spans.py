"""Keyed-random masks over sequences in long form: one row for each place (seq_id, pos, token_id)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.functions.arrays import indices, let
from corploom.functions.rng import key_prefix, keyed_hex, keyed_uniform
from corploom.operators.bands import band_join


@dataclass(frozen=True)
class SpanLaw:
    """How spans are drawn. zipf: length n with weight 1 / (n + 1), else uniform; gap: one more place a span (length or left
    context); rounded: round, else truncate; closed: a span may end at the sequence's end."""

    min_tok: int = 1
    max_tok: int = 5
    zipf: bool = True
    gap: str = "none"
    rounded: bool = True
    closed: bool = False


MLM = SpanLaw()
MASS = SpanLaw(rounded=False, closed=True)
SENTINEL = SpanLaw(zipf=False, gap="length", rounded=False, closed=True)
EDIT = SpanLaw(zipf=False, gap="left", rounded=False, closed=True)


def places(seqs: DataFrame, ids: str = "token_ids", types: str | None = None) -> DataFrame:
    """seqs (seq_id, ids array) as (seq_id, pos, token_id[, type_id])."""
    if types is None:
        return seqs.select("seq_id", F.posexplode(ids).alias("pos", "token_id"))
    zipped = F.arrays_zip(F.col(ids).alias("token_id"), F.col(types).alias("type_id"))
    return seqs.select("seq_id", F.posexplode(zipped).alias("pos", "z")).select("seq_id", "pos", "z.token_id", "z.type_id")


def single_token_mask(rows: DataFrame, num_predict: int, eos: int, seed: int = 0, exclude: Column | None = None) -> DataFrame:
    """rows with is_masked on num_predict places of each sequence, drawn among those that aren't eos or excluded."""
    able = F.col("token_id") != eos
    if exclude is not None:
        able = able & ~exclude
    draw = keyed_uniform(seed, "single", F.col("seq_id"), F.col("pos"))
    order = F.row_number().over(Window.partitionBy("seq_id").orderBy((~able).cast("int"), draw, "pos"))
    return rows.withColumn("is_masked", able & (order <= num_predict))


def length_edges(law: SpanLaw) -> list[tuple[float, int]]:
    """(upper edge, length): a draw below the edge, and not below an earlier one, gives the length."""
    sizes = range(law.min_tok, law.max_tok + 1)
    weights = [1 / (k + 2) if law.zipf else 1.0 for k in range(len(sizes))]
    total, run, edges = sum(weights), 0.0, []
    for n, w in zip(sizes, weights, strict=True):
        run += w / total
        edges.append((run, n))
    return edges


def _length(u: Column, law: SpanLaw) -> Column:
    out = F.lit(law.max_tok)
    for edge, n in reversed(length_edges(law)[:-1]):
        out = F.when(u < edge, F.lit(n)).otherwise(out)
    return out


def drawn_spans(seq: Column, seq_len: int, num_predict: int, law: SpanLaw = MLM, seed: int = 0) -> Column:
    """sample_spans() of one sequence: an array of (span_rank, k, beg, end) in order of rank."""
    alpha = seq_len / num_predict
    whole = (lambda c: F.rint(c).cast("long")) if law.rounded else (lambda c: c.cast("long"))
    size = lambda k: (_length(keyed_uniform(seed, "len", seq, k), law) + (1 if law.gap == "length" else 0)).cast("long")
    left = lambda k, n: whole(keyed_uniform(seed, "left", seq, k) * n.cast("double") * (alpha - 1)) + (1 if law.gap == "left" else 0)
    draw = lambda k: let(let(size(k), lambda n: F.struct(n.alias("n"), left(k, n).alias("left"))), lambda x: F.struct(k.alias("k"), x["n"].alias("n"), x["left"].alias("left"), (whole(x["n"].cast("double") * alpha)).alias("all")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<k:int,beg:bigint,end:bigint>>").alias("out"))
    placed = lambda acc, x: F.struct((acc["at"] + x["all"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["k"].alias("k"), (acc["at"] + x["left"]).alias("beg"), (acc["at"] + x["left"] + x["n"]).alias("end")))).alias("out"))
    spans = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(num_predict - 1)), draw), start, placed, lambda acc: acc["out"])
    fit = F.filter(spans, lambda x: (x["end"] <= seq_len) if law.closed else (x["end"] < seq_len))
    ranked = let(key_prefix(seed, "order", seq), lambda p: F.sort_array(F.transform(fit, lambda x: F.struct(keyed_hex(p, x["k"]).alias("u"), x["k"].alias("k"), x["beg"].alias("beg"), x["end"].alias("end")))))
    return F.transform(ranked, lambda x, i: F.struct((i + 1).alias("span_rank"), x["k"].alias("k"), x["beg"].alias("beg"), x["end"].alias("end")))


def sample_spans(seqs: DataFrame, seq_len: int, num_predict: int, law: SpanLaw = MLM, seed: int = 0) -> DataFrame:
    """(seq_id, k, beg, end, span_rank): disjoint spans, span_rank their random order from 1. seqs: (seq_id)."""
    rows = seqs.select("seq_id", F.explode(drawn_spans(F.col("seq_id"), seq_len, num_predict, law, seed)).alias("_s"))
    return rows.select("seq_id", "_s.k", "_s.beg", "_s.end", "_s.span_rank")


def gathered(rows: DataFrame) -> DataFrame:
    """(seq_id, z): each sequence's places as structs (pos, the other columns) in one array, in order."""
    return rows.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("pos", *[c for c in rows.columns if c not in ("seq_id", "pos")]))).alias("z"))


def masked_singles(seq: Column, ids: Column, num_predict: int, eos: int, seed: int = 0) -> Column:
    """single_token_mask() of a sequence in one array: its places (pos, token_id, is_masked)."""

    def chosen(own: Column) -> Column:
        able = F.filter(indices(F.size(own)), lambda i: F.get(own, i) != eos)
        ranked = let(key_prefix(seed, "single", seq), lambda p: F.sort_array(F.transform(able, lambda i: F.struct(keyed_hex(p, i).alias("u"), i.alias("i")))))
        return F.transform(F.slice(ranked, 1, num_predict), lambda x: x["i"])

    return let(ids, lambda own: let(chosen(own), lambda at: F.transform(own, lambda t, i: F.struct(i.alias("pos"), t.alias("token_id"), F.array_contains(at, i).alias("is_masked")))))


def masked_spans(ids: Column, spans: Column, num_predict: int, eos: int, types: Callable[[Column], Column] | None = None) -> Column:
    """mask_spans() of a sequence in one array with its spans (span_rank, beg, end, in order of rank) in another: its places (pos,
    token_id[, type_id of the place], segment_id, span_pos, is_masked)."""
    none = F.array().cast("array<int>")

    def hits(own: Column) -> Column:
        inside = lambda s: F.when(F.greatest(s["beg"], F.lit(0)) < s["end"], F.sequence(F.greatest(s["beg"], F.lit(0)).cast("int"), (s["end"] - 1).cast("int"))).otherwise(none)
        real = lambda s: F.filter(inside(s), lambda p: F.coalesce(F.get(own, p) != eos, F.lit(False)))
        each = F.transform(spans, lambda s: F.transform(real(s), lambda p, j: F.struct(p.alias("pos"), s["span_rank"].cast("int").alias("rank"), j.alias("at"))))
        return F.slice(F.flatten(each), 1, num_predict)

    def place(t: Column, i: Column, found: Column) -> Column:
        kind = [types(i).alias("type_id")] if types else []
        hit = found.isNotNull()
        return F.struct(i.alias("pos"), t.alias("token_id"), *kind, F.when(hit, found["rank"]).otherwise(0).alias("segment_id"), F.when(hit, found["at"]).otherwise(0).alias("span_pos"), hit.alias("is_masked"))

    def whole(own: Column, at: Column, found: Column) -> Column:
        return F.transform(own, lambda t, i: let(F.get(found, (F.array_position(at, i) - 1).cast("int")), lambda x: place(t, i, x)))

    return let(ids, lambda own: let(hits(own), lambda found: let(F.transform(found, lambda x: x["pos"]), lambda at: whole(own, at, found))))


def corrupted(seq: Column, z: Column, mask_id: int, vocab_size: int, leak: float = 0.1, rand: float = 0.1, seed: int = 0) -> Column:
    """corrupt() of places in one array: they get masked_input."""

    def changed(x: Column) -> Column:
        other = F.floor(keyed_uniform(seed, "random_id", seq, x["pos"]) * vocab_size).cast("int")
        return let(keyed_uniform(seed, "corrupt", seq, x["pos"]), lambda u: F.when((u > leak) & (u < leak + rand), other).when(u > leak, F.lit(mask_id)).otherwise(x["token_id"]))

    return F.transform(z, lambda x: x.withField("masked_input", F.when(x["is_masked"], changed(x)).otherwise(x["token_id"])))


def mask_spans(rows: DataFrame, spans: DataFrame, num_predict: int, eos: int) -> DataFrame:
    """rows with is_masked, segment_id (the span's rank, 0 outside) and span_pos. Places are counted span by span in order of
    rank, without eos, while there are at most num_predict of them: the last span may be cut.

    A sequence's places (all of them, from 0) and its spans meet in one row, and what lies in [beg, end) is found there. Spans are disjoint.
    """
    names = [c for c in rows.columns if c != "seq_id"]
    whole = rows.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in names if c != "pos"]))).alias("_z"))
    own = spans.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct(F.col("span_rank").cast("int").alias("rank"), F.greatest(F.col("beg"), F.lit(0)).cast("int").alias("beg"), F.col("end").cast("int").alias("end")))).alias("_s"))
    none = F.array().cast("array<int>")
    inside = lambda s: F.when(s["beg"] < s["end"], F.sequence(s["beg"], s["end"] - 1)).otherwise(none)
    steps = F.flatten(F.transform("_s", lambda s: F.transform(inside(s), lambda p: F.struct(s["rank"].alias("rank"), p.alias("pos")))))
    hits = F.slice(F.filter(steps, lambda x: F.coalesce(F.get("_z", x["pos"])["token_id"] != eos, F.lit(False))), 1, num_predict)
    joined = whole.join(own, "seq_id", "left").withColumn("_h", hits)
    joined = joined.select("seq_id", "_z", F.transform("_h", lambda x: x["pos"].cast("int")).alias("_p"), F.transform("_h", lambda x: x["rank"]).alias("_r"))
    at = joined.select("seq_id", F.explode("_z").alias("_x"), "_p", "_r").withColumn("_k", F.coalesce(F.array_position("_p", F.col("_x.pos").cast("int")), F.lit(0)).cast("int"))
    rank = F.get("_r", F.col("_k") - 1)
    masked = F.col("_k") > 0
    first = F.array_position("_r", rank).cast("int")
    return at.select(
        *[F.col("seq_id") if c == "seq_id" else F.col(f"_x.{c}").alias(c) for c in rows.columns], F.when(masked, rank).otherwise(0).alias("segment_id"),
        F.when(masked, F.col("_k") - first).otherwise(0).alias("span_pos"), masked.alias("is_masked"),
    )


def span_places(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (seq_id, pos, ..) that lie in a span, once for each span that holds them, with the spans' columns and span_pos, the place in the span. Spans may
    overlap and a sequence may have any length: places and spans meet by bins, not in one row. A bin of a
    sequence holds no more places than it is wide."""
    return band_join(rows, spans, "pos", "beg", "end", ("seq_id",), share=None).withColumn("span_pos", (F.col("pos") - F.col("beg")).cast("int"))


def places_of(ids: Column, spans: Column) -> Column:
    """span_places() of one sequence's ids and spans, arrays that meet in its row: structs (pos, token_id, span_rank, span_pos)."""
    none = F.array().cast("array<int>")
    last = lambda own, s: F.least(s["end"].cast("int"), F.size(own)) - 1
    held = lambda own, s: F.when(F.greatest(s["beg"], F.lit(0)) <= last(own, s), F.sequence(F.greatest(s["beg"], F.lit(0)).cast("int"), last(own, s))).otherwise(none)
    each = lambda own, s: F.transform(held(own, s), lambda p: F.struct(p.alias("pos"), F.get(own, p).alias("token_id"), s["span_rank"].alias("span_rank"), (p - s["beg"]).cast("int").alias("span_pos")))
    return let(ids, lambda own: F.flatten(F.transform(spans, lambda s: each(own, s))))


def topped_up(seq: Column, z: Column, num_predict: int, eos: int, seed: int = 0) -> Column:
    """span_mask_topped_up() of masked_spans' places: the places that are masked, ascending."""

    def chosen(own: Column) -> Column:
        spanned = F.transform(F.filter(own, lambda x: x["is_masked"]), lambda x: x["pos"])
        able = F.filter(own, lambda x: ~x["is_masked"] & (x["token_id"] != eos))
        ranked = let(key_prefix(seed, "single", seq), lambda p: F.sort_array(F.transform(able, lambda x: F.struct(keyed_hex(p, x["pos"]).alias("u"), x["pos"].alias("i")))))
        return let(spanned, lambda s: F.sort_array(F.concat(s, F.transform(F.slice(ranked, F.lit(1), F.greatest(F.lit(num_predict) - F.size(s), F.lit(0))), lambda x: x["i"]))))

    return let(z, chosen)


def span_mask_topped_up(rows: DataFrame, spans: DataFrame, num_predict: int, eos: int, seed: int = 0) -> DataFrame:
    """Spans first, then single places until num_predict are masked."""
    spanned = mask_spans(rows, spans, num_predict, eos)
    w = Window.partitionBy("seq_id")
    able = (F.col("token_id") != eos) & ~F.col("is_masked")
    rest = num_predict - F.sum(F.col("is_masked").cast("int")).over(w)
    order = F.row_number().over(w.orderBy((~able).cast("int"), keyed_uniform(seed, "single", F.col("seq_id"), F.col("pos")), "pos"))
    return spanned.withColumn("_rest", rest).withColumn("is_masked", F.col("is_masked") | (able & (order <= F.col("_rest")))).drop("_rest")


def corrupt(rows: DataFrame, mask_id: int, vocab_size: int, leak: float = 0.1, rand: float = 0.1, seed: int = 0) -> DataFrame:
    """rows with masked_input: of masked places a part leak keeps its token, a part rand gets a random id, the rest mask_id."""
    u = keyed_uniform(seed, "corrupt", F.col("seq_id"), F.col("pos"))
    other = F.floor(keyed_uniform(seed, "random_id", F.col("seq_id"), F.col("pos")) * vocab_size).cast("int")
    changed = F.when((u > leak) & (u < leak + rand), other).when(u > leak, F.lit(mask_id)).otherwise(F.col("token_id"))
    return rows.withColumn("masked_input", F.when(F.col("is_masked"), changed).otherwise(F.col("token_id")))


def _collect(value: str, when: Column | None = None) -> Column:
    item = F.struct("pos", value)
    return F.transform(F.array_sort(F.collect_list(item if when is None else F.when(when, item))), lambda s: s[value])


def _padded(a: Column, n: int, filler: int = 0) -> Column:
    return F.concat(a, F.array_repeat(F.lit(filler), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def _values(z: Column | str, name: str) -> Column:
    return F.transform(z, lambda x: x[name])


def mlm_examples(rows: DataFrame, num_predict: int, mask_id: int) -> DataFrame:
    """(seq_id, inputs, masked_input, inp_mask, target, target_mask, target_index): targets in order of place, padded to num_predict."""
    return mlm_features(gathered(rows), num_predict, mask_id)


def mlm_features(whole: DataFrame, num_predict: int, mask_id: int) -> DataFrame:
    """mlm_examples() of sequences (seq_id, z), all places in one array."""
    own = F.filter("z", lambda x: x["is_masked"])
    got = whole.select("seq_id", _values("z", "token_id").alias("inputs"), _values("z", "masked_input").alias("masked_input"), _values(own, "token_id").alias("_t"), _values(own, "pos").alias("_i"))
    size = F.size("_t")
    return got.select(
        "seq_id", "inputs", "masked_input", F.transform("masked_input", lambda t: (t == mask_id).cast("int")).alias("inp_mask"),
        _padded(F.col("_t"), num_predict).alias("target"), F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), F.greatest(F.lit(num_predict) - size, F.lit(0)))).alias("target_mask"), F.col("_i").alias("target_index"),
    )


def mapping_matrix(index: Column, num_predict: int, seq_len: int) -> Column:
    """The one-hot matrix of target places, zero rows for padding; on request only, it has num_predict * seq_len cells."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_predict - 1)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(seq_len - 1)), lambda j: F.coalesce((F.get(index, k) == j).cast("int"), F.lit(0))))


def permutation_examples(rows: DataFrame, num_predict: int, leak: float = 0.1, seed: int = 0) -> DataFrame:
    """(seq_id, input_k, input_q, perm_index, target_index, target) of corrupt()'s rows with the same leak and seed.

    The key stream reads the original tokens, the query stream the corrupted ones. Masked places have a keyed order; context places have index -1, masked
    places whose token is leaked -2: they are seen like context and are still targets. Key j is hidden from place i where perm_mask() says so.
    """
    return permutation_features(gathered(rows), num_predict, leak, seed)


def permutation_features(whole: DataFrame, num_predict: int, leak: float = 0.1, seed: int = 0) -> DataFrame:
    """permutation_examples() of sequences (seq_id, z), all places in one array."""
    seq = F.col("seq_id")
    own = F.filter("z", lambda x: x["is_masked"])
    order = let(key_prefix(seed, "perm", seq), lambda p: _values(F.sort_array(F.transform(own, lambda x: F.struct(keyed_hex(p, x["pos"]).alias("u"), x["pos"].alias("pos")))), "pos"))
    index = lambda x, o: F.when(~x["is_masked"], F.lit(-1)).when(keyed_uniform(seed, "corrupt", seq, x["pos"]) <= leak, F.lit(-2)).otherwise((F.array_position(o, x["pos"]) - 1).cast("int"))
    perm = let(order, lambda o: F.transform("z", lambda x: index(x, o)))
    return whole.select("seq_id", _values("z", "token_id").alias("input_k"), _values("z", "masked_input").alias("input_q"), perm.alias("perm_index"), _values(own, "pos").alias("target_index"), _padded(_values(own, "token_id"), num_predict).alias("target"))


def hidden_counts(index: Column, targets: Column, query: bool) -> Column:
    """How many keys perm_mask() hides at each target's place: only places with an index of their own are compared."""
    own = F.filter(index, lambda j: j >= 0)
    at = let(index, lambda p: F.transform(targets, lambda t: F.get(p, t)))
    return let(own, lambda o: F.transform(at, lambda i: F.size(F.filter(o, lambda j: (j >= i) if query else (j > i)))))


def perm_mask(index: Column, query: bool) -> Column:
    """[i][j] is 1 where key j is hidden from i: for keys its index is greater than i's, for queries greater or equal; context is always seen."""
    return F.transform(index, lambda i: F.transform(index, lambda j: ((j >= 0) & ((j >= i) if query else (j > i))).cast("int")))


def target_perm_mask(index: Column, targets: Column, query: bool) -> Column:
    """perm_mask()'s rows at targets' places only."""
    at = F.transform(targets, lambda t: F.get(index, t))
    return F.transform(at, lambda i: F.transform(index, lambda j: ((j >= 0) & ((j >= i) if query else (j > i))).cast("int")))


def mass_examples(rows: DataFrame, num_predict: int, eos: int, origin_pos: bool = False) -> DataFrame:
    """(seq_id, enc_inp, target, dec_inp, dec_seg, dec_pos): masked tokens are decoded from themselves shifted by one, eos at each span's start."""
    return mass_features(gathered(rows), num_predict, eos, origin_pos)


def mass_features(whole: DataFrame, num_predict: int, eos: int, origin_pos: bool = False) -> DataFrame:
    """mass_examples() of sequences (seq_id, z), all places in one array."""
    before = lambda m, i: F.when(i > 0, F.get(m, i - 1))
    made = lambda m: F.transform(m, lambda x, i: let(before(m, i), lambda y: F.struct(x["token_id"].alias("target"), F.when(y.isNull() | (y["segment_id"] != x["segment_id"]), F.lit(eos)).otherwise(y["token_id"]).alias("dec_inp"), x["segment_id"].alias("dec_seg"), (x["pos"] - (1 if origin_pos else 0)).alias("dec_pos"))))
    got = whole.select("seq_id", _values("z", "masked_input").alias("enc_inp"), let(F.filter("z", lambda x: x["is_masked"]), made).alias("_m"))
    return got.select("seq_id", "enc_inp", *[_padded(_values("_m", c), num_predict).alias(c) for c in ("target", "dec_inp", "dec_seg", "dec_pos")])


def sentinel_examples(rows: DataFrame, seq_len: int, num_predict: int, placeholder_0: int, eos: int) -> DataFrame:
    """(seq_id, source, source_segmentation, source_position, source_type, target, target_segmentation, target_position, target_type) from
    mask_spans' rows with type_id.

    Every span gives up its last place. The source keeps one placeholder a span, numbered in order of place; the target has each
    placeholder before its span's tokens, then eos, then zeros. target_segmentation is 1 before the eos. A sequence's places are
    gathered once; all else happens inside its row.
    """
    return sentinel_features(gathered(rows), seq_len, num_predict, placeholder_0, eos)


def sentinel_features(whole: DataFrame, seq_len: int, num_predict: int, placeholder_0: int, eos: int) -> DataFrame:
    """sentinel_examples() of sequences (seq_id, z), all places in one array."""
    place = lambda x: F.struct(x["pos"].alias("pos"), x["token_id"].cast("int").alias("tok"), x["type_id"].cast("int").alias("ty"), F.when(x["is_masked"], x["span_pos"]).alias("at"))
    whole = whole.select("seq_id", F.transform("z", place).alias("z"))
    whole = whole.withColumn("m", F.filter("z", lambda x: x["at"].isNotNull()))
    # the place before another span's first one, or before none, is the last of its span
    whole = whole.withColumn("m", F.filter("m", lambda x, i: F.coalesce(F.get("m", i + 1)["at"] != 0, F.lit(False))))
    whole = whole.withColumn("starts", F.transform(F.filter("m", lambda x: x["at"] == 0), lambda x: x["pos"])).withColumn("hidden", F.transform("m", lambda x: x["pos"]))
    mark = lambda x: (F.array_position("starts", x["pos"]) - 1 + placeholder_0).cast("int")
    begins = lambda x: F.array_contains("starts", x["pos"])
    kept = F.filter("z", lambda x: ~F.array_contains("hidden", x["pos"]) | begins(x))
    pair = lambda first, second, x: F.when(begins(x), F.array(first, second)).otherwise(F.array(second))
    out = whole.select(
        "seq_id", _padded(F.transform(kept, lambda x: F.when(begins(x), mark(x)).otherwise(x["tok"])), seq_len).alias("source"), _padded(F.transform(kept, lambda x: x["ty"]), seq_len).alias("source_type"),
        F.flatten(F.transform("m", lambda x: pair(mark(x), x["tok"], x))).alias("_t"), F.flatten(F.transform("m", lambda x: pair(F.lit(0), x["ty"], x))).alias("_y"),
    )
    size = num_predict + 1
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    return out.select(
        "seq_id", "source", F.transform("source", lambda t: (t != 0).cast("int")).alias("source_segmentation"), numbers(seq_len).alias("source_position"), "source_type",
        _padded(F.concat("_t", F.array(F.lit(eos))), size).alias("target"), F.concat(F.array_repeat(F.lit(1), F.size("_t")), F.array_repeat(F.lit(0), F.greatest(F.lit(size) - F.size("_t"), F.lit(0)))).alias("target_segmentation"),
        numbers(size).alias("target_position"), _padded(F.col("_y"), size).alias("target_type"),
    )
