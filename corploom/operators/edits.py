"""Edit corruption: keyed deletions, insertions and replacements, and the encoder's and decoder's views of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corploom.functions.arrays import indices, let
from corploom.functions.rng import key_prefix, keyed_hex, keyed_uniform, numbered_bits
from corploom.operators.spans import gathered


@dataclass(frozen=True)
class EditSpec:
    del_ratio: float = 0.1
    ins_ratio: float = 0.1
    rep_ratio: float = 0.1
    enc_len: int = 256
    dec_len: int = 256
    mask_id: int = 3
    ins_id: int = 4
    pad_id: int = 0
    eos: int = 1
    del_label: int = 1
    ins_label: int = 2
    rep_label: int = 3


def _edited(rows: DataFrame, drawn: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> DataFrame:
    """rows with is_del, n_ins and is_rep as drawn adds them to (seq_id, z, token_ids)."""
    whole = gathered(rows)
    if more is not None:
        whole = whole.join(more, "seq_id", "left")
    found = drawn(whole.withColumn("token_ids", F.transform("z", lambda x: x["token_id"])))
    at = found.select("seq_id", F.explode("z").alias("_x"), "edits")
    e, pos = F.col("edits"), F.col("_x.pos")
    return at.select(
        *[F.col("seq_id") if c == "seq_id" else F.col(f"_x.{c}").alias(c) for c in rows.columns], F.array_contains(e["deleted"], pos.cast("int")).alias("is_del"),
        F.coalesce(F.get(F.filter(e["added"], lambda a: a["pos"] == pos), F.lit(0))["n"], F.lit(0)).alias("n_ins"), F.array_contains(e["replaced"], pos.cast("int")).alias("is_rep"),
    )


def edited_places(draws: Column) -> Column:
    """(pos, is_del, n_ins, is_rep) of each edited place, ascending."""

    def rows(e: Column) -> Column:
        at = F.sort_array(F.array_distinct(F.concat(e["deleted"], e["replaced"], F.transform(e["added"], lambda a: a["pos"]))))
        n = lambda p: F.coalesce(F.get(F.filter(e["added"], lambda a: a["pos"] == p), F.lit(0))["n"], F.lit(0))
        return F.transform(at, lambda p: F.struct(p.alias("pos"), F.array_contains(e["deleted"], p).alias("is_del"), n(p).alias("n_ins"), F.array_contains(e["replaced"], p).alias("is_rep")))

    return let(draws, rows)


#: A sequence's edits: places.
EDITS = "struct<deleted:array<int>,added:array<struct<pos:int,n:int>>,replaced:array<int>>"
#: Draws that a task makes at once.
_DRAWS = 1 << 19


def _top(draws: np.ndarray, n: int) -> np.ndarray:
    """Where a row has its n largest draws, ties to the smaller place; negative draws are none."""
    size = draws.shape[1]
    order = (draws << 20) + np.arange(size - 1, -1, -1)
    if n >= size:
        return draws >= 0
    if n <= 0:
        return np.zeros(draws.shape, dtype=bool)
    return (order >= np.partition(order, size - n, axis=1)[:, size - n, None]) & (draws >= 0)


def _masks_as_lists(mask: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(mask.sum(1)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(mask)[1].astype(np.int32)))


def edit_draws(seqs: DataFrame, seq_len: int, spec: EditSpec, seed: int = 0) -> DataFrame:
    """seqs (seq_id, token_ids array, ..) with edits, what sample_edits() draws for each: nothing but the sequence's own row is needed."""
    most_del, most_ins, most_rep = (math.ceil(seq_len * r) for r in (spec.del_ratio, spec.ins_ratio, spec.rep_ratio))

    def drawn(keys: list[str], ids: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = ids.shape[1]
        bits = lambda tag: numbered_bits([f"{seed}|{tag}|{k}|" for k in keys], n).astype(np.int64)
        eos = ids == spec.eos
        deleted = _top(np.where(real, bits("del"), -1), most_del) & ~eos
        able = real & ~eos & ~deleted
        able[:, 1:] &= ~deleted[:, :-1]
        added = np.zeros(ids.shape, dtype=np.int64)
        if most_ins and n:
            each = numbered_bits([f"{seed}|ins|{k}|{d}|" for k in keys for d in range(most_ins)], n).astype(np.int64).reshape(len(keys), most_ins, n)
            chosen = np.where(able[:, None, :], each, -1).argmax(2)
            some = able.any(1)
            np.add.at(added, (np.repeat(np.flatnonzero(some), most_ins), chosen[some].ravel()), 1)
        return deleted, added, _top(np.where(able & (added == 0), bits("rep"), -1), most_rep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_at, key_at = batch.schema.get_field_index("token_ids"), batch.schema.get_field_index("seq_id")
            longest = max(batch.column(ids_at).value_lengths().to_pylist(), default=0)
            step = max(1, _DRAWS // max(1, (most_ins + 2) * longest))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sizes = np.asarray(part.column(ids_at).value_lengths())
                real = np.arange(sizes.max())[None, :] < sizes[:, None]
                ids = np.full(real.shape, spec.eos, dtype=np.int64)
                ids[real] = np.asarray(part.column(ids_at).flatten())
                deleted, added, replaced = drawn([str(k) for k in part.column(key_at).to_pylist()], ids, real)
                ends = np.concatenate(([0], np.cumsum((added > 0).sum(1)))).astype(np.int32)
                counts = pa.StructArray.from_arrays([pa.array(np.nonzero(added)[1].astype(np.int32)), pa.array(added[added > 0].astype(np.int32))], ["pos", "n"])
                made = pa.StructArray.from_arrays([_masks_as_lists(deleted), pa.ListArray.from_arrays(pa.array(ends), counts), _masks_as_lists(replaced)], ["deleted", "added", "replaced"])
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "edits"])

    schema = T.StructType([*seqs.schema.fields, T.StructField("edits", T.StructType.fromDDL(f"e {EDITS}").fields[0].dataType)])
    return seqs.mapInArrow(run, schema)


def sample_edits(rows: DataFrame, seq_len: int, spec: EditSpec, seed: int = 0) -> DataFrame:
    """rows (seq_id, pos, token_id, type_id; the last token eos) with is_del, n_ins, is_rep.

    The ceil(len * ratio) largest draws are deleted, eos excepted; each insertion falls on the largest draw of its own among places
    that aren't deleted, after a deletion or eos, with repetition; replacements are the largest draws among what is left.
    A sequence's places (all of them, from 0) are gathered in one row; those who have them as an array use edit_draws().
    """
    return _edited(rows, lambda whole: edit_draws(whole, seq_len, spec, seed))


def span_edit_draws(seq: Column, ids: Column, spans: Column, seq_len: int, spec: EditSpec, min_tok: int = 1, max_tok: int = 5, seed: int = 0) -> Column:
    """sample_span_edits() of a sequence in one array with its spans (beg, end, span_rank) in another, as edits of edit_draws()."""
    share = spec.del_ratio / max(1e-9, spec.del_ratio + spec.rep_ratio)
    most = math.ceil(seq_len * spec.ins_ratio)
    none = F.array().cast("array<int>")

    def steps(own: Column) -> Column:
        inside = lambda s: F.when(s["beg"] < s["end"], F.sequence(F.greatest(s["beg"], F.lit(0)).cast("int"), (s["end"] - 1).cast("int"))).otherwise(none)
        real = lambda s: F.filter(inside(s), lambda p: F.coalesce(F.get(own, p) != spec.eos, F.lit(False)))
        kinds = F.transform(spans, lambda s: F.struct(real(s).alias("at"), (keyed_uniform(seed, "kind", seq, s["span_rank"]) < share).alias("gone")))
        return let(kinds, lambda k: F.struct(F.flatten(F.transform(F.filter(k, lambda x: x["gone"]), lambda x: x["at"])).alias("deleted"), F.flatten(F.transform(F.filter(k, lambda x: ~x["gone"]), lambda x: x["at"])).alias("replaced")))

    def runs(own: Column, edited: Column) -> Column:
        barred = lambda i: F.array_contains(edited, i) | F.array_contains(edited, i - 1) | (F.get(own, i) == spec.eos)
        free = F.filter(indices(F.size(own)), lambda i: ~barred(i))
        order = let(key_prefix(seed, "run_at", seq), lambda p: F.sort_array(F.transform(free, lambda i: F.struct(keyed_hex(p, i).alias("u"), i.alias("i")))))
        size = lambda i: (F.floor(keyed_uniform(seed, "run", seq, i) * (max_tok - min_tok + 1)) + min_tok).cast("int")
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<struct<pos:int,n:int>>").alias("out"))
        # runs are taken while all together are shorter than most: the first that isn't ends it
        add = lambda acc, i, n: F.struct((acc["total"] + n).alias("total"), F.when(acc["total"] + n < most, F.concat(acc["out"], F.array(F.struct(i.alias("pos"), n.alias("n"))))).otherwise(acc["out"]).alias("out"))
        step = lambda acc, x: F.when(acc["total"] >= most, acc).otherwise(let(size(x["i"]), lambda n: add(acc, x["i"], n)))
        return F.filter(F.aggregate(order, start, step, lambda acc: acc["out"]), lambda a: a["n"] > 0)

    def whole(own: Column) -> Column:
        return let(steps(own), lambda s: F.struct(s["deleted"].alias("deleted"), runs(own, F.concat(s["deleted"], s["replaced"])).alias("added"), s["replaced"].alias("replaced")))

    return let(ids, whole)


def sample_span_edits(rows: DataFrame, spans: DataFrame, seq_len: int, spec: EditSpec, min_tok: int = 1, max_tok: int = 5, seed: int = 0) -> DataFrame:
    """As sample_edits, each span deleted or replaced as a whole (by the two ratios) and insertions in runs of min_tok to max_tok places.

    Runs stand at keyed places that are neither edited nor right after an edited place nor eos, while all of them together are shorter than ceil(seq_len * ins_ratio)."""
    own = spans.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("span_rank", "beg", "end"))).alias("_s"))
    given = F.coalesce("_s", F.array().cast(dict(own.dtypes)["_s"]))
    return _edited(rows, lambda whole: whole.withColumn("edits", span_edit_draws(F.col("seq_id"), F.col("token_ids"), given, seq_len, spec, min_tok, max_tok, seed)), own)


def next_type(index: Column, types: Column, n: int) -> Column:
    """Type of each of n slots: that of the next slot which index names, 0 after the last."""
    pairs = F.map_from_arrays(index, types)
    back = F.aggregate(F.sequence(F.lit(n - 1), F.lit(0)), F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("o")), lambda a, i: F.struct(F.coalesce(F.element_at(pairs, i), a["t"]).alias("t"), F.concat(F.array(F.coalesce(F.element_at(pairs, i), a["t"])), a["o"]).alias("o")), lambda a: a["o"])
    return back


def edit_examples(rows: DataFrame, spec: EditSpec) -> DataFrame:
    """The encoder's, generator's and decoder's features of sample_edits' rows, one row a sequence; see edit_features()."""
    return edit_features(gathered(rows), spec)


def edit_features(whole: DataFrame, spec: EditSpec) -> DataFrame:
    """(seq_id, features) of sequences (seq_id, z), z as gathered() gives it.

    gen_inp, enc_type, enc_mask, enc_edit_label have enc_len places: kept tokens at their shifted places, mask_id where a token is
    replaced or inserted. dec_tgt, dec_inp, dec_type, dec_mask, edit_label have dec_len places: all original tokens with ins_id
    where one was inserted. gen_tgt holds replaced tokens among the masked places; dec_edit_index the deleted and replaced places.
    Masks are 1 on padding. Both sides are the sequence's places laid end to end, each behind the slots that are inserted before it.
    """
    kind = "struct<tok:int,ty:int,rep:boolean,del:boolean>"
    place = lambda x: F.struct(x["token_id"].cast("int").alias("tok"), x["type_id"].cast("int").alias("ty"), x["is_rep"].alias("rep"), x["is_del"].alias("del"))
    slot = F.lit(None).cast(kind)
    own = lambda x, shown: F.concat(F.array_repeat(slot, x["n_ins"].cast("int")), F.when(shown, F.array(place(x))).otherwise(F.array().cast(f"array<{kind}>")))
    side = lambda shown, n: F.slice(F.flatten(F.transform("z", lambda x: own(x, shown(x)))), 1, n)
    length = lambda a: F.coalesce(F.array_max(F.transform(a, lambda x, i: F.when(x.isNotNull(), i + 1))), F.lit(0))
    # slots behind the last place that is seen are padding
    trimmed = lambda a: let(a, lambda x: F.slice(x, F.lit(1), length(x)))
    out = whole.select("seq_id", trimmed(side(lambda x: ~x["is_del"], spec.enc_len)).alias("e"), trimmed(side(lambda x: F.lit(True), spec.dec_len)).alias("d"))
    fill = lambda a, f, n, pad: F.concat(F.transform(a, f), F.array_repeat(F.lit(pad), F.lit(n) - F.size(a)))
    label = lambda x, gap: F.when(x.isNull(), F.lit(gap)).when(x["rep"], F.lit(spec.rep_label)).when(x["del"], F.lit(spec.del_label)).otherwise(0)
    mask = lambda a, n: F.concat(F.array_repeat(F.lit(0), F.size(a)), F.array_repeat(F.lit(1), F.lit(n) - F.size(a)))
    at = lambda a, when: F.filter(F.transform(a, lambda x, i: F.when(when(x), i)), lambda i: i.isNotNull())
    seen = lambda a: at(a, lambda x: x.isNotNull())
    types = lambda a: F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x: x["ty"])
    out = out.withColumn("gen_inp", fill("e", lambda x: F.when(x.isNull() | x["rep"], F.lit(spec.mask_id)).otherwise(x["tok"]), spec.enc_len, spec.pad_id))
    out = out.withColumn("dec_tgt", fill("d", lambda x: F.when(x.isNull(), F.lit(spec.ins_id)).otherwise(x["tok"]), spec.dec_len, spec.pad_id))
    out = out.withColumn("gen_index", at(F.col("gen_inp"), lambda t: t == spec.mask_id)).withColumn("dec_edit_index", at(F.col("d"), lambda x: x["rep"] | x["del"]))
    d_type = let(next_type(seen("d"), types("d"), spec.dec_len), lambda t: F.concat(F.slice(t, 1, 1), F.slice(t, 1, spec.dec_len - 1)))
    replaced = lambda i: F.coalesce(F.get("e", i)["rep"], F.lit(False))
    return out.select(
        "seq_id", "gen_inp", next_type(seen("e"), types("e"), spec.enc_len).alias("enc_type"), mask("e", spec.enc_len).alias("enc_mask"),
        fill("e", lambda x: label(x, spec.ins_label), spec.enc_len, 0).alias("enc_edit_label"), "gen_index", F.transform("gen_index", lambda i: F.when(replaced(i), F.get("e", i)["tok"]).otherwise(F.lit(spec.pad_id))).alias("gen_tgt"),
        F.transform("gen_index", lambda i: replaced(i).cast("int")).alias("gen_tgt_mask"), F.concat(F.array(F.lit(spec.eos)), F.slice("dec_tgt", 1, spec.dec_len - 1)).alias("dec_inp"), "dec_tgt",
        d_type.alias("dec_type"), mask("d", spec.dec_len).alias("dec_mask"),
        fill("d", lambda x: label(x, spec.ins_label), spec.dec_len, 0).alias("edit_label"), "dec_edit_index", F.transform("dec_edit_index", lambda i: F.get("dec_tgt", i)).alias("dec_masked_tgt"),
    )


def replaced_alignment(gen_index: Column, gen_tgt_mask: Column, dec_edit_index: Column, edit_label: Column, spec: EditSpec) -> Column:
    """(place among the generator's masked tokens, place in the decoder, place among the decoder's edited tokens) of each replaced token: the
    k-th replaced token on either side is one original token; what was cut on one side has no row."""
    gen = F.filter(F.transform(gen_tgt_mask, lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())
    dec = F.filter(F.transform(dec_edit_index, lambda at, j: F.when(F.get(edit_label, at) == spec.rep_label, F.struct(at.alias("dec"), j.alias("edit")))), lambda s: s.isNotNull())
    n = F.least(F.size(gen), F.size(dec))
    return F.zip_with(F.slice(gen, F.lit(1), n), F.slice(dec, F.lit(1), n), lambda g, d: F.struct(g.alias("gen"), d["dec"].alias("dec"), d["edit"].alias("edit")))


def operations(n: int, add: list[int], delete: list[int], replace: list[int]) -> str:
    """One letter for each step: a for each token added before a place, then the place's own d, r or o."""
    steps = ["o"] * n
    for k in replace:
        steps[k] = "r"
    for k in delete:
        steps[k] = "d"
    for k in add:
        steps[k] = "a" + steps[k]
    return "".join(steps)


def redundant(n: int, add: list[int], delete: list[int], replace: list[int]) -> bool:
    """Whether fewer operations would do the same: a place both replaced and deleted, or neighbours add-replace, delete-add or add-delete."""
    gone, new = set(delete), set(add)
    return not (gone.isdisjoint(replace) and new.isdisjoint(replace) and new.isdisjoint(gone) and new.isdisjoint([k + 1 for k in gone]))


def noise(ids: list[int], ratio: float, rng, mask_id: int, ins_id: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), labels: dict[str, int] | None = None, tries: int = 10_000) -> tuple[list[int], list[int], list[int], list[int]]:
    """(encoder ids, encoder labels, decoder ids, decoder labels): int(len * ratio) operations, shared at random by weights for adding,
    deleting and replacing and drawn again while redundant (after tries, none). The encoder sees mask_id for added and replaced tokens and no
    deleted ones; the decoder sees all originals and ins_id for added ones. labels: by step letter."""
    labels = labels or {"o": 0, "a": 1, "d": 2, "r": 3}
    size, total = len(ids), int(len(ids) * ratio)
    share = [rng.random() * w for w in weights]
    n_add, n_del = (int(total * s / (sum(share) or 1.0)) for s in share[:2])
    steps = "o" * size
    for _ in range(tries if size else 0):
        replace, delete = (rng.choice(size, n, replace=False).tolist() for n in (total - n_add - n_del, n_del))
        add = rng.integers(0, size, n_add).tolist()
        if not redundant(size, add, delete, replace):
            steps = operations(size, add, delete, replace)
            break
    token = iter(ids)
    tape = [(step, ins_id if step == "a" else next(token)) for step in steps]
    enc = [(mask_id if step in "ar" else t, labels[step]) for step, t in tape if step != "d"]
    return [t for t, _ in enc], [x for _, x in enc], [t for _, t in tape], [labels[step] for step, _ in tape]


def noisy(seqs: DataFrame, ratio: float, mask_id: int, ins_id: int, seed: int = 0) -> DataFrame:
    """noise() of each (seq_id, token_ids), keyed by seq_id: (seq_id, enc_ids, enc_labels, dec_ids, dec_labels)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for part in batches:
            rows = [noise(list(map(int, ids)), ratio, np.random.default_rng([seed, int(s) & 0xFFFFFFFF]), mask_id, ins_id) for s, ids in zip(part["seq_id"], part["token_ids"], strict=True)]
            yield pd.DataFrame({"seq_id": part["seq_id"], **{c: [r[k] for r in rows] for k, c in enumerate(("enc_ids", "enc_labels", "dec_ids", "dec_labels"))}})

    return seqs.select(F.col("seq_id").cast("long").alias("seq_id"), "token_ids").mapInPandas(run, "seq_id long, enc_ids array<int>, enc_labels array<int>, dec_ids array<int>, dec_labels array<int>")
