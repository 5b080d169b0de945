"""Renormalisation of next-piece distributions to what can spell a word of the vocabulary."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corploom.operators.tables import written


def word_pieces(lines: DataFrame, vocab: DataFrame, unk_id: int | None = None) -> DataFrame:
    """(word, pieces array<int>) from lines 'word<TAB>piece piece ..'; an unknown piece is unk_id, or raises without one."""
    parts = F.split("line", "\t", -1)
    rows = lines.where(F.size(parts) >= 2).select(F.element_at(parts, 1).alias("word"), F.posexplode(F.filter(F.split(F.element_at(parts, 2), " +"), lambda p: p != "")).alias("pos", "token"))
    known = rows.join(vocab.select("token", "token_id"), "token", "left")
    if unk_id is not None:
        known = known.withColumn("token_id", F.coalesce("token_id", F.lit(unk_id)))
    else:
        known = known.withColumn("token_id", F.when(F.col("token_id").isNotNull(), F.col("token_id")).otherwise(F.raise_error(F.concat(F.lit("no such piece: "), F.col("token"))).cast("int")))
    return known.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda s: s["token_id"]).alias("pieces"))


def flags(words: DataFrame, specials: list[int] = ()) -> DataFrame:
    """(token_id, is_head, is_end): first and last pieces of words; specials are both."""
    heads = words.select(F.element_at("pieces", 1).alias("token_id"), F.lit(1).alias("h"), F.lit(0).alias("e"))
    ends = words.select(F.element_at("pieces", -1).alias("token_id"), F.lit(0).alias("h"), F.lit(1).alias("e"))
    both = heads.unionByName(ends)
    if specials:
        both = both.unionByName(words.sparkSession.createDataFrame([(s, 1, 1) for s in specials], "token_id int, h int, e int"))
    return both.groupBy("token_id").agg(F.max("h").alias("is_head"), F.max("e").alias("is_end"))


def prefixes(words: DataFrame, specials: list[int] = ()) -> DataFrame:
    """(prefix array<int>, next_token): every step from a prefix of a word (the empty one too); from every whole word, specials;
    from a special alone, all heads."""
    steps = words.select(F.explode(F.sequence(F.lit(0), F.size("pieces") - 1)).alias("k"), "pieces").select(F.slice("pieces", 1, F.col("k")).alias("prefix"), F.get("pieces", F.col("k")).alias("next_token"))
    out = steps
    if specials:
        every = F.explode(F.array(*map(F.lit, specials)))
        out = out.unionByName(words.select(F.col("pieces").alias("prefix"), every.alias("next_token")))
        out = out.unionByName(words.select(F.element_at("pieces", 1).alias("next_token"), every.alias("s")).distinct().select(F.array("s").alias("prefix"), "next_token"))
    return out.distinct()


def duplicate_spellings(words: DataFrame) -> DataFrame:
    """(pieces, words): spellings that more than one word has."""
    return words.groupBy("pieces").agg(F.array_sort(F.collect_list("word")).alias("words")).where(F.size("words") > 1)


def steps_by_prefix(words: DataFrame, flag: DataFrame, specials: list[int] = (), leaves: bool = True) -> DataFrame:
    """(prefix, next, ended) of every prefix and whole word: the tokens that go on, ascending, and whether the prefix's last piece is an end.
    Without leaves, of what goes on only."""
    steps = prefixes(words, specials)
    if leaves:
        steps = steps.unionByName(words.select(F.col("pieces").alias("prefix"), F.lit(None).cast("int").alias("next_token")))
    steps = steps.groupBy("prefix").agg(F.sort_array(F.collect_set("next_token")).alias("next"))
    ends = F.broadcast(flag.where("is_end = 1").select(F.col("token_id").alias("_last"), F.lit(1).alias("_end")))  # at most a vocabulary of pieces
    marked = steps.withColumn("_last", F.get("prefix", F.size("prefix") - 1)).join(ends, "_last", "left")
    return marked.select("prefix", "next", F.coalesce("_end", F.lit(0)).alias("ended"))


#: Places of a stream that one row of blocks() holds.
BLOCK = 4096
_SEED, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _longest(words: DataFrame) -> int:
    return words.agg(F.max(F.size("pieces"))).first()[0] or 0


def _run_keys(ids: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """A 64-bit key of each run's ids up to every place of ids, runs one behind the other, place counted from a run's start; 0 where that is more than most ids."""
    h = np.zeros(len(ids), dtype=np.uint64)
    some = np.flatnonzero(place == 0)
    k = 0
    while len(some) and k < most:
        x = ((h[some - 1] if k else _SEED) + ids[some].astype(np.uint64) + np.uint64(1)) * _STEP
        x ^= x >> np.uint64(29)
        h[some] = x * _SEED
        k += 1
        some = some[some + 1 < len(ids)] + 1
        some = some[place[some] == k]
    return h.view(np.int64)


def _prefix_keys(sets: DataFrame, other: str) -> DataFrame:
    """(key, other) of rows (prefix, other)."""
    kind = dict(sets.dtypes)[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = np.asarray(batch.column(0).flatten(), dtype=np.int64), np.asarray(batch.column(0).value_lengths(), dtype=np.int64)
            ends = np.cumsum(sizes)
            keys = np.full(len(sizes), _SEED, dtype=np.uint64).view(np.int64)  # of the empty prefix
            some = np.flatnonzero(sizes)
            keys[some] = _run_keys(flat, np.arange(len(flat)) - np.repeat(ends - sizes, sizes), int(sizes.max(initial=0)))[ends[some] - 1]
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(1)], names=["key", other])

    return sets.select("prefix", other).mapInArrow(run, f"key long, {other} {kind}")


def blocks(inputs: DataFrame, flag: DataFrame, reach: int, by_end: bool = False, size: int = BLOCK) -> DataFrame:
    """(b, at, lead, first, ids, targets): streams (b, t, input[, target]), t without gaps, in blocks of size places behind lead earlier ones.

    A piece's state depends on reach places before it at the most, and on whether its stream has seen any head (or end) before: first is the
    place of the first one, null without. So blocks of one stream need not wait for each other, and no task sees a whole stream.
    """
    size = max(size, reach)
    mark = F.broadcast(flag.where("is_end = 1" if by_end else "is_head = 1").select(F.col("token_id").alias("input")))  # at most a vocabulary of pieces
    first = inputs.join(mark, "input", "left_semi").groupBy("b").agg(F.min("t").cast("long").alias("first"))
    number = F.floor(F.col("t") / size).cast("long")
    twice = F.explode(F.when(F.col("t") % size >= size - reach, F.array(number, number + 1)).otherwise(F.array(number)))
    target = F.col("target") if "target" in inputs.columns else F.lit(None)
    rows = inputs.select("b", F.struct(F.col("t").cast("long").alias("t"), "input", target.cast("int").alias("target")).alias("z"), twice.alias("block"))
    whole = rows.groupBy("b", "block").agg(F.array_sort(F.collect_list("z")).alias("z"))
    lead = F.size(F.filter("z", lambda x: x["t"] < F.col("block") * size))
    cut = whole.select("b", F.col("z")[0]["t"].alias("at"), lead.alias("lead"), F.col("z.input").alias("ids"), F.col("z.target").alias("targets")).where("lead < size(ids)")
    return cut.join(first, "b", "left").select("b", "at", "lead", F.coalesce("first", F.lit(2**62)).alias("first"), "ids", "targets")


def array_blocks(rows: DataFrame, ids: str) -> DataFrame:
    """As blocks(), of whole streams (b, ids) that are one array each; a place's target is the next id."""
    after = F.slice(ids, F.lit(2), F.size(ids))
    return rows.select("b", F.lit(0).cast("long").alias("at"), F.lit(0).alias("lead"), F.lit(None).cast("long").alias("first"), F.col(ids).alias("ids"), after.alias("targets"))


class _Places(NamedTuple):
    """Places of some rows of blocks; row is the number of a place's row."""

    row: np.ndarray
    t: np.ndarray
    input: np.ndarray
    target: pa.Array
    key: np.ndarray
    free: np.ndarray
    ended: np.ndarray


#: Places of blocks that are worked on at once; a row has more if it is longer.
PLACES = 1 << 16


def _reader(flag: DataFrame, longest: int, by_end: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.Array, _Places]]]:
    """What tasks read batches of blocks (b, at, lead, first, ids, targets) with: (b, places) of some rows at a time, as run_keys() has them."""
    listed = flag.toLocalIterator()  # at most a vocabulary of pieces
    marked = [(r["token_id"], r["is_head"], r["is_end"]) for r in listed]
    top = max((x[0] for x in marked), default=0) + 2
    heads, ends = (np.array([x[0] for x in marked if x[k]], dtype=np.int64) for k in (1, 2))
    reach = longest + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, _Places]]:
        is_head, is_end = np.zeros(top, dtype=bool), np.zeros(top, dtype=bool)
        is_head[heads] = True
        is_end[ends] = True
        for batch in batches:
            total = np.cumsum(np.asarray(batch.column(4).value_lengths(), dtype=np.int64))
            at = 0
            while at < len(total):
                past = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PLACES, side="right")))
                part = batch.slice(at, past - at)
                at = past
                places = _places(part, is_head, is_end, reach, by_end)
                if len(places.row):
                    yield part.column(0), places

    return read


def _places(part: pa.RecordBatch, is_head: np.ndarray, is_end: np.ndarray, reach: int, by_end: bool) -> _Places:
    at, lead = (np.asarray(part.column(c), dtype=np.int64) for c in (1, 2))
    sizes = np.asarray(part.column(4).value_lengths(), dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    ids = np.asarray(part.column(4).flatten(), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    every = np.arange(len(ids))
    own = np.minimum(ids, len(is_head) - 1)
    ended = is_end[own]
    mark = ended if by_end else is_head[own]
    begins = np.concatenate(([True], ended))[: len(ids)] if by_end else mark.copy()
    begins[begin[sizes > 0]] = True
    place = every - np.maximum.accumulate(np.where(begins, every, 0))
    marks = np.append(np.flatnonzero(mark), len(ids))
    found = marks[np.searchsorted(marks[:-1], begin)] - begin  # of rows whose first mark isn't given; none without one
    first = np.where(np.asarray(part.column(3).is_valid()), np.asarray(part.column(3).fill_null(0)), np.minimum(found, sizes))
    t = every - np.repeat(begin - at, sizes)
    free = t <= first[row] if by_end else t < first[row]
    # a place's target stands at the same place of its row; rows without as many end in none
    given = np.asarray(part.column(5).value_lengths(), dtype=np.int64)
    targets = part.column(5).flatten()
    to = np.arange(len(targets)) + np.repeat(begin - (np.cumsum(given) - given), given)
    target, known = np.zeros(len(ids), dtype=np.int32), np.zeros(len(ids), dtype=bool)
    target[to], known[to] = np.asarray(targets.fill_null(0)), np.asarray(targets.is_valid())
    key = _run_keys(ids, place, reach)
    out = _Places(row, t.astype(np.int32), ids.astype(np.int32), pa.array(target, mask=~known), key, free, ended)
    if not lead.any():
        return out
    kept = np.flatnonzero(every - np.repeat(begin, sizes) >= lead[row])
    return _Places(*(x.take(pa.array(kept)) if isinstance(x, pa.Array) else x[kept] for x in out))


def run_keys(cut: DataFrame, flag: DataFrame, longest: int, by_end: bool = False) -> DataFrame:
    """(b, t, input, target, key, free, ended) of every place of blocks: key names the pieces since the last head, or since the last end piece before;
    it is 0 where they are more than any word and a special have. free: no head (end) has come yet; ended: the piece is an end."""
    read = _reader(flag, longest, by_end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in read(batches):
            columns = [b.take(pa.array(x.row)), pa.array(x.t), pa.array(x.input), x.target, pa.array(x.key), pa.array(x.free.astype(np.int32)), pa.array(x.ended.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["b", "t", "input", "target", "key", "free", "ended"])

    return cut.select("b", "at", "lead", "first", "ids", "targets").mapInArrow(run, f"b {dict(cut.dtypes)['b']}, t int, input int, target int, key long, free int, ended int")


def set_number(tokens: Column) -> Column:
    """The number of a set of tokens, an ascending array: 60 bits of the md5 of its list."""
    return F.conv(F.substring(F.md5(F.array_join(tokens, ",").cast("binary")), 1, 15), 16, 10).cast("long")


def numbered_sets(words: DataFrame, flag: DataFrame, specials: list[int] = ()) -> tuple[DataFrame, DataFrame]:
    """((key, set_id) of every prefix that goes on, (set_id, allowed) of every different set, that of all heads and the empty one included). A whole word that
    doesn't go on needs no row: candidates() gives its end piece all heads, another nothing. So there are as many rows as a trie has inner nodes, however many words."""
    steps = written(steps_by_prefix(words, flag, specials, leaves=False))
    # many prefixes go on alike: what heads add is worked out once for all of them
    heads = F.broadcast(flag.where("is_head = 1").agg(F.collect_list("token_id").alias("_heads")))  # one row
    none = words.sparkSession.createDataFrame([([], 0), ([], 1)], "next array<int>, ended int")
    kinds = steps.select("next", "ended").unionByName(none).distinct().crossJoin(heads)
    allowed = F.sort_array(F.when(F.col("ended") == 1, F.array_union("next", "_heads")).otherwise(F.col("next")))
    kinds = written(kinds.select("next", "ended", allowed.alias("allowed")).withColumn("set_id", set_number(F.col("allowed"))))
    numbered = steps.join(kinds.select("next", "ended", "set_id"), ["next", "ended"]).select("prefix", "set_id")
    return written(_prefix_keys(numbered, "set_id")), kinds.select("set_id", "allowed").dropDuplicates(["set_id"])


#: Up to so many rows a dictionary is sent to all tasks, and places stay where they are.
BROADCAST_ROWS = 4_000_000


def meet(places: DataFrame, dictionary: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """places with dictionary's columns, nulls without a row: a dictionary of at most most rows (counted) is broadcast, beyond that both sides are shuffled."""
    few = dictionary.select(key).limit(most + 1).count() <= most
    return places.join(F.broadcast(dictionary) if few else dictionary, key, "left")


def candidates(places: DataFrame, by_key: DataFrame, flag: DataFrame) -> DataFrame:
    """(b, t, input, target, set_id) of run_keys' places: the number of the set of pieces that may come next. null where anything may, before the first
    head or end; all heads where an end piece ends what spells no word; nothing where other pieces spell no prefix."""
    heads = sorted(r["token_id"] for r in flag.where("is_head = 1").select("token_id").toLocalIterator())  # at most a vocabulary of pieces
    number = lambda tokens: int(hashlib.md5(",".join(map(str, tokens)).encode()).hexdigest()[:15], 16)
    found = meet(places, by_key, "key")
    other = F.when(F.col("ended") == 1, F.lit(number(heads))).otherwise(F.lit(number([])))
    return found.select("b", "t", "input", "target", F.when(F.col("free") == 0, F.coalesce("set_id", other)).alias("set_id"))


def bitmaps(dictionary: DataFrame, n_tokens: int) -> DataFrame:
    """(set_id, bitmap) of (set_id, allowed): bit k of byte j is token 8 j + k, for n_tokens tokens."""
    width = -(-n_tokens // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 2**24 // (8 * width))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sizes = np.asarray(part.column(1).value_lengths().fill_null(0), dtype=np.int64)
                on = np.zeros((part.num_rows, 8 * width), dtype=bool)
                on[np.repeat(np.arange(part.num_rows), sizes), np.asarray(part.column(1).flatten(), dtype=np.int64)] = True
                bits = np.packbits(on, axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([row.tobytes() for row in bits], type=pa.binary())], names=["set_id", "bitmap"])

    return dictionary.select("set_id", "allowed").mapInArrow(run, f"set_id {dict(dictionary.dtypes)['set_id']}, bitmap binary")


def _plain_nll(logit: Callable, b: np.ndarray, t: np.ndarray, target: np.ndarray, on: np.ndarray) -> np.ndarray:
    """-log softmax of each row over the tokens that are on: no other logit is made."""
    row, token = np.nonzero(on)
    x = logit(b[row], t[row], token)
    nll = np.full(len(b), np.inf)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    if len(starts):
        some = row[starts]
        top = np.maximum.reduceat(x, starts)
        total = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(starts, len(row))))), starts)
        norm = np.full(len(b), np.inf)
        norm[some] = top + np.log(total)
        own = np.flatnonzero(token == target[row])
        nll[row[own]] = norm[row[own]] - x[own]
    return nll


def _joined_bytes(column: pa.BinaryArray) -> np.ndarray:
    """The bytes of all values, none of them null, one behind the other: no Python object is made for a value."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]


#: Logits of a table of distinct distributions that each task makes.
TABLE_LOGITS = 4_000_000


def nll_of_candidates(rows: DataFrame, maps: DataFrame, logit: Callable[..., np.ndarray], n_tokens: int, state: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, states: int = 0) -> DataFrame:
    """(b, t, nll) of rows (b, t, target, set_id) and bitmaps: -log softmax over the set's tokens only, infinite where the target isn't one of them; a null
    set allows all. logit(b, t, token) of arrays gives the logits of allowed tokens; others are never made.

    state(b, t), from 0 to states - 1, if places of the same state have the same logits, then logit(state, token): each state's are made once a task, and a
    place adds up exponentials of its state's row. What vanishes beside the row's largest logit is added up by itself.
    """
    if states * n_tokens > TABLE_LOGITS:
        raise ValueError("too many states for a table of their logits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 2**17 // n_tokens)  # what fits in a cache
        if state is not None:
            every = np.asarray(logit(np.arange(states)[:, None], np.arange(n_tokens)[None, :]), dtype=np.float64)
            top = every.max(axis=1)
            weight = np.exp(every - top[:, None])
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                b, t, target = (np.asarray(part.column(k)) for k in range(3))
                bits = np.full((len(b), -(-n_tokens // 8)), 255, dtype=np.uint8)
                given = np.flatnonzero(np.asarray(part.column(3).is_valid()))
                if len(given):
                    bits[given] = _joined_bytes(part.column(3).drop_null()).reshape(len(given), -1)
                on = np.unpackbits(bits, axis=1, count=n_tokens, bitorder="little")
                if state is None:
                    nll = _plain_nll(logit, b, t, target, on)
                else:
                    own = state(b, t)
                    total = np.einsum("ij,ij->i", np.take(weight, own, axis=0), on.astype(np.float64))
                    place = np.clip(target, 0, n_tokens - 1).astype(np.int64)
                    among = (place == target) & (on[np.arange(len(b)), place] > 0)
                    nll = np.full(len(b), np.inf)
                    sure = np.flatnonzero(among & (total > 1e-200))
                    nll[sure] = top[own[sure]] + np.log(total[sure]) - every[own[sure], place[sure]]
                    rest = np.flatnonzero(among & (total <= 1e-200))
                    if len(rest):
                        nll[rest] = _plain_nll(lambda b, t, token: logit(state(b, t), token), b[rest], t[rest], target[rest], on[rest])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nll)], names=["b", "t", "nll"])

    kinds = dict(rows.dtypes)
    few = maps.agg(F.sum(F.octet_length("bitmap"))).first()[0] or 0
    joined = rows.join(F.broadcast(maps) if few <= 64 << 20 else maps, "set_id", "left")
    return joined.select("b", "t", "target", "bitmap").mapInArrow(run, f"b {kinds['b']}, t {kinds['t']}, nll double")


#: Bytes of bitmaps that nll_of_blocks sends to all tasks.
BITMAP_BYTES = 64 << 20


def _bit_classes(bits: np.ndarray, n_tokens: int) -> np.ndarray:
    """The class of each token: tokens of one class are in the same sets, of bitmaps (sets, bytes)."""
    kind = np.zeros(n_tokens, dtype=np.int64)
    for at in range(0, len(bits), 8192):
        columns = np.packbits(np.unpackbits(bits[at : at + 8192], axis=1, count=n_tokens, bitorder="little").T, axis=1)
        _, kind = np.unique(np.column_stack([kind.astype(">u4").view(np.uint8).reshape(n_tokens, 4), columns]), axis=0, return_inverse=True)
        kind = kind.reshape(-1)
    return kind


class _Lookup:
    """Rows of keys, spread 64-bit numbers without repeats, by their leading bits."""

    def __init__(self, keys: np.ndarray):
        whole = keys.view(np.uint64)
        self.order = np.argsort(whole)
        self.keys = np.append(whole[self.order], np.uint64(0))
        self.shift = np.uint64(64 - max(1, (2 * len(keys)).bit_length()))
        self.start = np.searchsorted(self.keys[:-1] >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in self.order, -1 without."""
        whole = keys.view(np.uint64)
        bucket = (whole >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.full(len(keys), -1, dtype=np.int32)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            hit = self.keys[at[open_]] == whole[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x as Spark's round() has it: half up, of the shortest decimal that names a number."""
    finite = np.isfinite(x)
    by = np.where(finite, np.abs(x), 0.0) * 10.0**digits
    out = np.where(finite, np.copysign(np.floor(by + 0.5) / 10.0**digits, x) + 0.0, x)
    near = np.flatnonzero((np.abs(by - np.floor(by) - 0.5) < 1e-3) | (by > 1e11))
    unit = Decimal(1).scaleb(-digits)
    out[near] = [float(Decimal(repr(float(v))).quantize(unit, rounding=ROUND_HALF_UP, context=_DIGITS)) + 0.0 for v in x[near]]
    return out


_DIGITS = Context(prec=400)


def nll_of_blocks(cut: DataFrame, by_key: DataFrame, maps: DataFrame, flag: DataFrame, longest: int, logit: Callable[..., np.ndarray], n_tokens: int, state: Callable[[np.ndarray, np.ndarray], np.ndarray], states: int,
                  digits: int, by_end: bool = False, most: int = BROADCAST_ROWS) -> DataFrame:
    """(b, t, nll) of the places of blocks that have a target, rounded: nll_of_candidates(candidates(run_keys(cut, ..)), ..) in one step, without a row for a
    place but the result's. The dictionary goes to all tasks; with more than most keys, or bitmaps beyond BITMAP_BYTES, places meet it by joins.

    Tokens that are in the same sets count as one, the sum of their exponentials, and a state's sums of every eight of these are a table of 256 entries.
    """
    width = -(-n_tokens // 8)
    if by_key.limit(most + 1).count() > most or maps.count() * width > BITMAP_BYTES:
        rows = candidates(run_keys(cut, flag, longest, by_end), by_key, flag).where("target IS NOT NULL")
        return nll_of_candidates(rows, maps, logit, n_tokens, state, states).withColumn("nll", F.round("nll", digits))
    if states * n_tokens > TABLE_LOGITS:
        raise ValueError("too many states for a table of their logits")
    steps, sets = by_key.select("key", "set_id").toArrow(), maps.select("set_id", "bitmap").toArrow()  # bounded by the counts above
    numbers = np.asarray(sets["set_id"])
    order = np.argsort(numbers)
    bits = np.frombuffer(b"".join(sets["bitmap"].to_pylist()), dtype=np.uint8).reshape(len(numbers), width)[order]
    heads = [r["token_id"] for r in flag.where("is_head = 1").select("token_id").toLocalIterator()]
    others = np.zeros((3, n_tokens), dtype=bool)  # where pieces spell no prefix: nothing, all heads after an end, all tokens before the first head or end
    others[1, heads], others[2] = True, True
    bits = np.concatenate([bits, np.packbits(others, axis=1, bitorder="little")])
    kind = _bit_classes(bits, n_tokens)
    one = np.unique(kind, return_index=True)[1]
    small = np.concatenate([np.packbits(np.unpackbits(bits[at : at + 8192], axis=1, bitorder="little")[:, one], axis=1, bitorder="little") for at in range(0, len(bits), 8192)])
    keys = np.asarray(steps["key"])
    shared = cut.sparkSession.sparkContext.broadcast((keys, np.searchsorted(numbers[order], np.asarray(steps["set_id"])).astype(np.int32), small))
    n_sets, n_bytes = len(numbers), small.shape[1]
    read = _reader(flag, longest, by_end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, set_of, small = shared.value
        lookup = _Lookup(keys)
        set_of = np.append(set_of[lookup.order], np.int32(0))
        every = np.asarray(logit(np.arange(states)[:, None], np.arange(n_tokens)[None, :]), dtype=np.float64)
        top = every.max(axis=1)
        weight = np.zeros((states, 8 * n_bytes))
        np.add.at(weight.T, kind, np.exp(every - top[:, None]).T)
        tables = np.zeros((n_bytes, states, 256))
        for j in range(n_bytes):
            for k in range(8):
                tables[j, :, 1 << k : 2 << k] = tables[j, :, : 1 << k] + weight[:, 8 * j + k, None]
        tables = tables.reshape(n_bytes, states * 256)
        for b, x in read(batches):
            has = np.flatnonzero(np.asarray(x.target.is_valid()))
            place = lookup.find(x.key[has])
            number = np.where(place >= 0, set_of[place], np.where(x.ended[has], n_sets + 1, n_sets))
            number[x.free[has]] = n_sets + 2
            t, target, row = x.t[has], np.asarray(x.target.fill_null(0))[has].astype(np.int64), x.row[has]
            names = b.take(pa.array(row))
            own = state(np.asarray(b)[row], t)
            held = np.ascontiguousarray(small[number].T)
            total = np.zeros(len(has))
            for j in range(n_bytes):
                total += tables[j].take(own * 256 + held[j])
            known = (target >= 0) & (target < n_tokens)
            target = np.where(known, target, 0)
            bit = kind[target]
            among = known & (held[bit >> 3, np.arange(len(has))] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            nll = np.full(len(has), np.inf)
            sure = np.flatnonzero(among & (total > 1e-200))
            nll[sure] = top[own[sure]] + np.log(total[sure]) - every[own[sure], target[sure]]
            rest = np.flatnonzero(among & (total <= 1e-200))
            for at in range(0, len(rest), 256):
                some = rest[at : at + 256]
                on = np.unpackbits(small[number[some]], axis=1, bitorder="little")[:, kind]
                nll[some] = _plain_nll(lambda s, t, token: logit(s, token), own[some], t[some], target[some], on)
            yield pa.RecordBatch.from_arrays([names, pa.array(t), pa.array(_rounded(nll, digits))], names=["b", "t", "nll"])

    return cut.select("b", "at", "lead", "first", "ids", "targets").mapInArrow(run, f"b {dict(cut.dtypes)['b']}, t int, nll double")


def allowed_sets(inputs: DataFrame, words: DataFrame, flag: DataFrame, specials: list[int] = (), by_end: bool = False) -> DataFrame:
    """(b, t, allowed): the tokens of allowed_next in one array, null where anything may come."""
    by_key, dictionary = numbered_sets(words, flag, specials)
    longest = _longest(words)
    rows = candidates(run_keys(blocks(inputs, flag, longest + 1, by_end), flag, longest, by_end), by_key, flag)
    return meet(rows, dictionary, "set_id", BROADCAST_ROWS // 200).select("b", "t", "allowed")  # a row is a whole set


def allowed_next(inputs: DataFrame, words: DataFrame, flag: DataFrame, specials: list[int] = ()) -> DataFrame:
    """(b, t, next_token, any_token) for inputs (b, t, input) with unique heads: the steps that the pieces since the last head allow, after an
    end piece also all heads; any_token is 1, with next_token null, where no head has been seen."""
    return _exploded(allowed_sets(inputs, words, flag, specials))


def _exploded(sets: DataFrame) -> DataFrame:
    return sets.select("b", "t", F.explode_outer("allowed").alias("next_token"), F.col("allowed").isNull().cast("int").alias("any_token")).where("any_token = 1 OR next_token IS NOT NULL")


def allowed_next_by_end(inputs: DataFrame, words: DataFrame, specials: list[int] = ()) -> DataFrame:
    """allowed_next for vocabularies with unique ends: a word starts after an end piece, and anything may come up to the first one."""
    return _exploded(allowed_sets(inputs, words, flags(words, specials), specials, by_end=True))


def renormalised_nll(logits: DataFrame, targets: DataFrame, allowed: DataFrame) -> DataFrame:
    """(b, t, nll): -log softmax over allowed tokens only, of long logits (b, t, token_id, logit) at targets (b, t, target); infinite where the target isn't allowed."""
    free = allowed.where("any_token = 1").select("b", "t", F.lit(1).alias("_free"))
    ok = allowed.where("any_token = 0").select("b", "t", F.col("next_token").alias("token_id"), F.lit(1).alias("_ok"))
    kept = logits.join(free, ["b", "t"], "left").join(ok, ["b", "t", "token_id"], "left").where("_free = 1 OR _ok = 1")
    joined = kept.join(targets, ["b", "t"])
    w = Window.partitionBy("b", "t")
    scored = joined.withColumn("_m", F.max("logit").over(w))
    sums = scored.groupBy("b", "t").agg((F.first("_m") + F.log(F.sum(F.exp(F.col("logit") - F.col("_m"))))).alias("norm"), F.max(F.when(F.col("token_id") == F.col("target"), F.col("logit"))).alias("x"))
    return sums.select("b", "t", F.coalesce(F.col("norm") - F.col("x"), F.lit(float("inf"))).alias("nll"))
