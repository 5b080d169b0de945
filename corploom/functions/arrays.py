"""Array functions of example building: masks, shifts, scatters, positions."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value worked out once a row: Spark puts an expression that is named once where the name stands, be it
    inside a lambda, and there would work it out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column) -> Column:
    """[0 .. n-1], empty for n <= 0 (sequence alone would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def pad(a: Column, n: int, filler: object = 0) -> Column:
    """a to length n; a longer one stays whole."""
    return F.concat(a, F.array_repeat(F.lit(filler), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def shift_right(a: Column, first: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.array(first), F.slice(a, 1, F.size(a) - 1))).otherwise(a)


def rotate_left(a: Column) -> Column:
    """The first element goes to the end."""
    return F.when(F.size(a) > 1, F.concat(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, 1))).otherwise(a)


def boolean_mask(a: Column, mask: Column) -> Column:
    """Elements of a where mask holds, in order."""
    return F.transform(F.filter(F.arrays_zip(a.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])


def gather(a: Column, at: Column) -> Column:
    """a[i] for each i of at (from 0)."""
    return F.transform(at, lambda i: F.get(a, i))


def scatter(at: Column, values: Column, n: Column, default: object = 0) -> Column:
    """Length n with values at the places at, default elsewhere and for nulls. Sorted places and the gaps before them: no place is searched for."""
    pairs = F.filter(F.arrays_zip(at.alias("at"), values.alias("v")), lambda z: (z["at"] >= 0) & (z["at"] < n))

    def gap(z: Column, before: Column) -> Column:
        size = (z["at"] - before - 1).cast("int")
        twice = F.raise_error(F.concat(F.lit("a place has two values: "), z["at"].cast("string"))).cast("int")
        return F.array_repeat(F.lit(default), F.when(size < 0, twice).otherwise(size))

    def filled(s: Column) -> Column:
        runs = F.transform(s, lambda z, i: F.concat(gap(z, F.when(i > 0, F.get(s, i - 1)["at"]).otherwise(F.lit(-1))), F.array(F.coalesce(z["v"], F.lit(default)))))
        last = F.coalesce(F.get(s, F.size(s) - 1)["at"], F.lit(-1))
        return F.concat(F.flatten(runs), F.array_repeat(F.lit(default), F.greatest(n - 1 - last, F.lit(0)).cast("int")))

    return let(F.sort_array(pairs), filled)


def cumulative(a: Column, exclusive: bool = False) -> Column:
    """Running sums of a, each with or without its own element, in one pass."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))
    if exclusive:
        step = lambda acc, x: F.struct((acc["s"] + x).cast("long").alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
    else:
        step = lambda acc, x: F.struct((acc["s"] + x).cast("long").alias("s"), F.concat(acc["out"], F.array((acc["s"] + x).cast("long"))).alias("out"))
    return F.aggregate(a, start, step, lambda acc: acc["out"])


def causal_mask(q_len: Column, m_len: Column, same_length: bool = False) -> Column:
    """[i][j] is 1 where query i may not look at key j of m_len memory and q_len own keys: j - m_len > i; same_length also hides j < i."""
    def cell(i: Column, j: Column) -> Column:
        hidden = (j - m_len) > i
        if same_length:
            hidden = hidden | (j < i)
        return hidden.cast("int")

    return F.transform(indices(q_len), lambda i: F.transform(indices(q_len + m_len), lambda j: cell(i, j)))


def merge_masks(a: Column, b: Column) -> Column:
    """Hidden in either."""
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: F.greatest(p, q)))


def segment_mask(q_seg: Column, k_seg: Column, causal: bool = False) -> Column:
    """[i][j] is 1 where segments differ, or also where j > i."""
    rows = F.transform(indices(F.size(q_seg)), lambda i: F.transform(indices(F.size(k_seg)), lambda j: ((F.get(q_seg, i) != F.get(k_seg, j)) | ((j > i) if causal else F.lit(False))).cast("int")))
    return rows


def local_mask(i: Column, j: Column, chunk: int) -> Column:
    """Whether key j is hidden from query i when a query sees its own chunk and its two neighbours."""
    return (F.abs(F.floor(i / chunk) - F.floor(j / chunk)) > 1).cast("int")


def rel_shift(rows: Column, padded: bool = False) -> Column:
    """y[i][j] = x[i][j + R - i] for R rows, j from 0 while the source exists (R - i - 1 for the padded layout)."""
    n = F.size(rows)
    extra = 1 if padded else 0
    return F.transform(rows, lambda r, i: F.slice(r, (n - i - extra + 1).cast("int"), F.greatest(F.size(r) - n, F.lit(0)) + extra))


def sinusoid(position: Column, width: int, clamp: float | None = None) -> Column:
    """sin of all frequencies, then cos; frequency k is 10000 ** (-2 k / width)."""
    p = F.least(position, F.lit(clamp)) if clamp else position
    freq = [10000.0 ** (-2.0 * k / width) for k in range(width // 2)]
    return F.array(*[F.sin(p * f) for f in freq], *[F.cos(p * f) for f in freq])


def gelu(x: Column) -> Column:
    return x * 0.5 * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def gelu_erf(x: Column) -> Column:
    """The exact form; Spark has no erf."""
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else 0.5 * v * (1 + math.erf(v / math.sqrt(2))))

    return run(x.cast("double"))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0).cast("double"))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(a, lambda x: F.exp(x - top) / total)


def top_k(a: Column, k: int) -> Column:
    """Places of the k largest elements, larger first, ties to the smaller place."""
    ranked = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def segment_sizes(segment: Column) -> Column:
    """Map from each segment to its number of places, without 0."""
    ids = F.array_sort(F.array_distinct(F.filter(segment, lambda s: s != 0)))
    return F.map_from_arrays(ids, F.transform(ids, lambda k: F.size(F.filter(segment, lambda s: s == k))))


def log_softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return F.transform(a, lambda x: x - top - total)


def layer_norm(a: Column, epsilon: float = 1e-12) -> Column:
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.transform(a, lambda x: (x - mean) / F.sqrt(var + epsilon))


def shifted_target(tokens: Column, segment: Column, pad_id: int, eos: int) -> tuple[Column, Column]:
    """(target, loss mask): pads become eos, everything one place to the left with wraparound, mask where segment isn't 0."""
    filled = F.transform(tokens, lambda t: F.when(t == pad_id, F.lit(eos)).otherwise(t))
    return rotate_left(filled), F.transform(segment, lambda s: (s != 0).cast("int"))
