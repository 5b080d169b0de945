"""Packing of multi-key sequences: a queue of open bins, segments and positions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.functions.arrays import indices

QUEUE = 10


def queue_bins(lengths: list[tuple[int, ...]], capacity: int, queue: int = QUEUE, spacing: int = 0) -> list[list[int]]:
    """Bins of item numbers in the order of emission. An item goes to the first open bin, in turn from the oldest, where every key fits;
    if there is none, the oldest is emitted and opened anew for it. Open bins are emitted at the end, oldest first."""
    room = [[capacity] * (len(lengths[0]) if lengths else 1) for _ in range(queue)]
    held: list[list[int]] = [[] for _ in range(queue)]
    top, out = 0, []
    for item, need in enumerate(lengths):
        turn = [(top + k) % queue for k in range(queue)]
        which = next((b for b in turn if all(r >= n for r, n in zip(room[b], need, strict=True))), None)
        if which is None:
            out.append(held[top])
            which, held[top], room[top] = top, [], [capacity] * len(need)
            top = (top + 1) % queue
        held[which].append(item)
        room[which] = [r - n - spacing for r, n in zip(room[which], need, strict=True)]
    out += [held[(top + k) % queue] for k in range(queue)]
    return [b for b in out if b]


def window_size(length: int) -> int:
    """Items that one queue packs: enough for ten times its bins at an eighth of length each."""
    return int(length / 8 * QUEUE * 10)


def pack(df: DataFrame, length: int, keys: list[str], index: str, on_long: str = "drop", pad_id: int = 0) -> DataFrame:
    """(pack_window, bin, and for each key k: k, k_segmentation, k_position) with length places.

    df has a contiguous index; each run of window_size(length) items is packed by one task. on_long: drop items with a longer key,
    or chop them (one key only). Segments count from 1; both segment and position are 0 on padding.
    """
    if on_long == "chop":
        if len(keys) != 1:
            raise ValueError("only items of one key can be chopped")
        df = df.withColumn(keys[0], F.slice(keys[0], 1, length))
    else:
        df = df.where(F.greatest(*[F.size(k) for k in keys], F.lit(0)) <= length)
    df = df.select(F.floor(F.col(index) / window_size(length)).cast("long").alias("pack_window"), F.col(index).alias("_i"), *keys)
    names = [n for k in keys for n in (k, f"{k}_segmentation", f"{k}_position")]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_i", ignore_index=True)
        columns = [[list(map(int, x)) for x in group[k]] for k in keys]
        rows = []
        for b, items in enumerate(queue_bins(list(zip(*[[len(x) for x in c] for c in columns], strict=True)), length)):
            row = [key[0], b]
            for c in columns:
                ids = [t for i in items for t in c[i]]
                seg = [s for s, i in enumerate(items, 1) for _ in c[i]]
                pos = [p for i in items for p in range(len(c[i]))]
                real = [t != pad_id for t in ids]
                blank = [0] * (length - len(ids))
                row += [ids + [pad_id] * len(blank), [s * r for s, r in zip(seg, real, strict=True)] + blank, [p * r for p, r in zip(pos, real, strict=True)] + blank]
            rows.append(row)
        return pd.DataFrame(rows, columns=["pack_window", "bin", *names])

    return df.groupBy("pack_window").applyInPandas(run, "pack_window long, bin int, " + ", ".join(f"{n} array<int>" for n in names))


def running_segments(lengths: DataFrame, stream: str, order: str, size: str, capacity: int) -> DataFrame:
    """A packing in DataFrame operations alone: lengths with bin, bins cut where the running sum passes a multiple of capacity
    (an item over such an edge starts the next bin, so a bin may pass capacity only if an item is longer than half of it)."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(size).over(Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lengths.withColumn("bin", F.floor((before + F.col(size) - 1) / capacity).cast("long"))


def shift_target_position(position: Column, segment: Column, source_segment: Column) -> Column:
    """Target positions plus the length of the source of the same segment; padding stays 0."""
    return F.zip_with(position, segment, lambda p, s: F.when(s == 0, F.lit(0)).otherwise(p + F.size(F.filter(source_segment, lambda x: x == s))))


def interleave(source: Column, source_segment: Column, target: Column, target_segment: Column, max_length: int) -> Column:
    """Source tokens on even, target tokens on odd places, a segment in a block of twice its longer side, segments while they fit in
    max_length: an array of (place, token, is_target)."""
    segments = F.filter(F.array_distinct(F.concat(source_segment, target_segment)), lambda s: s != 0)
    side = lambda seg, s: F.filter(indices(F.size(seg)), lambda i: F.get(seg, i) == s)
    blocks = F.transform(F.array_sort(segments), lambda s: F.struct(s.alias("s"), (2 * F.greatest(F.size(side(source_segment, s)), F.size(side(target_segment, s)))).alias("n")))
    placed = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,at:int>>").alias("o")), lambda a, b: F.struct((a["at"] + b["n"]).alias("at"), F.when(a["at"] + b["n"] <= max_length, F.concat(a["o"], F.array(F.struct(b["s"].alias("s"), a["at"].alias("at"))))).otherwise(a["o"]).alias("o")), lambda a: a["o"])
    put = lambda ids, seg, b, odd: F.transform(side(seg, b["s"]), lambda i, k: F.struct((b["at"] + 2 * k + odd).alias("place"), F.get(ids, i).alias("token"), F.lit(odd).alias("is_target")))
    return F.array_sort(F.flatten(F.transform(placed, lambda b: F.concat(put(source, source_segment, b, 0), put(target, target_segment, b, 1)))))
