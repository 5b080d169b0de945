"""Best-fit packing: large items are matched in pairs, smaller ones fill the smallest gap that takes them."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.llm.scratch import Scratch

#: Items packed by one task: its last bin or two may stay open, which is below 0.1 % of its bins.
GROUP_ITEMS = 16384


def encoder(path: str):
    """A function from texts to lists of ids for the byte-level BPE of the JSON file at path.

    A JSON file with a .tiktoken file of the same vocabulary beside it is run by the faster of the two libraries;
    both give the same ids (tested), special tokens in a text included. Texts go to the JSON file's own library otherwise, and texts
    that the faster one refuses: its pattern gives up on a million whitespace characters in a row.
    """
    import base64
    import json
    import os

    from tokenizers import Tokenizer

    plain = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(plain):
        own = Tokenizer.from_file(path)
        return lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    spec = json.load(open(path))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(plain, "rb"))}
    if spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"] is not None:
        own = Tokenizer.from_file(path)
        return lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers

    specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)
    plain_library: list[Tokenizer] = []

    def one(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            if not plain_library:
                plain_library.append(Tokenizer.from_file(path))
            return plain_library[0].encode(text, add_special_tokens=False).ids

    return lambda texts: [one(x) for x in texts]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, place[, ids]): every document's ids and then end_id, cut only if longer than capacity.

    Whole pieces have capacity ids; the first holds what is left over, so that it and not the last is short.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, place, task = encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    ids = np.asarray([*ids, end_id], dtype="<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, place, *([ids[a:b].astype("i4")] * with_ids)))
                        place += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())), strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


class _Gaps:
    """Bins by the room that is left, the smallest room first."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, which: int) -> None:
        if room > 0:
            if room not in self.bins:
                insort(self.rooms, room)
                self.bins[room] = []
            self.bins[room].append(which)

    def take(self, least: int) -> tuple[int, int] | None:
        k = bisect_left(self.rooms, least)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        which = self.bins[room].pop()
        if not self.bins[room]:
            del self.bins[room]
            del self.rooms[k]
        return room, which


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. Items above a third of capacity are matched, two to a bin at most: from the longest
    down, each with the longest other that still fits. Then the shorter ones, longest first, go where least room is left."""
    n = len(lengths)
    bins, offsets = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    large = [int(i) for i in order if lengths[i] * 3 > capacity]
    gaps, used = _Gaps(), 0
    waiting, free = _Gaps(), np.zeros(n, dtype=bool)  # large items by capacity - length: take() gives the longest that fits
    for i in reversed(large):
        free[i] = True
        waiting.add(capacity - int(lengths[i]) + 1, i)
    for i in large:
        if not free[i]:
            continue
        free[i] = False
        room = capacity - int(lengths[i])
        bins[i] = used
        while (found := waiting.take(int(lengths[i]) + 1)) is not None:
            j = found[1]
            if free[j]:  # else it has been placed, and leaves the list now
                free[j] = False
                bins[j], offsets[j] = used, lengths[i]
                room -= int(lengths[j])
                break
        gaps.add(room, used)
        used += 1
    for i in order[len(large) :]:
        need = int(lengths[i])
        found = gaps.take(need)
        if found is None:
            room, which = capacity, used
            used += 1
        else:
            room, which = found
        bins[i], offsets[i] = which, capacity - room
        gaps.add(room - need, which)
    return bins, offsets


def pack(items: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """items (with task, place and length) with sequence_id and offset. No sequence is longer than capacity.

    Items are dealt at random, by a hash of where they were made, into groups of about GROUP_ITEMS, each packed by
    one task; a group's bins are its own. Lengths from 1 to capacity are asked for.
    """
    count = items.count()
    groups = max(1, round(count / GROUP_ITEMS))
    plain = [f"{n} {t}" for n, t in items.dtypes]

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["task", "place"], ignore_index=True)
        bins, offsets = best_fit(group["length"].to_numpy(), capacity)
        return group.drop(columns="pack_group").assign(sequence_id=bins + (int(key[0]) << 40), offset=offsets)

    dealt = items.withColumn("pack_group", F.pmod(F.xxhash64("task", "place"), F.lit(groups)).cast("int"))
    return scratch.save(dealt.groupBy("pack_group").applyInPandas(place, ", ".join([*plain, "sequence_id long", "offset long"])), keep=True)


def pack_documents(docs: DataFrame, scratch: Scratch, path: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece of each document.

    A null or empty text is the end id alone. Repeated rows are packed as often as they stand; a null doc_id stays
    null. No documents give no rows; other columns are ignored.
    """
    items = scratch.save(pieces(docs, path, capacity))
    return pack(items, scratch, capacity).drop("task", "place")
