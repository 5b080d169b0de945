"""Counter-based randomness: a keyed uniform is a function of its key alone, not of partitions or retries."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_bits(seed: int, tag: str, *key: Column) -> Column:
    """32 bits of md5 of seed|tag|key as a long, the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def keyed_uniform(seed: int, tag: str, *key: Column) -> Column:
    """A double in [0, 1)."""
    return keyed_bits(seed, tag, *key) / F.lit(4294967296.0)


def key_prefix(seed: int, tag: str, *key: Column) -> Column:
    """What keyed_bits hashes before the last part of a key."""
    return F.concat(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[k.cast("string") for k in key]), F.lit("|"))


def keyed_hex(prefix: Column, last: Column) -> Column:
    """keyed_uniform of a key_prefix and a key's last part as eight hexadecimal digits: they order alike, and no number is made of them."""
    return F.substring(F.md5(F.concat(prefix, last.cast("string")).cast("binary")), 1, 8)


_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
#: Messages that are hashed at once: what fits in a cache.
_AT_ONCE = 16384


def _first_words(words: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of messages of one block each, words (16, n)."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x) for x in start)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            f, k = d ^ (b & (c ^ d)), i
        elif kind == 1:
            f, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif kind == 2:
            f, k = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, k = c ^ (b | ~d), (7 * i) % 16
        f += a
        f += _K[i]
        f += words[k]
        turn = np.uint32(_TURN[kind][i % 4])
        turned = f << turn
        turned |= f >> (np.uint32(32) - turn)
        turned += b
        a, b, c, d = d, turned, b, c
    return (a + start[0]).byteswap()


def numbered_bits(prefixes: list[str], n: int) -> np.ndarray:
    """keyed_bits, inside a task, of each key_prefix with the last parts 0 .. n-1: an array (prefixes, n) of uint32, all hashed together."""
    tails = [str(k).encode() for k in range(n)]
    heads = [p.encode() for p in prefixes]
    out = np.empty((len(heads), n), dtype=np.uint32)
    if not n or not heads:
        return out
    size = np.array([len(t) for t in tails])
    digits = np.zeros((n, size.max()), dtype=np.uint8)
    for k, t in enumerate(tails):
        digits[k, : len(t)] = list(t)
    by_length: dict[int, list[int]] = {}
    for r, h in enumerate(heads):
        by_length.setdefault(len(h), []).append(r)
    for length, rows in by_length.items():
        if length + size.max() > 55:  # more than one block
            for r in rows:
                out[r] = [int.from_bytes(hashlib.md5(heads[r] + t).digest()[:4], "big") for t in tails]
            continue
        each = max(1, _AT_ONCE // n)
        tail = np.zeros((n, 64), dtype=np.uint8)
        tail[:, length : length + size.max()] = digits
        tail[np.arange(n), length + size] = 0x80
        tail[:, 56:58] = ((length + size) * 8).astype("<u2").view(np.uint8).reshape(n, 2)
        for at in range(0, len(rows), each):
            some = rows[at : at + each]
            block = np.tile(tail, (len(some), 1, 1)).reshape(len(some), n, 64)
            block[:, :, :length] = np.frombuffer(b"".join(heads[r] for r in some), dtype=np.uint8).reshape(len(some), 1, length)
            words = np.ascontiguousarray(block.reshape(-1, 64).view("<u4").T)
            out[some] = _first_words(words).reshape(len(some), n)
    return out
