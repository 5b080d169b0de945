"""Exact encoding of merge-type (BPE) sentencepiece models by backtracking, and decoding.

A sequence of pieces is the model's encoding of its text exactly if every two neighbours are what merging gives for the two alone:
merges inside a piece go on as they would without the neighbours until one crosses a border. So the encoder takes the longest piece
that starts at a place (Aho-Corasick automaton), checks it against the piece before by merging the two again, takes the next shorter
piece where that fails, and steps back where none is left. A place has one valid way to it at the most, so that a place from which
no piece fits is given up for good: its bit is set, and the work stays linear in the text.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Remembered chunks (of at most LONG_CHUNK characters), twice, and pairs of pieces of one worker; beyond, the older chunks and all pairs are forgotten.
MOST_CHUNKS, MOST_PAIRS, LONG_CHUNK = 400_000, 500_000, 48
#: Characters of a text that are cut into chunks at once, and bytes of results in a batch.
BLOCK, BATCH_BYTES = 1 << 20, 8 << 20


class PieceBpe:
    """The pieces of a model file, with its encoder and decoder. Refuses files that aren't BPE with byte fallback and plain normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec
        if kind.model_type != 2 or not kind.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kind.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, without normalisation, are encoded")
        types = [p.type for p in model.pieces]
        if any(t in (4, 5) for t in types):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.names = [p.piece for p in model.pieces]
        self.lengths = [len(x) for x in self.names]
        #: piece -> (score, id) of those that merging can make
        self.merged = {p.piece: (p.score, k) for k, p in enumerate(model.pieces) if p.type == 1}
        self.byte = [0] * 256
        self.bytes: list[bytes] = []
        self.control = set()
        for k, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = k
                self.bytes.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == 3:
                self.control.add(k)
                self.bytes.append(b"")
            elif p.type == 2:
                self.unk = k
                self.bytes.append((kind.unk_surface if kind.HasField("unk_surface") else " ⁇ ").encode())
            else:
                self.bytes.append(p.piece.replace(MARK, " ").encode())
        self.bos, self.eos = (next((k for k in self.control if self.names[k] == x), None) for x in (kind.bos_piece or "<s>", kind.eos_piece or "</s>"))
        # a character that no piece is stands alone: neither a merge nor a chunk crosses it
        self.alone = {x for x in self.merged if len(x) == 1}
        if any(c not in self.alone for x in self.merged for c in x):
            raise ValueError("a piece has a character that isn't a piece")
        self.trie = ahocorasick.Automaton()
        for x, (_, k) in self.merged.items():
            self.trie.add_word(x, k)
        self.trie.make_automaton()
        self.most = max(map(len, self.merged), default=1)
        self.known = re.compile("[" + "".join(map(re.escape, sorted(self.alone))) + "]+|.", re.DOTALL)
        # two characters that stand side by side in no piece are never merged: a text may be cut there
        sides = {x[k : k + 2] for x in self.merged for k in range(len(x) - 1)}
        joined = any(x[0] != MARK and x[1] == MARK for x in sides)
        letter = "[^\\W\\d_]"
        apart = not joined and all((re.match(letter, x) is None) == (re.match(letter, y) is None) for x, y in sides if MARK not in (x, y))
        inner = "" if "\n" in self.alone else "\n"
        if joined:
            self.chunk = re.compile(".+", re.DOTALL)
        elif apart:
            self.chunk = re.compile(f"{MARK}*(?:{letter}+|(?:(?!{letter})[^{MARK}{inner}])+)|{MARK}+|{inner or '(?!)'}")
        else:
            self.chunk = re.compile(f"{MARK}*[^{MARK}{inner}]+|{MARK}+|{inner or '(?!)'}")
        self.border = re.compile("(?!)" if joined else f"(?<=[^{MARK}]){MARK}")
        self.shorter_of: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The pieces that merging gives for a short text: always the pair whose union has the highest score, of equals the first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.merged.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: int, piece: int) -> bool:
        """Whether piece can stand after before (-1: at the beginning)."""
        key = (before, piece)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            alone = self.names[piece]
            found = self.pairs[key] = self.merge(alone) == [alone] if before < 0 else self.merge(self.names[before] + alone) == [self.names[before], alone]
        return found

    def shorter(self, piece: int) -> int | None:
        """The longest piece that begins piece and is shorter."""
        if piece not in self.shorter_of:
            x = self.names[piece]
            self.shorter_of[piece] = next((self.merged[x[:n]][1] for n in range(len(x) - 1, 0, -1) if x[:n] in self.merged), None)
        return self.shorter_of[piece]

    def longest(self, text: str, at: int) -> list[int]:
        """The longest piece that begins at a place, the longest that begins after that one, and so on for a while."""
        if len(text) - at <= LONG_CHUNK:
            return [k for _, k in self.trie.iter_long(text[at:] if at else text)]
        # what ends near the end of the window might go on beyond it
        return [k for end, k in self.trie.iter_long(text[at : at + 2 * LONG_CHUNK]) if end < 2 * LONG_CHUNK - self.most]

    def run(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces."""
        n, at, out, last = len(text), 0, [], -1
        failed, lengths, pairs, fits = bytearray((n >> 3) + 1), self.lengths, self.pairs, self.fits
        while at < n:
            for piece in self.longest(text, at):
                end = at + lengths[piece]
                ok = pairs.get((last, piece))
                if (fits(last, piece) if ok is None else ok) and not failed[end >> 3] >> (end & 7) & 1:
                    out.append(piece)
                    at, last = end, piece
                    continue
                while True:  # the next shorter piece, or a step back
                    piece = self.shorter(piece)
                    while piece is None:
                        failed[at >> 3] |= 1 << (at & 7)
                        piece = out.pop()
                        at -= lengths[piece]
                        piece = self.shorter(piece)
                        last = out[-1] if out else -1
                    end = at + lengths[piece]
                    if not failed[end >> 3] >> (end & 7) & 1 and fits(last, piece):
                        break
                out.append(piece)
                at, last = end, piece
                break
        return out

    def chunk_ids(self, chunk: str) -> bytes:
        ids: list[int] = []
        for m in self.known.finditer(chunk):
            part = m[0]
            if part[0] in self.alone:
                ids += self.run(part)
            else:
                ids += [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _blocks(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > 2 * BLOCK:
            m = self.border.search(text, start + BLOCK)
            if m is None:
                break
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers, with begin and end ids. An empty text has these two alone."""
        out = [np.array([self.bos], dtype="<u4").tobytes()]
        if text:
            for block in self._blocks(self.prefix + text.replace(" ", MARK)):
                found = self.chunk.findall(block)
                here = {}  # what this block needs is there until its end
                for c in set(found).difference(self.chunks):
                    ids = self.older.get(c) or self.chunk_ids(c)
                    here[c] = ids
                    if len(c) <= LONG_CHUNK:
                        if len(self.chunks) >= MOST_CHUNKS:
                            here |= self.chunks
                            self.older, self.chunks = self.chunks, {}
                        self.chunks[c] = ids
                known = self.chunks
                try:
                    out.append(b"".join([known[c] for c in found]))
                except KeyError:  # some chunk is long, or was forgotten meanwhile
                    out.append(b"".join([known[c] if c in known else here[c] for c in found]))
        out.append(np.array([self.eos], dtype="<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes join to characters, each byte that none uses is U+FFFD, and the mark that encoding puts first goes."""
        listed = ids.tolist()
        cuts = [-1, *(k for k, x in enumerate(listed) if x in self.control), len(listed)]
        out = []  # bytes don't join across a control piece
        for a, b in zip(cuts, cuts[1:], strict=False):
            raw = b"".join([self.bytes[k] for k in listed[a + 1 : b]])
            if raw and self.prefix and not out and self.names[listed[a + 1]].startswith(MARK):
                raw = raw[1:]
                out.append("")
            out += [raw.decode("utf-8", "corploom_each")] if raw else []
        return "".join(out)


codecs.register_error("corploom_each", lambda e: ("�", e.start + 1))


@lru_cache(maxsize=2)
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row of docs: all ids of its whole text, begin and end ids included, as little-endian unsigned 32-bit
    numbers in one binary value (id_arrays() makes arrays).

    A null text is empty and has the begin and end ids alone. Repeated rows give equal rows, a null id stays null, other columns
    are ignored, and no rows give none. No row waits for another: there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_bpe(path)
        for batch in batches:
            texts, begin, size, out = batch.column(1), 0, 0, []
            for k in range(batch.num_rows):
                out.append(model.encode(texts[k].as_py() or ""))
                size += len(out[-1])
                if size > BATCH_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(out)), pa.array(out, pa.binary())], names=["doc_id", "ids"])
                    begin, size, out = k + 1, 0, []

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids) as encode() gives them: the text of each row's ids. Null ids are no ids: an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_bpe(path)
        for batch in batches:
            begin, size, out = 0, 0, []
            for k, ids in enumerate(batch.column(1)):
                raw = ids.as_buffer() if ids.is_valid else b""
                out.append(model.decode(np.frombuffer(raw, dtype="<u4")))
                size += 8 * len(out[-1])
                if size > BATCH_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(begin, len(out))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["doc_id", "ids", "text"])
                    begin, size, out = k + 1, 0, []

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def id_arrays(rows: DataFrame) -> DataFrame:
    """rows (doc_id, ids) with ids as array<int> in place of the binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [None if x is None else np.frombuffer(x, dtype="<i4") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>")
