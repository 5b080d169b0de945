"""Token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words with a word mark in front. Distinct ones go into a trie; the best unigram score of
every prefix is computed once at its node from the scores of shorter prefixes on the path, with the number of pieces
on the best path, so that words that share a prefix share the work. A word's terminal node holds its count.
A piece's probability is its share of all pieces that the corpus uses: vocabularies that are ranked by merges carry no probabilities.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Trie nodes and remembered words in one task; beyond, either starts anew (counts don't depend on it).
MOST_NODES, MOST_WORDS = 250_000, 500_000
#: Characters beyond which a word shares nothing and leaves no nodes.
LONG_WORD = 1000


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=str(Path(path)))


def unigram_pieces(path: str, counts: np.ndarray | None = None) -> dict[str, float]:
    """piece -> log-probability of the normal pieces of a sentencepiece model file.

    counts: how often each id is used. A piece has (count + 1/2) of all counts and halves. Without counts all pieces are alike.
    """
    model = _model(path)
    names = {k: model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))}
    used = np.zeros(max(names, default=0) + 1) if counts is None else np.asarray(counts, dtype=np.float64)
    total = math.log(sum(used[k] + 0.5 for k in names) or 1.0)
    return {x: math.log(used[k] + 0.5) - total for k, x in names.items()}


def piece_counts(docs: DataFrame, path: str) -> np.ndarray:
    """How often each id of the model file's vocabulary is used over all texts of docs, by the file's own segmentation. A task splits each
    different word once for its repeats; what it keeps of words is bounded."""
    size = _model(path).get_piece_size()

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        seen: Counter = Counter()
        total = np.zeros(size, dtype=np.int64)

        def flush() -> None:
            found = list(seen.items())
            for at in range(0, len(found), 20_000):
                part = found[at : at + 20_000]
                ids = model.encode([w.decode("utf-8", "replace") for w, _ in part])
                times = np.repeat([n for _, n in part], [len(x) for x in ids])
                total[:] += np.bincount(np.fromiter((i for x in ids for i in x), dtype=np.int64, count=len(times)), weights=times, minlength=size).astype(np.int64)
            seen.clear()

        for batch in batches:
            for text in batch.column(0):
                seen.update((text.as_py() or "").encode("utf-8", "surrogatepass").split())
                if len(seen) > MOST_WORDS:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0], pa.int64())], names=["id", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in docs.select("text").mapInArrow(used, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each piece at the most
        out[r["id"]] = r["n"]
    return out


class Trie:
    """Nodes hold, for the prefix they stand for, the best score, the fewest pieces among best paths, and the pieces that have begun
    on the way here and may go on: (node where it begins, place in the trie of pieces)."""

    def __init__(self, pieces: dict[str, float]):
        self.root: dict = {}
        for piece, score in pieces.items():
            at = self.root
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = score
        self.floor = min(pieces.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        #: (node, character) in one number -> node
        self.next: dict[int, int] = {}
        self.score: list[float] = [0.0]
        self.count: list[int] = [0]
        self.open: list[list[tuple[int, dict]]] = [[(0, self.root)]]

    def alone(self, word: str) -> int:
        """The number of tokens of a long word: the same scores, of which only those that an open piece began at are kept."""
        score, count, opened = 0.0, 0, [(0.0, 0, self.root)]
        for c in word:
            size = len(c.encode("utf-8", "surrogatepass"))
            best, fewest, going = score + self.floor * size, count + size, []
            for s0, n0, place in opened:
                further = place.get(c)
                if further is not None:
                    going.append((s0, n0, further))
                    p = further.get("")
                    if p is not None and (s0 + p > best or s0 + p == best and n0 + 1 < fewest):
                        best, fewest = s0 + p, n0 + 1
            score, count = best, fewest
            going.append((score, count, self.root))
            opened = going
        return count

    def add(self, word: str, long: int = LONG_WORD) -> int:
        """The number of tokens of word; nodes that weren't there yet are scored. A word of more than long characters has no nodes."""
        if len(word) > long:
            return self.alone(word)
        node, nexts, score, count, opened = 0, self.next, self.score, self.count, self.open
        for c in word:
            edge = node * 0x110000 + ord(c)
            child = nexts.get(edge)
            if child is None:
                child = len(score)
                # a character that no piece covers falls back to its bytes
                size = len(c.encode("utf-8", "surrogatepass"))
                best, fewest, going = score[node] + self.floor * size, count[node] + size, []
                for begin, place in opened[node]:
                    further = place.get(c)
                    if further is not None:
                        going.append((begin, further))
                        p = further.get("")
                        if p is not None:
                            s, n = score[begin] + p, count[begin] + 1
                            if s > best or s == best and n < fewest:
                                best, fewest = s, n
                going.append((child, self.root))
                nexts[edge] = child
                score.append(best)
                count.append(fewest)
                opened.append(going)
            node = child
        return count[node]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row of docs (doc_id, text), in two narrow passes: one counts how often each piece is used over
    all texts, which gives the probabilities, the other scores.

    Words are runs of characters outside [\\x20\\x09-\\x0D]. Null and empty texts have none and 0 tokens. Repeated rows get
    equal counts, a null id stays null; other columns are ignored.
    """

    shared = docs.sparkSession.sparkContext.broadcast(unigram_pieces(path, piece_counts(docs, path)))  # a vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the trie has no cycles, and collecting garbage would walk all of it again and again
        gc.disable()
        try:
            trie, known = Trie(shared.value), {}
            count_of = known.__getitem__
            for batch in batches:
                words, tokens = [], []
                for text in batch.column(1):
                    # bytes split at [\x20\x09-\x0D] alone
                    found = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    new = set(found).difference(known)
                    if len(known) + len(new) > MOST_WORDS:
                        known.clear()
                        new = set(found)
                    for w in new:
                        if len(trie.next) > MOST_NODES:
                            trie.clear()
                        known[w] = trie.add(MARK + w.decode("utf-8", "surrogatepass"))
                    words.append(len(found))
                    tokens.append(sum(map(count_of, found)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
