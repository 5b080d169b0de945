"""Toxicity by maximum-scoring segments of token log-odds.

A token's log-odds are a chain of Dirichlet posteriors, each the prior mean of the next: growing prefixes of the word, by
how many different words with that prefix only toxic or also clean documents have, and then the word, by documents. A linear-time scan (Ruzzo and Tompa) finds
all maximal segments of the scores less a drift. Segment scores become E-values by extreme-value statistics
(Karlin and Altschul) with the rate and decay of non-toxic text, and the document's evidence is the sum of
-ln E over significant segments, turned into a probability by a logistic curve on rows the counts have not seen.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.llm.folds import fold, labelled
from corploom.llm.scratch import Scratch
from corploom.llm.words import document_shingles, signed

_WORD = re.compile(r"\w+")
_PREFIXES = (3, 4, 5, 6)
#: The fold of labelled rows that calibrates; the others give counts.
_CALIBRATION_FOLD = 4


def features(word: str) -> list[str]:
    """The word's prefixes, shortest first, then the word itself, marked by =."""
    return [word[:k] for k in _PREFIXES if len(word) > k] + ["=" + word]


@dataclass
class ToxicityModel:
    """counts: feature -> count of class 1, count of class 0 scaled to as many documents (of a prefix words, of a word documents)."""

    counts: dict[str, tuple[float, float]]
    prior: float = 8.0
    drift: float = 1.5
    rate: float = 1e-4
    decay: float = 1.0
    slope: float = 1.0
    offset: float = -3.0

    def log_odds(self, word: str) -> float:
        p = 0.5
        for feature in features(word):
            found = self.counts.get(feature)
            if found:
                p = (found[0] + self.prior * p) / (found[0] + found[1] + self.prior)
        return math.log(p / (1 - p))

    def segments(self, text: str, cache: dict[str, float]) -> tuple[list[tuple[float, int, int]], int]:
        """(score, first character, end) of every maximal segment, and the number of tokens."""
        hits, n = [], 0
        for n, m in enumerate(_WORD.finditer(text.lower()), 1):
            word = m[0]
            s = cache.get(word)
            if s is None:
                if len(cache) > 100_000:
                    cache.clear()
                s = cache[word] = self.log_odds(word) - self.drift
            if s > 0:
                hits.append((n, s, m.start(), m.end()))
        return maximal_segments(hits, self.drift), n

    def evidence(self, segments: list[tuple[float, int, int]], n: int) -> float:
        """The sum of -ln E of segments with E < 1: E = rate * tokens * exp(-decay * score)."""
        level = math.log(self.rate * max(n, 1))
        return sum(x for s, _, _ in segments if (x := self.decay * s - level) > 0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * math.log1p(evidence) + self.offset))))


def maximal_segments(hits: list[tuple[int, float, int, int]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments of a sequence in which tokens between hits score -drift, in linear time.

    hits: (token number, positive score, first character, end) in order. Returns (score, first character, end).
    """
    # candidates in order, each with the sum before it, the sum to its end, its characters, and the place of the nearest earlier one with a
    # smaller sum before it. What a later candidate steps over on that chain has no smaller sum before it than the later one, so nobody steps over it again
    before: list[float] = []
    upto: list[float] = []
    chars: list[tuple[int, int]] = []
    smaller: list[int] = []
    total, last = 0.0, 0
    for number, s, a, b in hits:
        total -= drift * (number - last - 1)
        last = number
        left, total = total, total + s
        at = len(before) - 1
        while at >= 0:
            if before[at] >= left:
                at = smaller[at]
            elif upto[at] < total:  # the two and all between become one
                left, a = before[at], chars[at][0]
                for x in (before, upto, chars):
                    del x[at:]
                at = smaller[at]
                del smaller[len(before) :]
            else:
                break
        before.append(left)
        upto.append(total)
        chars.append((a, b))
        smaller.append(at)
    return [(r - x, a, b) for x, r, (a, b) in zip(before, upto, chars, strict=True)]


def _decay(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p(s) exp(decay s) = 1 for scores with negative mean."""
    p = counts / counts.sum()
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        if np.sum(p * np.exp(np.minimum(mid * scores, 700))) < 1:
            low = mid
        else:
            high = mid
    return low


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> tuple[float, float]:
    """Slope and offset of a ridge logistic curve."""
    X = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ b, -50, 50)))
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + penalty * np.eye(2), X.T @ (p - y) + penalty * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least and the greatest hash of each text's three-word shingles (0 without words)."""
    for batch in batches:
        ends = [(s[0], s[-1]) if len(s) else (0, 0) for _, s in document_shingles(batch.column(1), 3)]
        lo, hi = (signed(np.array([e[k] for e in ends], dtype=np.uint64)) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lo), pa.array(hi)], names=["doc_id", "text", "label", "fold", "lo", "hi"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, least_docs: int = 3, column: str = "toxic") -> ToxicityModel:
    """Learn from at most about most labelled rows outside fold 0; of near copies one counts. No such rows: a model that rejects nothing.

    Every prefix and word with enough evidence counts; the bound on rows bounds their number."""
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        return _fit(docs, labels, scratch, most, least_docs, column)


def _fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int, least_docs: int, column: str) -> ToxicityModel:
    rows = labelled(labels, column, most)
    # a side of most rows at the most
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id").where("text IS NOT NULL").select("doc_id", "text", "label", "fold")
    # near copies would make their rare words look toxic: of rows that share the least or the greatest shingle hash, one stays
    known = known.mapInArrow(_ends, "doc_id long, text string, label int, fold int, lo long, hi long")
    row = F.struct("doc_id", "text", "label", "fold", "lo", "hi")
    for end in ("lo", "hi"):
        known = known.groupBy(end).agg(F.min(row).alias("r")).select("r.*")
    known = scratch.save(known.select("text", "label", "fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        both: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both[label == 1].update(set(_WORD.findall(text.lower())))
                both[label == 1]["#"] += 1  # no word has this sign
        for label, c in enumerate(both):
            names = list(c)
            for k in range(0, len(names), 50_000):
                part = names[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([0 if label == 0 else c[f] for f in part], pa.int64()), pa.array([c[f] if label == 0 else 0 for f in part], pa.int64())], names=["word", "c1", "c0"])

    counted = known.where(F.col("fold") != _CALIBRATION_FOLD).select("text", "label").mapInArrow(count, "word string, c1 long, c0 long")
    counted = counted.groupBy("word").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    counted = scratch.save(counted)
    totals = counted.where("word = '#'").first()
    if totals is None or not totals["c1"] or not totals["c0"]:
        return ToxicityModel({})
    scale = totals["c1"] / totals["c0"]
    words = counted.where("word <> '#'")
    starts = F.filter(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in _PREFIXES]), lambda x: x.isNotNull())
    kinds = words.select(F.explode(starts).alias("prefix"), ((F.col("c1") > 0) & (F.col("c0") == 0)).cast("long").alias("c1"), (F.col("c0") > 0).cast("long").alias("c0"))
    kinds = kinds.groupBy("prefix").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    strong = scratch.save(kinds.where(f"c1 >= {least_docs} AND c1 >= {4 * scale} * c0"))
    features_ = {r["prefix"]: (float(r["c1"]), r["c0"] * scale) for r in strong.toLocalIterator()}
    # and what clean documents have of words that begin so
    shared = words.where("c0 > 0").withColumn("prefix", F.explode(starts)).join(strong.select("prefix"), "prefix", "left_semi").select("word", "c1", "c0")
    marked = words.where(f"c1 >= {least_docs} AND c1 >= {2 * scale} * c0").unionByName(shared).distinct()
    model = ToxicityModel(features_ | {"=" + r["word"]: (float(r["c1"]), r["c0"] * scale) for r in marked.toLocalIterator()})

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            out = [model.segments(t, cache) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for _, n in out], pa.int64()), pa.array([[s for s, _, _ in x] for x, _ in out], pa.list_(pa.float64()))], names=["label", "n", "scores"])

    seen = known.where(F.col("fold") == _CALIBRATION_FOLD).select("text", "label").mapInArrow(trial, "label int, n long, scores array<double>").collect()
    clean = [r for r in seen if r["label"] != 1]
    tokens = sum(r["n"] for r in clean) or 1
    background = [s for r in clean for s in r["scores"]]
    top = max([6.0, *(s for r in seen for s in r["scores"])])
    scores = np.array([-model.drift, top, *background])
    model.decay = min(3.0, _decay(scores, np.array([max(1.0, tokens - len(background)), 1.0, *[1.0] * len(background)])))
    model.rate = (len(background) + 1) / tokens
    x = np.array([math.log1p(model.evidence([(s, 0, 0) for s in r["scores"]], r["n"])) for r in seen])
    y = np.array([float(r["label"] == 1) for r in seen])
    if len(seen) and 0 < y.sum() < len(y):
        model.slope, model.offset = _logistic(x, y)
        if model.slope <= 0:
            model.slope, model.offset = 1.0, -3.0
    return model


def passages(docs: DataFrame, model: ToxicityModel, most_e: float = 0.05) -> DataFrame:
    """(doc_id, score, passages): the document's probability, and (start, end, e_value) of every segment with E <= most_e, in characters of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("e_value", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores, found = [], []
                for text in part.column(1).to_pylist():
                    segments, n = model.segments(text or "", cache)
                    scores.append(model.probability(model.evidence(segments, n)))
                    found.append([{"start": a, "end": b, "e_value": e} for s, a, b in segments if (e := model.rate * n * math.exp(-model.decay * s)) <= most_e])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<struct<start: bigint, end: bigint, e_value: double>>")


def keep_clean(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches limit; all columns stay, whatever their names, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            mask = []
            for text in batch.column(batch.schema.get_field_index("text")):
                segments, n = model.segments(text.as_py() or "", cache)
                mask.append(model.probability(model.evidence(segments, n)) < limit)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of each row of docs.

    Null and empty texts have no tokens and get the score of no evidence. Repeated rows get equal scores. Labels,
    lang, source and doc_id are no inputs of a score.
    """
    out = passages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
