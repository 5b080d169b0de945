"""Quality by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corploom.llm.folds import fold, labelled
from corploom.llm.scratch import Scratch

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII = re.compile(r"[\x00-\x7F]+")
#: Kinds of ASCII characters: 1 lower case, 2 upper case, 3 digits, 4 symbols, 5 marks.
_KIND = np.zeros(256, dtype=np.int64)
for _kind, _of in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b"#$%&*@^~|<>{}[]=+_\\"), (5, b".,;:!?'\"()-")):
    _KIND[list(_of)] = _kind

NAMES = ("log_words", "mean_word", "spread_word", "upper", "digit", "symbol", "mark", "other", "distinct", "top_word", "same_next", "line_words", "line_repeat", "long_word", "short_word", "lone_symbol")


def statistics(text: str | None) -> list[float]:
    """The statistics of NAMES of one whole text, each transformed to be roughly normal; an empty or null text gives a defined vector."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars = sum(map(len, words))
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lower, upper, digit, symbol, mark = np.bincount(_KIND, weights=seen, minlength=6)[1:].tolist()
    ascii_letters = lower + upper
    if len(raw) > len(text):  # letters and digits of other scripts
        rest = _ASCII.sub("", text)
        lower, upper, digit = (n + sum(map(f, rest)) for n, f in ((lower, str.islower), (upper, str.isupper), (digit, str.isdigit)))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    root = lambda part, whole: (part / max(1, whole)) ** 0.5
    return [
        float(np.log1p(n)), float(np.log(lengths.mean())), float(np.log1p(lengths.std())), root(upper, upper + lower), root(digit, chars), root(symbol, chars), root(mark, chars),
        root(max(0, chars - ascii_letters - digit - symbol - mark), chars), root(len(counts), n), root(max(counts.values()), n), root(repeats, n), float(np.log1p(n / max(1, len(lines)))),
        root(len(lines) - len(set(lines)), len(lines)), root(int((lengths > 15).sum()), n), root(int((lengths <= 2).sum()), n), root(sum(counts[w] for w in "|#*-&$%" if w in counts), n),
    ]


@dataclass
class Discriminant:
    """Class means, inverses of the Cholesky factors of the shrunk covariances (made once), log-determinants of the factors, and log-priors."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray
    temper: float = 0.25

    def log_density_difference(self, x: np.ndarray) -> np.ndarray:
        """ln p(x | 1) + ln p(1) - ln p(x | 0) - ln p(0) of each row, by Mahalanobis distances: one product with the cached factor a class."""
        out = []
        for k in (0, 1):
            z = self.factors[k] @ (x - self.means[k]).T
            out.append(-0.5 * (z * z).sum(axis=0) - self.log_dets[k] + self.log_priors[k])
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.temper * self.log_density_difference(x), -40, 40)))


def discriminant(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float = 0.15, ridge: float = 1e-4) -> Discriminant:
    """From each class's count, sum (d) and sum of outer products (d, d). Covariances are shrunk towards the pooled one, and that towards its diagonal."""
    d = sums.shape[1]
    total = max(float(n.sum()), 1.0)
    means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], sums.sum(axis=0) / total)
    covs = np.array([squares[k] / max(n[k], 1) - np.outer(means[k], means[k]) if n[k] > 1 else np.eye(d) for k in (0, 1)])
    pooled = (covs * (n / total)[:, None, None]).sum(axis=0) if n.sum() else np.eye(d)
    pooled = (1 - shrink) * pooled + shrink * np.diag(np.diag(pooled)) + ridge * np.eye(d)
    factors = np.array([np.linalg.cholesky((1 - shrink) * c + shrink * pooled + ridge * np.eye(d)) for c in covs])
    return Discriminant(means, np.linalg.inv(factors), np.array([np.log(np.diag(f)).sum() for f in factors]), np.log((n + 1) / (n.sum() + 2)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def fit(stats: DataFrame, labels: DataFrame, most: int = 50_000, column: str = "quality") -> Discriminant:
    """Learn from at most about most labelled rows outside fold 0. Only class sums and sums of products reach the driver."""
    rows = labelled(labels, column, most)
    d = len(NAMES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            for k in (0, 1):
                own = x[y == 1] if k else x[y != 1]
                n[k] += len(own)
                s[k] += own.sum(axis=0)
                q[k] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([*range(2 + 2 * d + 2 * d * d)], pa.int32()), pa.array(np.concatenate([n, s.ravel(), q.ravel()]))], names=["place", "value"])

    sums = np.zeros(2 + 2 * d + 2 * d * d)
    parts = stats.join(rows.select("doc_id", "label"), "doc_id").select("x", "label").mapInArrow(add, "place int, value double")
    for r in parts.groupBy("place").agg(F.sum("value").alias("value")).toLocalIterator():
        sums[r["place"]] = r["value"]
    return discriminant(sums[:2], sums[2 : 2 + 2 * d].reshape(2, d), sums[2 + 2 * d :].reshape(2, d, d))


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, predicted 1 if score >= 0.3.

    Null and empty texts have the vector of zeros and get its score. Repeated rows get equal scores. Without labels of
    both kinds the densities are standard normal or equal, and scores rest on what there is. Labels, lang, source and
    doc_id are no inputs of a score.
    """
    stats = scratch.save(with_statistics(docs))
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scratch.save(scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")), keep=True)
