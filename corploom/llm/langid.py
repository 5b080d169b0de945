"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

ln P(lang | page) is the sum of the text's tempered log-likelihood, of smoothed ln P(declared | lang) and
ln P(suffix | lang), and of ln of the host's prior. Tables for the last three come from grouped counts of what
the text alone says; the host's prior is smoothed towards its domain's, that towards its suffix's, and that
towards the table's, each without the page itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corploom.llm.counts import SLICE, count_table
from corploom.llm.scratch import Scratch
from corploom.llm.words import CHUNK_BYTES, text_chunks

#: Bits of the buckets that byte trigrams are hashed to, and of all counters of all languages: many languages get fewer buckets each.
BUCKET_BITS, LEAST_BITS, TABLE_BITS = 16, 8, 23
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
#: Bytes that carry language: letters and bytes of longer characters; others count as a space.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_FOLD[~_LETTER[_FOLD]] = 32

#: Elements whose content isn't text; what ends them.
_HIDDEN = re.compile(rb"(?:script|style|nav)(?![\w\x80-\xff])", re.IGNORECASE)
_CLOSED = re.compile(rb"</(script|style|nav)\s*>", re.IGNORECASE)


def visible_bytes(html: bytes) -> bytes:
    """The text of a page: no scripts, styles, navigation, comments or tags, a space for each. One pass; what is never closed is an ordinary tag."""
    ends: dict[bytes, list[tuple[int, int]]] = {}
    for m in _CLOSED.finditer(html):
        ends.setdefault(m[1].lower(), []).append(m.span())
    turn = dict.fromkeys(ends, 0)
    out, at, last_comment = [], 0, html.rfind(b"-->")
    while (tag := html.find(b"<", at)) >= 0:
        end = -1
        hidden = _HIDDEN.match(html, tag + 1)
        if hidden:
            name = hidden[0].lower()
            spans = ends.get(name, [])
            while turn.get(name, 0) < len(spans) and spans[turn[name]][0] < hidden.end():
                turn[name] += 1
            if turn.get(name, 0) < len(spans):
                end = spans[turn[name]][1]
        elif html.startswith(b"<!--", tag) and last_comment >= tag + 4:
            end = html.find(b"-->", tag + 4) + 3
        if end < 0:
            end = html.find(b">", tag) + 1
            if not end:  # no tag is closed from here on
                break
        out.append(html[at:tag])
        at = end
    out.append(html[at:])
    return b" ".join(out)


def visible(html: str) -> str:
    return visible_bytes(html.encode()).decode()


def trigrams(raw: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    """Bucket (of 2**bits) of every byte trigram that has a letter, over letters lower-cased and all else as single spaces."""
    b = _FOLD[raw]
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b = b[keep].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[(b[:-2] != 32) | (b[2:] != 32) | (b[1:-1] != 32)]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


@dataclass
class TextModel:
    """languages, and ln P(trigram | language) of each bucket, the unknown language last with all alike."""

    languages: list[str]
    table: np.ndarray

    def log_likelihoods(self, raw: np.ndarray) -> tuple[np.ndarray, int]:
        """Sums over the trigrams, and how many there are."""
        out, n, bits = np.zeros(len(self.table)), 0, self.table.shape[1].bit_length() - 1
        for at in range(0, max(1, len(raw)), CHUNK_BYTES):
            t = trigrams(raw[at : at + CHUNK_BYTES + 2], bits)
            n += len(t)
            out += self.table[:, t].sum(axis=1, dtype=np.float64)
        return out, n


def fit_text(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", smoothing: float = 0.5) -> TextModel:
    """Counts over all rows with a language. All languages together have at most 2**TABLE_BITS counters, so that more than 128 of them
    have fewer buckets each; more than 32,768 are refused, for they are no languages."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().toLocalIterator())
    bits = max(LEAST_BITS, min(BUCKET_BITS, TABLE_BITS - max(0, len(languages) - 1).bit_length()))
    if len(languages) << bits > 1 << TABLE_BITS:
        raise ValueError(f"{len(languages)} different languages are declared")
    size = 1 << bits
    place = {x: k for k, x in enumerate(languages)}

    def indices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        codes = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
        for first, rows, raw, offsets in text_chunks(batch.column(1)):
            for k in range(rows):
                yield trigrams(raw[offsets[k] : offsets[k + 1]], bits) + codes[first + k] * size

    def gathered(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        waiting: list[np.ndarray] = []
        for x in indices(batch):
            waiting.append(x)
            if sum(map(len, waiting)) > 4 * CHUNK_BYTES:
                yield np.concatenate(waiting)
                waiting = []
        if waiting:
            yield np.concatenate(waiting)

    counts = count_table(known, -(-max(1, len(languages)) * size // SLICE) * SLICE, gathered)[: len(languages) * size].reshape(-1, size).astype(np.float64)
    logs = np.log((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * size))
    return TextModel(languages, np.vstack([logs, np.full((1, size), -np.log(size))]).astype(np.float32))


def _table_of(likelihoods: np.ndarray, n: int, scale: float) -> list[float]:
    """Log-likelihoods relative to the best, tempered as if the text had at most about scale independent trigrams."""
    return [] if n == 0 else ((likelihoods - likelihoods.max()) * min(1.0, scale / n)).tolist()


def text_evidence(rows: DataFrame, model: TextModel, html: bool, scale: float = 50.0) -> DataFrame:
    """rows (key, text, declared, host) as (key, declared, host, tens, best): tens the tempered log-likelihoods (empty without any letter), best the likeliest language."""
    names = [*model.languages, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tens, best = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                x = _table_of(*model.log_likelihoods(np.frombuffer(visible_bytes(text.encode()) if html else text.encode(), dtype=np.uint8)), scale)
                tens.append(x)
                best.append(names[int(np.argmax(x))] if x else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(tens, pa.list_(pa.float64())), pa.array(best, pa.string())], names=["key", "declared", "host", "tens", "best"])

    return rows.select("key", "text", "declared", "host").mapInArrow(run, "key long, declared string, host string, tens array<double>, best string")


def host_of(url: Column) -> Column:
    """The host of an address in lower case; null where there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found != "", found)


def declared_of(html: Column) -> Column:
    """The first subtag of the html element's lang, in lower case; null without one."""
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), "(?is)<html(?=\\s)[^<>]*?\\slang\\s*+=\\s*+(?:[\"']\\s*+)?+([A-Za-z]{2,8})", 1))
    return F.nullif(found, F.lit(""))


@dataclass
class Fusion:
    """Evidence of one page as log-probabilities. Counts are of the pages' likeliest languages by their text, each without the page itself.

    totals: how many pages each language is the likeliest of.
    """

    names: list[str]
    totals: np.ndarray
    strength: float = 5.0

    def vector(self, counts: list[tuple[str, int]] | None, own: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.names))
        for name, n in counts or ():
            out[self.place[name]] = n
        return np.maximum(out - own, 0)

    def __post_init__(self) -> None:
        self.place = {x: k for k, x in enumerate(self.names)}

    def logs(self, tens: list[float] | None, best: str | None, declared: str | None, declared_counts: list | None, levels: list) -> np.ndarray:
        """ln P(language, evidence) up to a constant: the priors of levels (suffix, domain, host; None or empty where there is none) are smoothed each
        towards the one before, the first towards that of all pages; what is missing adds nothing."""
        own = np.zeros(len(self.names))
        if best is not None:
            own[self.place[best]] = 1
        every = np.maximum(self.totals - own, 0)
        prior = (every + 1) / (every.sum() + len(self.names))
        for counts in levels:
            if counts:
                n = self.vector(counts, own)
                prior = (n + self.strength * prior) / (n.sum() + self.strength)
        out = np.log(prior)
        if declared:
            # of all pages in a language, those with this declaration
            as_said = np.full(len(self.names), 0.5)
            if declared in self.place:
                as_said[self.place[declared]] = self.strength
            out = out + np.log((self.vector(declared_counts, own) + as_said) / (every + self.strength + 0.5 * len(self.names)))
        return out if not tens else out + np.array(tens)


def _small(df: DataFrame, entries: int = 400_000) -> DataFrame:
    """df, sent to all executors if its rows and the entries of their arrays (some dozen bytes each) are few; otherwise Spark shuffles."""
    held = [F.coalesce(F.size(F.coalesce(c, F.array())), F.lit(0)) for c, t in df.dtypes if t.startswith("array")]
    found = df.agg(F.sum(sum(held, F.lit(1)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if found <= entries else df


def _counts(seen: DataFrame, by: str, out: str) -> DataFrame:
    """(by, out): for each value of by the likeliest languages of its rows, and of how many each (map-side sums)."""
    counted = seen.where(F.col(by).isNotNull()).groupBy(by, "best").agg(F.sum("n").alias("n"))
    return counted.groupBy(by).agg(F.collect_list(F.struct("best", "n")).alias(out))


def _totals(seen: DataFrame, names: list[str]) -> np.ndarray:
    found = {r["best"]: r["n"] for r in seen.groupBy("best").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    return np.array([float(found.get(x, 0)) for x in names])


def fuse(evidence: DataFrame, model: TextModel, scratch: Scratch, strength: float = 5.0) -> DataFrame:
    """evidence (key, declared, host, tens, best) as (key, lang, posterior, text_lang); lang is und, with the posterior that the priors
    give it, where there is no text, no declaration and no host."""
    names = [*model.languages, UNKNOWN]
    seen = scratch.save(evidence.where("best IS NOT NULL").groupBy("declared", "host", "best").agg(F.count("*").alias("n")))
    parts = F.split("host", "\\.")
    placed = seen.withColumn("suffix", F.element_at(parts, -1)).withColumn("domain", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.element_at(parts, -1)))
    hosts = evidence.select("host").where("host IS NOT NULL").distinct()
    hosts = hosts.withColumn("suffix", F.element_at(parts, -1)).withColumn("domain", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.element_at(parts, -1)))
    for by in ("suffix", "domain", "host"):
        hosts = hosts.join(_small(_counts(placed, by, f"{by}_counts")), by, "left")
    hosts = scratch.save(hosts.select("host", "suffix_counts", "domain_counts", "host_counts"))
    fusion = Fusion(names, _totals(seen, names), strength)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, posterior, texts = [], [], []
            for r in batch.to_pylist():
                pairs = lambda c: [(x["best"], x["n"]) for x in r[c] or ()]  # noqa: B023, E731
                logs = fusion.logs(r["tens"], r["best"], r["declared"], pairs("declared_counts"), [pairs(c) for c in ("suffix_counts", "domain_counts", "host_counts")])
                p = np.exp(logs - logs.max())
                k = int(np.argmax(logs)) if r["tens"] or r["declared"] or r["host"] else len(names) - 1
                lang.append(names[k])
                posterior.append(float(p[k] / p.sum()))
                texts.append(r["best"] or UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(posterior, pa.float64()), pa.array(texts, pa.string())], names=["key", "lang", "posterior", "text_lang"])

    joined = evidence.join(_small(_counts(seen, "declared", "declared_counts")), "declared", "left").join(_small(hosts), "host", "left")
    return joined.select("key", "host", "declared", "tens", "best", "declared_counts", "suffix_counts", "domain_counts", "host_counts").mapInArrow(run, "key long, lang string, posterior double, text_lang string")


def identify_pages(pages: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, lang, posterior, text_lang) of each row of pages (page_id, url, html); texts of docs teach the languages.

    A null or empty page has no text and no declaration, a null or malformed url no host and no suffix: what is missing counts for
    nothing, and a page with none of them is und. Repeated rows get equal results; columns of other names are ignored. Pages with one id
    are identified each by itself. An empty table gives no rows.
    """
    model = fit_text(docs)
    rows = pages.select(F.col("page_id").cast("long").alias("key"), F.col("html").alias("text"), declared_of(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host"))
    fused = fuse(scratch.save(text_evidence(rows, model, html=True)), model, scratch)
    return scratch.save(fused.withColumnRenamed("key", "page_id"), keep=True)


def keep_known(docs: DataFrame, model: TextModel, scratch: Scratch, least: float = 0.5, scale: float = 50.0, strength: float = 5.0) -> DataFrame:
    """docs (with text, lang and source) without rows in no known language; all columns stay. Only counts are kept in scratch.

    The fusion is that of pages: lang is the declared language and source stands for the host. A row goes if it has no letters, or if the
    posterior of the known languages is below least: no language explains the text better than chance does, and
    neither declaration nor source outweighs that. Null lang or source is no evidence.
    """
    names = [*model.languages, UNKNOWN]
    rows = docs.select(F.lit(None).cast("long").alias("key"), "text", F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"))
    evidence = text_evidence(rows, model, html=False, scale=scale).select("declared", "host", "best").where("best IS NOT NULL")
    seen = scratch.save(evidence.groupBy("declared", "host", "best").agg(F.count("*").alias("n")))
    fusion = Fusion(names, _totals(seen, names), strength)
    tables = [scratch.save(_counts(seen, by, f"_corploom_{by}").withColumnRenamed(by, f"_key_{by}"), keep=True) for by in ("declared", "host")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.schema.names
            *kept, declared, host = range(len(given))
            mask = []
            pairs = lambda x: [(p["best"], p["n"]) for p in x.as_py() or ()]
            for text, lang, d, h in zip(batch.column(given.index("text")), batch.column(given.index("lang")), batch.column(declared), batch.column(host), strict=True):
                x = _table_of(*model.log_likelihoods(np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)), scale)
                if not x:
                    mask.append(False)
                    continue
                lang = lang.as_py()
                logs = fusion.logs(x, names[int(np.argmax(x))], None if lang is None else str(lang), pairs(d), [pairs(h)])
                p = np.exp(logs - logs.max())
                mask.append(bool(1 - p[-1] / p.sum() >= least))
            yield batch.select(kept).filter(pa.array(mask, pa.bool_()))

    declared, host = map(_small, tables)
    joined = docs.join(declared, docs["lang"].cast("string") == declared["_key_declared"], "left").join(host, docs["source"].cast("string") == host["_key_host"], "left")
    joined = joined.select(*[docs[c] for c in docs.columns], declared["_corploom_declared"], host["_corploom_host"])
    return joined.mapInArrow(run, docs.schema)
