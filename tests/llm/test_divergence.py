"""Source divergence against plain counting with Python's whole numbers."""

import random
import re
from collections import Counter, defaultdict

from corploom.llm.divergence import divergence, kept_terms, term_counts
from corploom.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(docs, least=3, most=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, within, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in docs:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(found)
        within[lang].update(set(found))
    rows = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in within[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}

        all_n = Counter()
        for s in sources:
            all_n.update(counts[lang, s])
        q, p = shares(all_n), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                rows += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:limit], 1)]
    return sorted(rows)


def run(spark, docs, schema=SCHEMA, partitions=3, **options):
    with Scratch(spark, "t") as scratch:
        df = divergence(spark.createDataFrame(docs, schema).repartition(partitions), scratch, **options)
        assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
        return sorted(tuple(r) for r in df.collect())


def fixture(seed, n=80):
    rng = random.Random(seed)
    words = ["the", "The", "ab", "é", "É", "straße", "中文", "x1y", "don't", "a-b", "z" * 3000, "Ω"] + [f"w{'abcdefghij'[k]}" for k in range(10)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "S3", None, ""])) for k in range(n)]
    docs += [docs[3], docs[3], (None, "the ab", "en", "s9"), (7, None, "en", "only null"), (8, "123 456", "de", "lonely"), (9, "", "de", "other")]
    return docs


def test_brute_force(spark):
    for seed in range(2):
        docs = fixture(seed)
        assert run(spark, docs) == brute(docs)


def test_ranks_end_and_tables_without_sums(spark):
    docs = fixture(5)
    assert run(spark, docs, most_terms=3, least=1, most_sums=0) == brute(docs, 1, 3)


def test_partitions_and_early_rows(spark):
    docs = fixture(6, 40)
    assert run(spark, docs, partitions=1) == run(spark, docs, partitions=7) == brute(docs)
    few = term_counts(spark.createDataFrame(docs, SCHEMA).repartition(2), most=10)
    got = Counter()
    for r in few.collect():
        got[r["lang"], r["source"], r["term"]] += r["n"]
    whole = Counter()
    for r in term_counts(spark.createDataFrame(docs, SCHEMA).repartition(1)).collect():
        whole[r["lang"], r["source"], r["term"]] += r["n"]
    assert got == whole


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None, None), (2, "", None, None)]) == []
    docs = fixture(7, 30)
    wide = [(*d, 1, "x", 2, "y", 3, 4) for d in docs]
    assert run(spark, wide, SCHEMA + ", bucket int, term string, n int, part string, rank int, kept int") == brute(docs)


def test_hot_term_and_source(spark):
    docs = [(k, "hot hot " + ("cold" if k % 9 == 0 else ""), "en", "big" if k % 3 else f"s{k % 12}") for k in range(600)]
    assert run(spark, docs) == brute(docs)


def test_runs_longer_than_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [("en", t, f"s{k % 3}", k, 1, 2) for t, n in (("a", 1), ("hot", 100), ("m", 2), ("n", 7), ("z", 40)) for k in range(n)]
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        counts = spark.createDataFrame(rows, "lang string, term string, source string, document long, documents long, n long")
        got = sorted((r["term"], r["sources"], r["ns"]) for r in kept_terms(counts, 3).collect())
    finally:
        spark.conf.set(name, before)
    want = [(t, ["s0", "s1", "s2"], [2 * len(range(k, n, 3)) for k in range(3)]) for t, n in (("hot", 100), ("n", 7), ("z", 40))]
    assert got == want
