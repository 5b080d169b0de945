import random
import re

from corploom.llm.jaccard import near_duplicates


def brute(rows, width, num, den):
    """{row number: (size, component)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = {}
    for a in range(len(rows)):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out[a] = (len(sets[a]), min(ids) if sets[a] and ids else (rows[a][0] if not sets[a] else None))
    return sorted(((rows[a][0], *v) for a, v in out.items()), key=str)


def corpus(seed, n=60, hot=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(hot):  # a group of near copies, near the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), None, "", " \t\n", "one", "One", "one two", "x " * 5000]
    return [(k, t) for k, t in enumerate(texts)]


def test_against_brute_force(spark):
    for width, t, num, den in ((3, "0.9", 9, 10), (5, "0.8", 4, 5)):
        rows = corpus(width)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, t).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, width, num, den)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", 1), (7, "a b c d e f", 2), (7, "a b c d e f", 3), (7, "p q r s t", 4), (None, "k l m n o", 5), (9, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long").withColumnRenamed("component_id", "node")
    got = sorted(map(tuple, near_duplicates(df, 3, "0.9").collect()), key=str)
    assert got == sorted([(None, 4, 7), (7, 4, 7), (7, 4, 7), (7, 3, 7), (None, 3, None), (9, 0, 9)], key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 3, "0.9").collect() == []
