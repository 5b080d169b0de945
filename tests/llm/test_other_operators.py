import math
import random
import tracemalloc

import numpy as np
from corploom.llm.ann import nearest
from corploom.llm.chat import render, rotate
from corploom.llm.components import components
from corploom.llm.pq import _centroids, _nearest, fit, near_vectors
from corploom.llm.scratch import Scratch
from corploom.llm.words import document_shingles, flat_shingles
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int"


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(400 + k, 401 + k) for k in range(40)] + [(500, 500 + k) for k in range(60)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    with Scratch(spark, "t") as s:
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), s).collect()}
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert got == want
    with Scratch(spark, "t") as s:
        assert components(spark.createDataFrame([], "a long, b long"), s).collect() == []


def test_shingles_do_not_cross_rows_and_chunks():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "A b\tC", "x " * 700_000, "a b c"]
    alone = [next(iter(document_shingles(pa.array([t]), 3)))[1].tolist() for t in texts]
    assert [s.tolist() for _, s in document_shingles(pa.array(texts), 3)] == alone
    assert set().union(*map(set, alone)) == {int(x) for part in flat_shingles(pa.array(texts), 3) for x in part}
    assert alone[-1] == alone[301]


def vectors(seed=1, n=250):
    rng = np.random.default_rng(seed)
    rows = []
    hot = rng.normal(size=16)
    for k in range(n):
        v = hot + 0.12 * rng.normal(size=16) if k % 3 == 0 else rng.normal(size=16)
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(1000 + k, rows[4][1], rows[4][2]) for k in range(9)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [float("inf")] + [1.0] * 15, 1), (2004, [None] + [1.0] * 15, 1), (2005, rows[4][1], None), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (None, rows[4][1], rows[4][2]), (7, rows[7][1], rows[7][2])]
    return rows


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_vectors(spark):
    rows = vectors()
    with Scratch(spark, "t") as s:
        got = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit(1)), s, 0.93).collect()), key=str)
        exact = near_vectors(spark.createDataFrame(rows, VECTORS), s, 0.93, deviations=math.inf).collect()
    assert got == sorted(map(tuple, exact), key=str)
    ok = [usable(v) and label is not None and k is not None for k, v, label in rows]
    linked = {a: [b for b in range(len(rows)) if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= 0.93] for a in range(len(rows))}
    want = []
    for a, row in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        c = min(rows[b][0] for b in seen) if row[0] is not None else None
        want.append((row[0], len(linked[a]), c, None if c is None else c == row[0]))
    assert got == sorted(want, key=str)
    with Scratch(spark, "t") as s:
        assert near_vectors(spark.createDataFrame([], VECTORS), s).collect() == []


def test_centroids_in_two_levels():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    error = lambda c: ((x - c[_nearest(x, c)]) ** 2).sum()
    flat, two = _centroids(x, 300, np.random.default_rng(1)), _centroids(x, 300, np.random.default_rng(1), flat=10)
    assert 300 <= len(two) <= 300 + math.ceil(math.sqrt(300)) and error(two) < 1.1 * error(flat)
    assert _nearest(x, two).tolist() == ((two * two).sum(axis=1) - 2 * x @ two.T).argmin(axis=1).tolist()
    assert len(_centroids(x[:50], 300, rng, flat=10)) == 50


def test_the_fit_needs_little_memory():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40_000, 16))
    tracemalloc.start()
    fit(x, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # rows times lists would be 320 MB


def test_nearest(spark):
    rows = [(k, v) for k, v, _ in vectors(2)]
    queries = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    with Scratch(spark, "t") as s:
        got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame(queries, "vec_id long, embedding array<float>"), s).collect()
    hit = total = 0
    for q, v in queries:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        if not usable(v):
            assert not mine
            continue
        all_ = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), k) for k, x in rows if k is not None and k != q and usable(x) and len(x) == len(v))[:10]
        assert [r["rank"] for r in mine] == list(range(1, len(all_) + 1))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        exact = {k: d for d, k in all_}
        hit += sum(r["vec_id"] in exact for r in mine)
        total += len(all_)
    assert hit >= 0.95 * total
    with Scratch(spark, "t") as s:
        none = spark.createDataFrame([], "vec_id long, embedding array<float>")
        assert nearest(none, none, s).collect() == []


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (1, 3, "ann", None), (1, 4, None, "who?"), (1, 5, " ", "?"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, None, "bob", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))
    got = rotate(df)
    texts = {(r["conv_id"], r["perspective"]): r for r in render(got).collect()}
    assert set(texts) == {(1, "ann"), (1, "bob"), (None, "ann"), (3, "bob")}
    r = texts[1, "ann"]
    head = "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user|>name=bob\nhello<|end|>\n"
    assert r["text"] == head + "<|assistant|>\n<|end|>\n" * 2 + "<|user|>name=unknown\nwho?<|end|>\n<|user|>name=unknown\n?<|end|>\n"
    assert all(r["text"][s["start"] : s["end"]].startswith("<|assistant|>\n") for x in texts.values() for r in [x] for s in x["spans"])
    assert len(r["spans"]) == 3 and len(texts[1, "bob"]["spans"]) == 1
    for x in got.collect():
        assert texts[x["conv_id"], x["perspective"]]["text"][x["start"] :].startswith(x["rendered"])
    assert rotate(df.limit(0)).collect() == []


def test_shingles_of_sliced_columns():
    import pyarrow as pa

    texts = [None if k % 5 == 0 else " ".join(f"w{j}" for j in range(k, k + 6)) for k in range(40)]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        for a, n in ((0, 40), (7, 20), (39, 1), (10, 0)):
            got = [(k, s.tolist()) for k, s in document_shingles(column.slice(a, n), 3)]
            assert got == [(k, s.tolist()) for k, s in document_shingles(pa.array(texts[a : a + n], kind), 3)] and len(got) == n
            assert sorted(x for part in flat_shingles(column.slice(a, n), 3) for x in part.tolist()) == sorted(x for part in flat_shingles(pa.array(texts[a : a + n], kind), 3) for x in part.tolist())
