"""Steps whose work grows with their input and no faster: no row for a pair or a place is shuffled, no task holds a shard."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corploom.functions import tokenizers as tk
from corploom.operators import batching, edits, knn, positions, renorm, spans, windows
from corploom.plans import corpus, evaluation, examples

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_that_do_not_go_on_have_no_row(spark):
    words = [[0, 10], [0, 10, 11], [1], [2, 12, 13, 14]]
    df = spark.createDataFrame([(f"w{k}", w) for k, w in enumerate(words)], "word string, pieces array<int>")
    by_key, dictionary = renorm.numbered_sets(df, renorm.flags(df))
    assert by_key.count() == len({tuple(w[:k]) for w in words for k in range(len(w))})
    assert {tuple(r["allowed"]) for r in dictionary.collect()} == {(), (0, 1, 2), (0, 1, 2, 11), (10,), (12,), (13,), (14,)}


def test_streams_are_spelled_as_words(spark):
    for turned in (False, True):
        spelled = {r["word"]: r["pieces"] for r in evaluation._words(spark, SF, turned).collect()}
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        got = {r["b"]: r["ps"] for r in evaluation._streams(spark, SF, turned).collect()}
        assert got == {b: [p for w in t.split() for p in spelled[w]] for b, t in texts.items() if t and t.split()}


def test_distributions_of_long_streams():
    b, t = np.array([7, 7], dtype=np.int64), np.array([3, 54_000], dtype=np.int32)
    assert evaluation.stream_state(b, t).tolist() == [(7 * 7919 + x * 104729) % 1000 for x in (3, 54_000)]


def test_nll_by_state_is_that_of_places(spark):
    def at_state(s, token):
        return np.where(token == 3, 900.0, token * 0.1 + s)  # beside token 3 the others vanish

    state = lambda b, t: (b + t) % 5
    sets = spark.createDataFrame([(1, [0, 3, 9]), (2, [1, 2]), (3, [])], "set_id long, allowed array<int>")
    maps = renorm.bitmaps(sets, 20)
    rows = spark.createDataFrame([(b, t, x, s) for b in range(2) for t in range(3) for x in (0, 2, 3, 25) for s in (1, 2, 3, None)], "b long, t int, target int, set_id long").withColumn("b", F.monotonically_increasing_id())
    rows = rows.localCheckpoint()
    one = renorm.nll_of_candidates(rows, maps, at_state, 20, state, 5)
    other = renorm.nll_of_candidates(rows, maps, lambda b, t, token: at_state(state(b, t), token), 20)
    one, other = ({r["b"]: r["nll"] for r in df.collect()} for df in (one, other))
    assert len(one) == 96 and one == pytest.approx(other, rel=1e-12)


def test_lists_meet_queries_in_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(0, 4, 3)], k % 7) for k in range(900)]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    queries = store.where("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    indexed, c = knn.build_ivf(store, 6)
    found = knn.search_ivf(queries, indexed, c, 10, 6)
    assert "zip_with" not in _plan(found) and "CoGroup" in _plan(found)
    x = np.array([r[1] for r in rows])
    want = []
    for q in range(0, 900, 30):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want += [(q, i + 1, int(k), rows[k][2], float(far[k])) for i, k in enumerate(np.lexsort((np.arange(900), far))[:10])]
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, knn.search(queries, store, 10).collect())) == want


@pytest.mark.parametrize("ext", [0, 3])
def test_slots_are_filled_without_a_shard_in_one_task(spark, ext):
    rng = random.Random(4)
    shards = {name: [[rng.randrange(90) for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))] for _ in range(n)] for name, n in (("a", 60), ("b", 3), (None, 25), ("", 1), ("c", 40))}
    df = spark.createDataFrame([(s, k, x) for s, own in shards.items() for k, x in enumerate(own)], "source string, doc_id long, ids array<int>").repartition(5)
    out = batching.shuffled_batches(df, "source", "doc_id", "ids", 3, 4, ext)
    assert "FlatMapGroups" not in _plan(out)
    got = {(r["shard"], r["batch_id"], r["b"]): (r["input"], r["target"]) for r in out.collect()}
    assert got == {(s, k, i): (x[i], y[i]) for s, own in shards.items() for k, (x, y) in enumerate(batching.slot_batches(own, 3, 4, ext)) for i in range(3)}


def test_pieces_of_many_texts(spark):
    assert tk.AT_ONCE < 600
    vocab = ["un", "##aff", "##able", "a", "##b"]
    texts = [None if k % 7 == 3 else "unaffable ab, " * (k % 5) for k in range(600)]
    got = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", tk.full_tokenizer(F.col("t"), vocab).alias("p")).collect()
    want = lambda t: [p for w in t.replace(",", " , ").split() for p in tk.longest_pieces(w, frozenset(vocab))]
    assert {r["k"]: r["p"] for r in got} == {k: None if t is None else want(t) for k, t in enumerate(texts)}


def test_redundant_draws_build_no_steps(monkeypatch):
    calls = []
    plain = edits.operations
    monkeypatch.setattr(edits, "operations", lambda *a: calls.append(1) or plain(*a))
    for seed in range(50):
        edits.noise(list(range(10, 138)), 0.15, np.random.default_rng(seed), 1, 2)
    assert len(calls) == 50
    for seed in range(400):
        r = np.random.default_rng(seed)
        n = int(r.integers(1, 9))
        add, delete, replace = (r.integers(0, n, int(r.integers(0, 4))).tolist() for _ in range(3))
        steps = plain(n, add, delete, replace)
        assert steps == "".join("a" * add.count(k) + ("d" if k in delete else "r" if k in replace else "o") for k in range(n))
        assert edits.redundant(n, add, delete, replace) == (bool(set(delete) & set(replace)) or any(x in steps for x in ("ar", "da", "ad")))


def test_spans_find_their_places_in_a_row(spark):
    assert "Join" not in _plan(examples.span_places(spark, SF)).replace("_join", "").split("Generate")[0]
    ids = list(range(100, 120))
    given = [(1, -3, 2), (2, 5, 5), (3, 18, 40), (4, 30, 35), (5, 4, 9), (6, 9, 3)]
    df = spark.createDataFrame([(1, ids, given), (2, [], given)], "seq_id long, ids array<int>, s array<struct<span_rank:int,beg:long,end:long>>")
    got = df.select("seq_id", F.explode(spans.places_of(F.col("ids"), F.col("s"))).alias("z")).select("seq_id", "z.*").collect()
    assert sorted(map(tuple, got)) == sorted((1, p, ids[p], r, p - b) for r, b, e in given for p in range(max(b, 0), min(e, 20)))


def test_given_windows_of_any_length(spark):
    assert "posexplode" not in _plan(corpus.QUERIES["variable_bptt"](spark, SF))
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 3, 50]) for _ in range(60)]
    stream = [rng.randrange(1000) for _ in range(sum(sizes))]
    docs = [(k, stream[sum(sizes[:k]) : sum(sizes[: k + 1])], sum(sizes[:k])) for k in range(60)]
    given = [(k, b, b + rng.choice([-1, 0, 1, 5, 300])) for k, b in enumerate(rng.randrange(len(stream)) for _ in range(80))]
    placed = spark.createDataFrame(docs, "doc_id long, ids array<int>, offset long").repartition(3)
    for width in (1, 8, 1024):
        got = windows.given_windows(placed, "ids", spark.createDataFrame(given, "k long, begin long, end long"), ("k",), width=width)
        assert {r["k"]: r["ids"] for r in got.collect()} == {k: stream[b:e] for k, b, e in given if b < e}


def test_ranges_of_keys_are_found_by_halves(spark):
    rng = random.Random(7)
    keys = [rng.choice([None, -5, 0, 3, 2**40 + rng.randrange(900), rng.randrange(3000)]) for _ in range(4000)]
    df = spark.createDataFrame([(k, i, rng.randrange(4)) for i, k in enumerate(keys)], "k long, tie long, n long").repartition(3)
    for size in (1, 2, 3, 255, 256, 1000):
        cuts = sorted(rng.sample(range(-10, 3000), size))
        got = df.select("k", positions._smaller(cuts, "k").alias("r")).collect()
        assert all(r["r"] == (0 if r["k"] is None else sum(c < r["k"] for c in cuts)) for r in got)
    out = positions.offsets(df, "k", "n", tie="tie", small=0)
    assert "filter(" not in _plan(out)  # not every cut is asked for every row
    want, at = {}, 0
    for r in sorted(df.collect(), key=lambda r: (r["k"] is not None, r["k"] or 0, r["tie"])):
        want[r["tie"]], at = at, at + r["n"]
    assert {r["tie"]: r["offset"] for r in out.collect()} == want


@pytest.mark.parametrize("by_end", [False, True])
def test_nll_of_streams_needs_no_row_for_a_place(spark, by_end):
    rng = random.Random(5)
    words = [[rng.randrange(6), *(rng.randrange(6, 12) for _ in range(rng.randrange(4)))] for _ in range(40)]
    df = spark.createDataFrame([(f"w{k}", w[::-1] if by_end else w) for k, w in enumerate(words)], "word string, pieces array<int>")
    flag, longest = renorm.flags(df).cache(), 4
    by_key, dictionary = renorm.numbered_sets(df, flag)
    maps = renorm.bitmaps(dictionary, 14)
    streams = [[], [7, 8], [13, 9, 1], *([rng.choice([rng.randrange(6), rng.randrange(6, 12), 13]) for _ in range(rng.randrange(1, 90))] for _ in range(30))]
    arrays = renorm.array_blocks(spark.createDataFrame(list(enumerate(streams)), "b long, ids array<int>").repartition(2), "ids")
    rows = [(b, t, x, rng.choice([None, -1, 99, *s])) for b, s in enumerate(streams) for t, x in enumerate(s)]
    cut = renorm.blocks(spark.createDataFrame(rows, "b long, t int, input int, target int"), flag, longest + 1, by_end, 8)
    own = lambda s, token: np.where(token == 3, 900.0, token * 0.37 + s * 0.1)
    state = lambda b, t: (b + t) % 5
    for blocks, n in ((arrays, sum(max(len(s) - 1, 0) for s in streams)), (cut, sum(r[3] is not None for r in rows))):
        one, other = (renorm.nll_of_blocks(blocks, by_key, maps, flag, longest, own, 14, state, 5, 6, by_end, most) for most in (10_000, 0))
        assert "MapInArrow" in _plan(one) and "set_id" not in _plan(one) and "set_id" in _plan(other)
        one, other = ({(r["b"], r["t"]): r["nll"] for r in out.collect()} for out in (one, other))
        assert len(one) == n and one == pytest.approx(other, abs=2e-6) and len(set(one.values())) > 20


def test_the_query_joins_no_places(spark):
    assert "Join" not in _plan(evaluation.QUERIES["renorm_nll"](spark, SF))


def test_numbers_are_rounded_as_by_spark(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-8, 14, 2000), rng.integers(-(10**8), 10**8, 2000) / 1e7, [0.0, -1e-16, np.inf, 5e-7, 1.0000005, 2.5e-6, -2.5e-6, 1e300]])
    want = [r["r"] for r in spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, v double").orderBy("k").select(F.round("v", 6).alias("r")).collect()]
    got = renorm._rounded(x, 6)
    assert got.tolist() == want and not np.signbit(got[want.index(0.0)])


def test_keys_are_found_by_their_leading_bits():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        keys = rng.permutation(np.unique(np.append(rng.integers(-(2**63), 2**63, n), np.arange(n // 100))))[: n + n // 100]
        lookup, asked = renorm._Lookup(keys), np.concatenate([keys, rng.integers(-(2**63), 2**63, 1000)])
        place = lookup.find(asked)
        where = {int(k): i for i, k in enumerate(keys)}
        assert [int(lookup.order[p]) if p >= 0 else None for p in place] == [where.get(int(k)) for k in asked]
