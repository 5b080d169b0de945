import random

import pytest
from corploom.operators import bands, combinators, spans, vocab
from pyspark.sql import functions as F

POINTS, INTERVALS = "p long, g string, t long", "g string, b long, e long, name string"


def tables(seed=4):
    rng = random.Random(seed)
    points = [(k, rng.choice(["x", "y"]), rng.randrange(-50, 200)) for k in range(300)]
    points += [(1000 + k, "x", 17) for k in range(150)] + [(2000, None, 3), (2001, "x", None), (2002, "z", 3), (3, "x", 17), (3, "x", 17)]
    intervals = [(rng.choice(["x", "y"]), b := rng.randrange(-60, 200), b + rng.choice([0, 1, 2, 7, 30]), f"i{k}") for k in range(120)]
    intervals += [("x", -1000, 1000, "all"), ("x", 15, 20, "twice"), ("x", 15, 20, "twice"), ("x", 9, 3, "reversed"), (None, 0, 9, "no group"), ("x", None, 9, "no begin"), ("y", 5, None, "no end"), ("w", 0, 9, "alone")]
    return points, intervals


def expected(points, intervals, by, how):
    out = []
    for p, g, t in points:
        hits = [(p, g, t, b, e, n) for h, b, e, n in intervals if t is not None and b is not None and e is not None and b <= t < e and (not by or (g is not None and g == h))]
        out += hits or ([(p, g, t, None, None, None)] if how == "left" else [])
    return sorted(out, key=str)


@pytest.mark.parametrize("by", [("g",), ()])
@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("options", [{}, {"width": 4}, {"few": 5, "share": 20}, {"few": 1000, "width": 1}, {"few": 0, "share": 1}, {"few": 0, "share": None}])
def test_band_join_is_the_nested_loop(spark, by, how, options):
    points, intervals = tables()
    left, right = spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS)
    out = bands.band_join(left, right if by else right.drop("g"), "t", "b", "e", by, how, **options)
    assert out.columns == ["p", "g", "t", "b", "e", "name"]
    assert sorted(map(tuple, out.collect()), key=str) == expected(points, intervals, by, how)


def test_band_join_of_nothing(spark):
    points, intervals = tables()
    left, right = spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS)
    for few in (0, 100):
        assert bands.band_join(left.limit(0), right, "t", "b", "e", ("g",), few=few).collect() == []
        assert bands.band_join(left, right.limit(0), "t", "b", "e", ("g",), few=few).collect() == []
        assert bands.band_join(left, right.limit(0), "t", "b", "e", ("g",), "left", few=few).count() == len(points)
    with pytest.raises(ValueError):
        bands.band_join(left, right, "t", "b", "e")
    with pytest.raises(ValueError):
        bands.band_join(left, right, "t", "b", "e", ("g",), "outer")


def test_bins_are_at_most_three_an_interval(spark):
    rng = random.Random(9)
    rows = [(b := rng.randrange(10**6), b + rng.choice([1, 2, 3, 10, 10_000])) for _ in range(400)] + [(0, 10**9)]
    df = spark.createDataFrame(rows, "b long, e long")
    width = bands.bin_width(df, "b", "e")
    assert sum((e - 1) // width - b // width + 1 for b, e in rows) <= 3 * len(rows)
    assert bands.bin_width(df.limit(0), "b", "e") == 1


def test_the_plan_has_no_nested_loop(spark):
    points, intervals = tables()
    left, right = spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS)
    for options in ({}, {"few": 0, "share": 20}):
        plan = bands.band_join(left, right, "t", "b", "e", ("g",), **options)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_places_of_overlapping_spans(spark):
    rows = spark.createDataFrame([(s, p, 10 * s + p) for s in (1, 2) for p in range(9)], "seq_id long, pos int, token_id int")
    found = spans.span_places(rows, spark.createDataFrame([(1, 2, 5, 1), (1, 4, 99, 2), (3, 0, 9, 1)], "seq_id long, beg long, end long, span_rank int"))
    want = [(1, p, 10 + p, 1, p - 2) for p in (2, 3, 4)] + [(1, p, 10 + p, 2, p - 4) for p in range(4, 9)]
    assert sorted(tuple(r[c] for c in ("seq_id", "pos", "token_id", "span_rank", "span_pos")) for r in found.collect()) == sorted(want)


def test_clusters_by_coverage(spark):
    counts = [0, 40, 30, 10, 10, 5, 5]
    words = spark.createDataFrame(list(enumerate(counts)), "token_id int, cnt long")
    cutoffs = vocab.coverage_cutoffs(words, [1, 2], 2)
    assert sorted(map(tuple, cutoffs.collect())) == [(0, 0, 3), (1, 3, 7)]
    got = vocab.cluster_join(spark.createDataFrame([(0,), (2,), (3,), (6,), (7,), (None,)], "token_id int"), cutoffs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(0, 0, 0), (2, 0, 2), (3, 1, 0), (6, 1, 3), (7, None, None), (None, None, None)], key=str)


@pytest.mark.parametrize("n,buffer_size", [(0, 8), (1, 8), (5, 64), (100, 3), (100, 4), (1000, 64), (997, 33)])
def test_buffered_shuffle_keeps_rows_near(spark, n, buffer_size):
    rows = spark.range(n).withColumnRenamed("id", "i").withColumn("name", F.concat(F.lit("r"), "i"))
    moved = {r["i"]: r["slot"] for r in combinators.buffered_shuffle(rows, "i", buffer_size, ["name"], 3).collect()}
    assert sorted(moved.values()) == list(range(n)) and all(abs(i - s) < buffer_size for i, s in moved.items())
    again = {r["i"]: r["slot"] for r in combinators.buffered_shuffle(rows.repartition(7), "i", buffer_size, ["name"], 3).collect()}
    assert moved == again
    if n >= 900 and buffer_size > 30:
        half = buffer_size // 2
        crossed = sum(i // half != s // half for i, s in moved.items())
        assert crossed > n / 5 and sum(i == s for i, s in moved.items()) < n / 5
        assert moved != {r["i"]: r["slot"] for r in combinators.buffered_shuffle(rows, "i", buffer_size, ["name"], 3, F.lit(1)).collect()}
