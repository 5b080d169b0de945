"""Whitening against numpy's covariance and eigenvectors."""

import math

import numpy as np
import pytest
from corploom.llm.scratch import Scratch
from corploom.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>"


def run(spark, rows, schema=SCHEMA, partitions=5, **options):
    with Scratch(spark, "t") as scratch:
        df = whiten(spark.createDataFrame(rows, schema).repartition(partitions), scratch, **options)
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        return df.collect()


def data(n=400, d=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.geomspace(4, 0.2, d) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 3
    return [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]


def check(got, rows, width, most=4):
    usable = [(k, [math.floor(256 * c) for c in v] + [0] * (width - len(v))) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, dtype=np.float64)
    cov = np.cov(x.T, bias=True).reshape(width, width)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(got) == len(usable) * min(most, width)
    signs = {}
    for k, row in usable:
        for c in range(min(most, width)):
            r = by[k, c + 1].pop()
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
            want = (np.array(row) - np.array(sums) / n) @ v[:, c] / np.sqrt(e[c])
            if abs(want) > 1e-6:
                signs.setdefault(c, np.sign(want) * np.sign(r["whitened"]))
            assert r["whitened"] == pytest.approx(want * signs.get(c, 1), abs=1e-7)
            assert r["explained"] == pytest.approx(e[c] / np.trace(cov), rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9


def test_against_numpy(spark):
    rows = data()
    check(run(spark, rows), rows, 12)
    check(run(spark, rows, partitions=40), rows, 12)  # several levels of merges


def test_repeats_nulls_and_clashing_columns(spark):
    rows = data(60, 5) + [(900 + k, data(60, 5)[3][1]) for k in range(200)]
    rows += [(7, data(60, 5)[7][1]), (None, [0.0] * 5), (None, [-0.0] * 5), (2000, None), (2001, [None] + [1.0] * 4), (2002, [float("nan")] * 5), (2003, [float("inf")] * 5)]
    wide = [(k, v, 1, 2.0, "x") for k, v in rows]
    check(run(spark, wide, SCHEMA + ", x int, n double, component string"), rows, 5)


def test_few_dimensions_and_lengths(spark):
    rows = data(50, 2)
    check(run(spark, rows), rows, 2)
    rows = data(80, 4) + [(500, [1.0, 2.0]), (501, []), (502, [1.0, 2.0, 0.0, 0.0])]
    check(run(spark, rows), rows, 4)


def test_without_variance(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []
    assert run(spark, [(1, [])]) == []
    got = run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, 0.0, 0.0, 0.0)] * 4
    got = run(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0])])
    assert {(r["component"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in got} == {(1, 1.0, 1.0), (2, 0.0, 0.0)} and got[0]["identity_error"] < 1e-9


def test_large_numbers(spark):
    rows = [(k, [1e15 * (k % 7), float(k), 2e14 * (k % 3)]) for k in range(40)] + [(99, [1e300, 0.0, 0.0])]
    got = run(spark, rows, "vec_id long, embedding array<double>")
    assert len(got) == 41 * 3 and all(r["deviation"] is None for r in got)
