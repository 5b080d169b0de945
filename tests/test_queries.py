"""Every registered query with a SQL twin gives DuckDB's rows, with one and with several shuffle partitions for some."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corploom.plans import corpus, evaluation, examples

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {**corpus.QUERIES, **examples.QUERIES, **evaluation.QUERIES}
SQL = {**corpus.SQL, **examples.SQL, **evaluation.SQL}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def canonical(rows, columns):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5) + 0.0
        return v

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, rows = canonical([tuple(r) for r in df.collect()], df.columns), canonical(want.fetchall(), want.columns)
    assert len(got) == len(rows)
    for a, b in zip(got, rows, strict=True):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, abs=2e-5) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_partition_independence(spark, name):
    """Queries with no SQL twin give the same rows for any number of partitions."""
    df = QUERIES[name](spark, SF)
    first = canonical([tuple(r) for r in df.collect()], df.columns)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        again = QUERIES[name](spark, SF)
        assert canonical([tuple(r) for r in again.collect()], again.columns) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    assert entry.entry(spark).columns == ["batch_id", "b", "input", "target"]
    assert set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
