import json

import pytest
from corploom.sources import cache, records
from pyspark.sql import functions as F


def encode(lines):
    return lines.select("file", F.length("line").alias("n_chars"), "line")


def texts(df):
    return sorted((r["file"].rsplit("/", 1)[1], r["line"], r["n_chars"]) for r in df.collect())


def test_only_changed_files_are_read_again(spark, tmp_path):
    source, where = tmp_path / "in", f"{tmp_path}/cache"
    source.mkdir()
    for name, text in (("a.txt", "one\ntwo"), ("b b.txt", "three\n\nthree"), ("empty.txt", "")):
        (source / name).write_text(text)
    seen = []

    def read(spark, files):
        seen.append(sorted(f.rsplit("/", 1)[1] for f in files))
        return cache.text_lines(spark, files)

    get = lambda version="": cache.cached(spark, [str(source)], where, encode, version, read)
    fresh = lambda: [s for s in seen if s != ["in"]]  # noqa: E731  reading the folder itself only gives the schema
    first = texts(get())
    assert first == [("a.txt", "one", 3), ("a.txt", "two", 3), ("b%20b.txt", "", 0), ("b%20b.txt", "three", 5), ("b%20b.txt", "three", 5)]
    assert fresh() == [["a.txt", "b b.txt"]]
    assert {r["file"].rsplit("/", 1)[1]: r["n"] for r in cache.manifest(spark, where).collect()} == {"a.txt": 2, "b%20b.txt": 3}
    runs = {r["file"].rsplit("/", 1)[1]: r["run"] for r in cache.manifest(spark, where).collect()}
    assert texts(get()) == first and len(fresh()) == 1 and cache._versions(spark, f"{where}/manifest") == [0]
    (source / "a.txt").write_text("one\ntwo and more")
    (source / "c.txt").write_text("new")
    assert [t[:2] for t in texts(get())] == [("a.txt", "one"), ("a.txt", "two and more"), ("b%20b.txt", ""), ("b%20b.txt", "three"), ("b%20b.txt", "three"), ("c.txt", "new")]
    assert fresh()[1:] == [["a.txt", "c.txt"]]
    assert {r["file"].rsplit("/", 1)[1]: r["run"] for r in cache.manifest(spark, where).collect()}["b%20b.txt"] == runs["b%20b.txt"]
    (source / "b b.txt").unlink()
    assert [t[0] for t in texts(get())] == ["a.txt", "a.txt", "c.txt"] and len(fresh()) == 2
    assert [t[0] for t in texts(get("2"))] == ["a.txt", "a.txt", "c.txt"] and fresh()[2:] == [["a.txt", "c.txt"]]


def test_a_job_that_dies_leaves_the_cache(spark, tmp_path):
    source, where = tmp_path / "in", f"{tmp_path}/cache"
    source.mkdir()
    (source / "a.txt").write_text("one\ntwo")
    first = texts(cache.cached(spark, [str(source)], where, encode))
    (source / "b.txt").write_text("three")
    # rows of a run without a manifest, and a manifest that was not ended
    spark.createDataFrame([("x", 1, "lost", "f")], "file string, n_chars int, line string, fingerprint string").write.partitionBy("fingerprint").parquet(f"{where}/rows/run=lost")
    spark.createDataFrame([("x", "f", "lost", 1)], cache.MANIFEST).write.parquet(f"{where}/manifest/v=1")
    (tmp_path / "cache" / "manifest" / "v=1" / "_SUCCESS").unlink()
    schema = encode(cache.text_lines(spark, [str(source)])).schema
    assert texts(cache.rows_of(spark, where, schema)) == first

    def failing(lines):
        return encode(lines).withColumn("line", F.when(F.col("line") == "three", F.raise_error(F.lit("lost"))).otherwise(F.col("line")))

    with pytest.raises(Exception):
        cache.cached(spark, [str(source)], where, failing)
    assert texts(cache.rows_of(spark, where, schema)) == first


def test_manifests_of_passes(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
    (tmp_path / "x" / "meta.train.pass-0.json").write_text(json.dumps({"num_batch": 10, "filenames": ["/old/a", "b", "c"]}))
    (tmp_path / "x" / "meta.train.pass-2.json").write_text(json.dumps({"num_batch": 7, "filenames": ["d"]}))
    (tmp_path / "y" / "meta.train.pass-1.json").write_text(json.dumps({"num_batch": 5, "filenames": ["e"]}))
    rows = records.read_manifests(spark, f"{tmp_path}/x, {tmp_path}/y/")
    x, y = f"{tmp_path}/x", f"{tmp_path}/y"
    got = lambda n: sorted(map(tuple, records.merged_manifests(rows, "num_batch", n).collect()))
    assert got(None) == sorted([(f"{x}/a", 4, 10), (f"{x}/b", 3, 10), (f"{x}/c", 3, 10), (f"{x}/d", 7, 7), (f"{y}/e", 5, 5)])
    assert got(2) == sorted([(f"{x}/a", 3, 6), (f"{x}/b", 3, 6), (f"{y}/e", 5, 5)])
    assert got(1) == [(f"{x}/a", 3, 3)]
    (tmp_path / "y" / "meta.train.pass-0.json").write_text(json.dumps({"filenames": ["f"]}))
    with pytest.raises(Exception, match="no filenames or counts"):
        records.read_manifests(spark, f"{tmp_path}/y").collect()
