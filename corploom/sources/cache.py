"""A corpus that is encoded file by file: only files that are new or have changed are read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file string, fingerprint string, run string, n long"


def fingerprints(spark: SparkSession, paths: list[str], version: str = "") -> DataFrame:
    """(file, path, fingerprint) of the files of paths (files, folders or globs) from name, length and time of change alone: contents aren't read. Files
    without bytes are passed over. file is Spark's _metadata.file_path, path the name to read it by, which must hold no characters of globs. version names what the rows depend on besides (a vocabulary, a tokenizer): another version is another fingerprint."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"), "path", "length", "modificationTime")
    key = F.concat_ws("|", F.lit(version), "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return files.select("file", "path", F.sha2(key, 256).alias("fingerprint")).distinct()


def text_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, line) of text files, with file as in fingerprints()."""
    return spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests that were written to their end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = lambda name: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS"))
    return sorted(int(name[2:]) for name in names if name.startswith("v=") and name[2:].isdigit() and done(name))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, fingerprint, run, n) of the newest whole manifest of the cache at path: a row a file with its number of rows; empty where there is none."""
    found = _versions(spark, f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v={found[-1]}") if found else spark.createDataFrame([], MANIFEST)


def cached(spark: SparkSession, paths: list[str], path: str, encode: Callable[[DataFrame], DataFrame], version: str = "", read: Callable[[SparkSession, list[str]], DataFrame] = text_lines) -> DataFrame:
    """encode(read(files)) of all files of paths, from the cache at path as far as it holds them. encode keeps the column file.

    Files whose fingerprint isn't in the manifest are encoded into a run's own folder, partitioned by fingerprint; then a manifest of
    all present files is written beside the older ones. It counts once Spark has marked it whole, so that a job that dies on the way leaves the former
    cache as it was, and its rows, which no manifest names, are never read. Rows of changed, removed or otherwise versioned files aren't either. Of two
    writers at once the later one fails. Names of new files pass through the driver, their rows don't.
    """
    now = fingerprints(spark, paths, version)
    before = manifest(spark, path)
    run = uuid.uuid4().hex
    known = before.select("fingerprint", "run", "n")
    todo = now.join(known.select("fingerprint"), "fingerprint", "left_anti").select("file", "path", "fingerprint")
    fresh = todo.collect()
    found = before.select("file", "fingerprint")
    gone = found.join(now, ["file", "fingerprint"], "left_anti")
    if fresh:
        marks = spark.createDataFrame(fresh, todo.schema).drop("path")
        rows = encode(read(spark, [r["path"] for r in fresh])).join(marks, "file")
        # a file that gives no rows has no folder
        rows.write.partitionBy("fingerprint").parquet(f"{path}/rows/run={run}")
    if fresh or not gone.isEmpty() or not _versions(spark, f"{path}/manifest"):
        live = now.join(known, "fingerprint").select("file", "fingerprint", "run", "n")
        if fresh:
            written = spark.read.schema(rows.schema).parquet(f"{path}/rows/run={run}").groupBy("fingerprint").agg(F.count("*").alias("n"))
            live = live.unionByName(marks.join(written, "fingerprint", "left").select("file", "fingerprint", F.lit(run).alias("run"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))
        number = (_versions(spark, f"{path}/manifest") or [-1])[-1] + 1
        live.write.mode("errorifexists").parquet(f"{path}/manifest/v={number}")
    return rows_of(spark, path, encode(read(spark, paths)).schema)


def rows_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows that the newest manifest of the cache at path names; schema as encode gave them. Folders of other rows are pruned."""
    live = manifest(spark, path).where("n > 0").select("run", "fingerprint")
    if live.isEmpty():
        return spark.createDataFrame([], schema)
    whole = spark.read.schema(spark.createDataFrame([], schema).withColumns({"fingerprint": F.lit(""), "run": F.lit("")}).schema).parquet(f"{path}/rows")
    return whole.join(live, ["run", "fingerprint"], "left_semi").select(*[f.name for f in schema.fields])
