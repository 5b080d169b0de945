"""Lineage cuts: Parquet tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary folder only for a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="corploom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended: the folder is the cluster's to clean
        pass


#: Rows that go to Python at once while an operator works, unless the session has a number of its own: whole texts are long, and both sides hold a batch.
BATCH_ROWS, _BATCH, _DEFAULT = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


class Scratch:
    """Tables of one operator call. On leaving, all but those marked keep=True go; kept ones go at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.batch: str | None = None
        self.root = f"{shared_dir(spark).rstrip('/')}/corploom-{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.loose: list[str] = []
        self.tables: dict[int, str] = {}

    def __enter__(self) -> "Scratch":
        if self.spark.conf.get(_BATCH) == _DEFAULT:
            self.batch = self.spark.conf.get(_BATCH)
            self.spark.conf.set(_BATCH, str(BATCH_ROWS))
        return self

    def __exit__(self, *exc: object) -> None:
        if self.batch is not None:  # the session is left as it was
            self.spark.conf.set(_BATCH, self.batch)
        for path in self.loose:
            _delete_quietly(self.spark, path)

    def save(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """Write df and return the reader of what was written."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.mode("overwrite").parquet(path)
        if keep:
            atexit.register(_delete_quietly, self.spark, self.root)
        else:
            self.loose.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = path
        return out

    def discard(self, df: DataFrame) -> None:
        """Delete df, a table that save() returned and nothing will read again, before the end."""
        path = self.tables.pop(id(df), None)
        if path in self.loose:
            self.loose.remove(path)
            _delete_quietly(self.spark, path)
