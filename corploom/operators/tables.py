"""Tables that a plan reads more than once, written where driver and executors both see them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="corploom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the folder is the cluster's to clean
        pass


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the folder of spark.checkpoint.dir, which goes when the driver ends. Reading it again recomputes nothing."""
    path = f"{_folder(df.sparkSession)}/corploom-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
