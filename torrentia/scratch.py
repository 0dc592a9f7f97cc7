"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and the master is local (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _local[0]


def large(df: DataFrame) -> DataFrame:
    """df, which grows with the input: joins with it merge sorted rows. By the size of its files, or of what it is exploded from, Spark would broadcast it through the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over as many tasks as a shuffle has, by columns or evenly: for rows of one file that are about to multiply or to cost much."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors can be replaced. It counts as large."""
    path = f"{folder(df.sparkSession)}/torrentia-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = large(df.sparkSession.read.schema(df.schema).parquet(path))
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by written() that no later query reads."""
    path = getattr(df, "_scratch", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
