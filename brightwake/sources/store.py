"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in plain local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="brightwake-")
        _local[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/brightwake/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """``df`` written to a shared table and read back, and the table's folder; rows of equal columns ``by`` lie in files of their own."""
    path = work_folder(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored_table(df: DataFrame, label: str) -> DataFrame:
    """The same without the folder, for tables that later plans read."""
    return stored(df, label)[0]


def drop(df: DataFrame, path: str) -> None:
    """Delete the folder of a stored table that no later plan reads."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
