"""Intermediate tables and files in the folder that the cluster shares.

Lineage is cut by writing a table below ``spark.checkpoint.dir``: it survives
lost executors, and reading it back gives Spark fresh size statistics. Operators
drop what none of their results reads; a caller that has stored a result can drop
the rest with ``drop_others``. Only in
plain local mode, where driver and executors are one process, is a temporary
folder used when the setting is missing.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}
_of_thread = threading.local()


def _made() -> list[str]:
    """Folders that this thread's queries made and that are not dropped yet, oldest first."""
    if not hasattr(_of_thread, "made"):
        _of_thread.made = []
    return _of_thread.made


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder for intermediate data."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if sc.applicationId not in _local_root:
            _local_root[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="brightwake-")
        root = _local_root[sc.applicationId]
    if root.startswith("/"):
        return f"file://{root}"
    return root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark).rstrip('/')}/brightwake/{label}-{uuid.uuid4().hex}"
    _made().append(path)
    return path


def stored(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """``df`` written to a shared table and read back, so that its plan starts there, and the table's folder."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The same without the folder, for tables that stay."""
    return stored(df, label, **options)[0]


def unused(names: Iterable[str], want: str) -> str:
    """A column name like ``want`` that none of ``names`` has, in any case of letters."""
    taken = {n.lower() for n in names}
    return next(n for n in (f"__{want}{k or ''}" for k in range(len(taken) + 1)) if n not in taken)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate folders that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _made():
            _made().remove(path)


def made() -> list[str]:
    """This thread's folders that exist now, to tell later which are new."""
    return list(_made())


def drop_others(spark: SparkSession, keep: list[str]) -> None:
    """Delete all folders that this thread made but those in ``keep``; for a caller whose results no longer read them."""
    drop(spark, *(path for path in made() if path not in keep))
