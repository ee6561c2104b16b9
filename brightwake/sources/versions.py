"""Versions of tables that change together, a lock for the one run that may change them, and marks that are set once.

A version is visible once its mark exists. The mark is made last, whole, and only if no
mark of that number is there, so a run that is killed leaves nothing that is read, and of
two runs that write the same version one fails.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another run has written the version first."""


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    at, fs = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Make a file with its content in one step; false, and nothing changed, if the path is taken."""
    at, fs = _at(spark, path)
    fs.mkdirs(at.getParent())
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    if fs.getUri().getScheme() == "file":
        # A rename replaces files here; a second link to a name that is taken fails.
        ours, theirs = _at(spark, draft)[0].toUri().getPath(), at.toUri().getPath()
        with open(ours, "x", encoding="utf-8") as f:
            f.write(content)
        try:
            os.link(ours, theirs)
        except FileExistsError:
            return False
        finally:
            os.unlink(ours)
        return True
    written = _at(spark, draft)[0]
    out = fs.create(written, False)
    out.write(bytearray(content, "utf-8"))
    out.close()
    if not fs.exists(at) and fs.rename(written, at):
        return True
    fs.delete(written, False)
    return False


def _content(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


class Versions:
    """A folder of versions, each a set of named tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def latest(self) -> int | None:
        """Number of the newest version; none if nothing was committed."""
        done = [int(n.removeprefix("done-")) for n in _names(self.spark, f"{self.folder}/marks") if n.startswith("done-") and n[5:].isdigit()]
        return max(done, default=None)

    def read(self, number: int | None = None) -> dict[str, DataFrame]:
        """Tables of a version, by default the newest; no tables if there is none."""
        number = self.latest() if number is None else number
        if number is None:
            return {}
        told = json.loads(_content(self.spark, f"{self.folder}/marks/done-{number}"))
        schema = {n: T.StructType.fromJson(s) for n, s in told["schemas"].items()}
        return {n: self.spark.read.schema(s).parquet(f"{told['folder']}/{n}") for n, s in schema.items()}

    def commit(self, tables: dict[str, DataFrame], after: int | None) -> int:
        """Write all tables, then show them as the version after ``after`` (none: the first)."""
        number = 0 if after is None else after + 1
        folder = f"{self.folder}/data/{number}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        mark = json.dumps({"folder": folder, "schemas": {n: df.schema.jsonValue() for n, df in tables.items()}})
        if not create_once(self.spark, f"{self.folder}/marks/done-{number}", mark):
            raise Conflict(f"version {number} of {self.folder} was written by another run")
        return number


@contextmanager
def single_flight(spark: SparkSession, path: str, stale_after: float = 6 * 3600) -> Iterator[bool]:
    """Whether this run may act: false while another holds the lock.

    A lock older than ``stale_after`` seconds is that of a run that died; whoever moves it
    away first may try for a new one. A run gives back only its own lock.
    """
    at, fs = _at(spark, path)
    mine = json.dumps({"run": uuid.uuid4().hex, "since": time.time()})
    held = create_once(spark, path, mine)
    if not held and fs.exists(at) and time.time() - json.loads(_content(spark, path))["since"] > stale_after:
        if fs.rename(at, _at(spark, f"{path}.{uuid.uuid4().hex}.stale")[0]):
            held = create_once(spark, path, mine)
    try:
        yield held
    finally:
        if held and fs.exists(at) and _content(spark, path) == mine:
            fs.delete(at, False)


def notify_once(spark: SparkSession, folder: str, runs: DataFrame) -> str | None:
    """The latest completed run (run, state, finished, new) with new rows, if nobody was told of it; the mark that is left is the memory.

    Of runs that finished together the greatest name is the latest.
    """
    latest = runs.where("state = 'completed' and new > 0").orderBy(runs["finished"].desc(), runs["run"].desc()).limit(1).collect()
    if latest and create_once(spark, f"{folder.rstrip('/')}/told-{latest[0]['run']}", str(latest[0]["finished"])):
        return latest[0]["run"]
    return None
