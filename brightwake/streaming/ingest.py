"""Incremental ingestion: micro-batches that can be replayed without effect.

Each micro-batch drops repeats of a key inside the batch, then rows whose key is
already stored, and writes what is left to a folder named by the batch. A batch
that is replayed after a failure overwrites its own folder and sees only the
folders of earlier batches, so the table is the same whether or not it failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import query, tables
from ..sources.store import work_folder


def stored(spark: SparkSession, folder: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Rows of the batches written so far (those before ``before``)."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], with_batch)
    rows = spark.read.schema(with_batch).option("basePath", folder).parquet(folder)
    return rows if before is None else rows.where(F.col("batch") < before)


def ingest(source: DataFrame, keys: list[str], order: list[str], folder: str, checkpoint: str) -> DataFrame:
    """Run a streaming source to its end; returns the table of first rows of each key."""
    spark, schema = source.sparkSession, source.schema

    def take(batch: DataFrame, number: int) -> None:
        first = batch.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in batch.columns if c not in order))).alias("m")).select("m.*").select(*batch.columns)
        known = stored(batch.sparkSession, folder, schema, number).select(*keys).distinct()
        first.join(known, keys, "left_anti").select(*schema.names).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    run = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return stored(spark, folder, schema).select(*schema.names)


@query("t02_ingest_events", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL", base=False)
def ingest_events(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type, ingested as a stream of files."""
    path = f"{d}/events.parque[t]"  # as a pattern, a single file can be a stream's source too
    source = spark.readStream.schema(tables(spark, d, "events").schema).option("maxFilesPerTrigger", 4).parquet(path)
    work = work_folder(spark, "ingest")
    found = ingest(source, ["user_id", "event_type"], ["ts", "event_id"], f"{work}/table", f"{work}/checkpoint")
    return found.select("user_id", "event_type", "event_id")


@query("x_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", base=False)
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """An extra without counterpart: hourly tumbling windows."""
    events = tables(spark, d, "events")
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
