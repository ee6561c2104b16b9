"""Ingestion of posts in runs, with duplicates by five keys, counters, a cursor and a run table.

A post is a duplicate if an earlier post that was taken in, or a record that was staged
before, has one of its keys. In this order they give the reason: the id of an ingested
post, its URL, the id that a staged record's URL names, a staged record's URL, and the
normalised text.

Every key is state of a stream: one value says whether an ingested post or a staged record
has it. A run is one micro-batch. It reads the new posts and, as a second source, the keys
of what earlier runs took in, so no run reads the table of posts, and the cost of a run
follows its own posts. Within the run posts are decided in their order, each after all that
share a key with it.

A batch writes its own folders, which a replay overwrites, before Spark commits it, and
keys are only read by later batches. So a run that was killed leaves the same tables when
it is run again. The run table is written last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.classify import classified
from ..functions.text import normalized_title
from ..functions.urls import normalize_url
from ..operators.dedup import page_titles
from ..plans.model import query, tables
from ..sources.store import drop, stored, work_folder

POST = "post long, url string, text string"
KEYS = "kind string, key string, bits int"
INGESTED, STAGED = 1, 2
#: Reasons in the order in which they are looked for: a kind of key, and who has to have it.
REASONS = (("ingested_id", "id", INGESTED), ("ingested_url", "url", INGESTED), ("staged_id", "ref", STAGED), ("staged_url", "url", STAGED), ("text", "text", INGESTED | STAGED))
#: Which bits a post that is taken in gives to its keys.
GIVES = {"id": INGESTED, "url": INGESTED | STAGED, "ref": STAGED, "text": INGESTED | STAGED}
_ROWS = "kind string, key string, post long, place int, url string, text string, bits int"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(posts: DataFrame) -> DataFrame:
    """(kind, key, post, place, url, text) of each key of posts (post, url, text); url and text come with the id, whose row each post has."""
    ref = F.regexp_extract(F.coalesce("url", F.lit("")), "/([0-9]+)", 1)
    values = {"id": F.col("post").cast("string"), "url": F.coalesce(normalize_url(F.col("url")), F.lit("")), "ref": ref, "text": normalized_title(F.coalesce("text", F.lit("")))}
    each = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), value.alias("key")) for kind, value in values.items()))).alias("k")
    rows = posts.select("post", "url", "text", each).select("k.kind", "k.key", "post", F.when(F.col("k.kind") == "id", 0).otherwise(1).alias("place"), "url", "text")
    own = lambda c: F.when(F.col("place") == 0, F.col(c)).alias(c)
    return rows.where("key <> ''").select("kind", "key", "post", "place", own("url"), own("text"))


def given(posts: DataFrame, ingested: bool = True) -> DataFrame:
    """(kind, key, bits) of posts taken in, or of records that are only staged."""
    bits = F.create_map(*(F.lit(x) for kind, b in GIVES.items() for x in (kind, b if ingested else b & STAGED)))
    return keyed(posts).select("kind", "key", bits[F.col("kind")].alias("bits")).where("bits > 0")


class KnownKeys(StatefulProcessor):
    """Passes posts' rows on, then the key's bits in a row of post -1; rows with bits are keys to remember."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._known = handle.getValueState("known", "bits int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:  # noqa: N802 - Spark's name
        # Most keys have one row, so rows come one by one; a frame for each would cost more than all the rest.
        held = self._known.get()
        before = held[0] if held else 0
        bits, asked = before, False
        for r in rows:
            if r["bits"] > 0:
                bits |= r["bits"]
            else:
                asked = True
                yield r
        if bits != before:
            self._known.update((bits,))
        if asked and bits:
            yield Row(kind=key[0], key=key[1], post=-1, place=1, url=None, text=None, bits=bits)

    def close(self) -> None:
        pass


def decided(rows: DataFrame) -> DataFrame:
    """(post, reason) of every post of one run, null if it is taken in, from its rows and those of known keys.

    A post is taken in if none of its keys is known and no earlier one that shares a
    key is taken in; it waits for those that are open. Each round looks once at every
    key. Which key gives the reason is looked up when all is decided.
    """
    known = rows.where("post = -1").select("kind", "key", F.col("bits").alias("known"))
    each, at_each = stored(rows.where("post <> -1").select("kind", "key", "post").distinct().join(known, ["kind", "key"], "left"), "sync-keys")
    hits = lambda bits: F.array_compact(F.array(*(F.when((F.col("kind") == kind) & (bits.bitwiseAND(b) > 0), F.lit(name)) for name, kind, b in REASONS)))
    known_hit = F.max(F.size(hits(F.coalesce("known", F.lit(0)))) > 0)
    told, at_told = stored(each.groupBy("post").agg(F.when(known_hit, False).alias("taken")), "sync-told")
    while not told.where("taken is null").isEmpty():
        state = each.select("kind", "key", "post").join(told, "post")
        per_key = state.groupBy("kind", "key").agg(F.min(F.when(F.col("taken"), F.col("post"))).alias("first"), F.min(F.when(F.col("taken").isNull(), F.col("post"))).alias("waiting"))
        seen = state.where("taken is null").join(per_key, ["kind", "key"]).groupBy("post").agg(F.max(F.coalesce(F.col("first") < F.col("post"), F.lit(False))).alias("hit"), F.max(F.col("waiting") < F.col("post")).alias("waits"))
        now = F.coalesce("taken", F.when(F.col("hit"), False).when(~F.col("waits"), True))
        next_, path = stored(told.join(seen, "post", "left").select("post", now.alias("taken")), "sync-told")
        drop(told, at_told)
        told, at_told = next_, path
    first = each.join(told.where("taken"), "post").groupBy("kind", "key").agg(F.min("post").alias("first"))
    gives = F.create_map(*(F.lit(x) for item in GIVES.items() for x in item))
    bits = F.coalesce("known", F.lit(0)).bitwiseOR(F.when(F.col("first") < F.col("post"), gives[F.col("kind")]).otherwise(0))
    found = each.join(first, ["kind", "key"], "left").groupBy("post").agg(F.flatten(F.collect_list(hits(bits))).alias("hits"))
    return found.select("post", F.coalesce(*(F.when(F.array_contains("hits", name), F.lit(name)) for name, _, _ in REASONS)).alias("reason"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


DECISIONS = f"{POST}, reason string, status string, batch long"
RUNS = "run long, status string, fetched long, new_posts long, duplicates long, review_required long, non_activity long, errors long, cursor long"


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Every post of every run, with the reason if it is a duplicate, its status if it was taken in, or status ``ERROR``."""
    at = f"{folder}/decisions"
    return spark.read.schema(DECISIONS).option("basePath", at).parquet(at) if _exists(spark, at) else spark.createDataFrame([], DECISIONS)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The run table: the last state of each run, ``running`` if it never ended."""
    at = f"{folder}/runs"
    if not _exists(spark, at):
        return spark.createDataFrame([], RUNS)
    last = F.max(F.struct((F.col("status") != "running").alias("ended"), *(c.split()[0] for c in RUNS.split(", ")[1:]))).alias("m")
    return spark.read.schema(RUNS).parquet(at).groupBy("run").agg(last).select("run", *(f"m.{c.split()[0]}" for c in RUNS.split(", ")[1:]))


def cursor(spark: SparkSession, folder: str) -> int | None:
    """The last post of the runs that ended: where a next fetch begins."""
    return runs(spark, folder).where("status in ('completed', 'partial')").agg(F.max("cursor")).first()[0]


def sync(posts: DataFrame, folder: str, staged: DataFrame | None = None, fail: Callable[[str], None] = lambda step: None) -> None:
    """One run over a stream of posts (post, url, text) into the tables below ``folder``.

    ``staged`` records are known before the first run. A post without URL and text is an
    error: it is counted and does not stop the run. ``fail`` is called with the name of
    each step, for tests.
    """
    spark = posts.sparkSession
    keys = f"{folder}/keys"
    if not _exists(spark, keys):
        first = given(staged, ingested=False) if staged is not None else spark.createDataFrame([], KEYS)
        first.distinct().write.mode("overwrite").parquet(f"{keys}/staged")
    number = (runs(spark, folder).agg(F.max("run")).first()[0] or 0) + 1
    counted = dict.fromkeys(("fetched", "new_posts", "duplicates", "review_required", "non_activity", "errors"), 0)
    counted["cursor"] = None

    def row(status: str) -> DataFrame:
        return spark.createDataFrame([(number, status, *counted.values())], RUNS).coalesce(1)

    row("running").write.mode("append").parquet(f"{folder}/runs")
    new = keyed(posts.select("post", "url", "text")).select("*", F.lit(0).alias("bits"))
    feed = spark.readStream.schema(KEYS).option("recursiveFileLookup", True).parquet(keys)
    both = feed.select("kind", "key", F.lit(-1).cast("long").alias("post"), F.lit(1).alias("place"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("text"), "bits").unionByName(new)
    answered = both.groupBy("kind", "key").transformWithState(KnownKeys(), _ROWS, "append", "none")

    def take(batch: DataFrame, at: int) -> None:
        held, path = stored(batch, "sync-batch")
        told = decided(held)
        fail("decided")
        content = held.where("place = 0").groupBy("post").agg(F.min(F.struct("url", "text")).alias("m")).select("post", "m.url", "m.text")
        bad = F.coalesce("url", F.lit("")) == F.lit("")
        judged = content.join(told, "post").withColumn("error", bad & (F.coalesce("text", F.lit("")) == ""))
        fresh = classified(judged.where("reason is null and not error").select(F.col("post").alias("id"), "text")).select(F.col("id").alias("post"), "status")
        full = judged.join(fresh, "post", "left").select("post", "url", "text", "reason", F.when(F.col("error"), F.lit("ERROR")).otherwise(F.col("status")).alias("status"))
        told_of = Observation("sync")
        status = F.coalesce("status", F.lit(""))
        taken = F.col("reason").isNull() & (status != "ERROR")
        measures = (
            F.count("*").alias("fetched"),
            F.count_if(taken).alias("new_posts"),
            F.count_if(F.col("reason").isNotNull() & (status != "ERROR")).alias("duplicates"),
            F.count_if(status == "REVIEW_REQUIRED").alias("review_required"),
            F.count_if(status == "NON_ACTIVITY").alias("non_activity"),
            F.count_if(status == "ERROR").alias("errors"),
            F.max("post").alias("cursor"),
        )
        full.observe(told_of, *measures).write.mode("overwrite").parquet(f"{folder}/decisions/batch={at}")
        fail("written")
        mine = spark.read.schema(f"{POST}, reason string, status string").parquet(f"{folder}/decisions/batch={at}")
        given(mine.where("reason is null and status <> 'ERROR'")).distinct().write.mode("overwrite").parquet(f"{keys}/batch-{at}")
        for name, n in told_of.get.items():
            counted[name] = max(counted[name] or 0, n or 0) if name == "cursor" else counted[name] + n
        drop(batch, path)
        fail("kept")

    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    try:
        stream = answered.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
    except Exception:
        row("failed").write.mode("append").parquet(f"{folder}/runs")
        raise
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    row("partial" if counted["errors"] else "completed").write.mode("append").parquet(f"{folder}/runs")


#: Runs in which the query below takes the pages.
PARTS = 3


def synced_pages(spark: SparkSession, d: str) -> str:
    """Take all pages in ``PARTS`` runs, as posts of their URL and title; one in ten is staged before. Returns the folder of the tables."""
    folder = work_folder(spark, "sync")
    # Pages are read once; every run takes its part from this table.
    posts, at = stored(page_titles(spark, d).select(F.col("id").alias("post"), "url", F.col("title").alias("text")), "sync-posts")
    for k in range(PARTS):
        posts.where((F.col("post") % 10 != 0) & (F.col("post") % PARTS == k)).write.parquet(f"{folder}/arrived/{k}")
        arrived = spark.readStream.schema(POST).option("recursiveFileLookup", True).parquet(f"{folder}/arrived")
        sync(arrived, folder, posts.where("post % 10 = 0"))
    drop(posts, at)
    return folder


@query("t02_sync_pages")
def sync_pages(spark: SparkSession, d: str) -> DataFrame:
    """What became of every page: taken in, or a duplicate and why."""
    return decisions(spark, synced_pages(spark, d)).select(F.col("post").alias("page_id"), "batch", "reason", "status")


@query("t03_sync_runs")
def sync_runs(spark: SparkSession, d: str) -> DataFrame:
    """Counters and state of each run over the pages."""
    return runs(spark, synced_pages(spark, d))
