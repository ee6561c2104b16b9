"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Document rates are the exponential
tilt closest (in relative entropy) to taking every document once that meets the
targets, with rates held at ``CAP``: rate = min(CAP, exp(x * size / mean size)),
where x is the source's dual variable. The dual is convex and separates by
source; safeguarded Newton steps solve it for all sources at once, each from one
distributed aggregation over a table of (source, size, number of documents).

Sums are exact decimals, so that neither the order of rows nor the number of
partitions changes the duals. A source whose target is its cap takes every
document ``CAP`` times.

Rates become whole copies by error feedback. Equal rows are counted first and
form a class, and classes are dealt into chunks by a hash, a large class in
parts, so that neither a large source nor many equal rows make a large chunk. In
each chunk, largest documents first, a document gets the copies that bring the
running number of words closest to what the rates ask for. As a chunk ends with
its smallest documents, its error is at most about half of one of these.

Defined results: null text has size 0; a document of size 0 is taken once, with
0 words; null source is a source of its own, last in order; null ``doc_id`` rows
and repeated rows take part like any other; a source without words has target
0; an empty table gives an empty result; extra columns are ignored by the query
and kept by ``mixed``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, stored, unused, written

WEIGHTS = (5, 2, 1)
CAP = 3.0
STEPS = 60
#: Dual variables are held in this range; a source below its cap whose dual would lie beyond is as near to its target as the range allows.
REACH = 60.0
TOLERANCE = 1e-7
#: Documents of a chunk, about.
CHUNK = 256
#: Copies of a class that are written by one task, where any class has more.
SPREAD = 1000
#: Sums of rates and of their slopes are exact in this type.
_EXACT = "decimal(34,6)"


def sizes(text: str = "text"):
    """Number of words of the text."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(per_source: DataFrame, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``per_source`` (source, source_size) with each source's ``target``.

    Sources in code point order, null last, share all words by repeating
    weights; a target stops at ``cap`` times the source's size and what is over
    is shared again by weight among the others. By the ratio of weight to size,
    sources reach the cap in a fixed order, so the share is found from running sums.
    """
    alone = Window.partitionBy(F.lit(1))  # one row a source
    place = F.row_number().over(alone.orderBy(F.col("source").isNull(), "source")) - 1
    listed = per_source.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod(place, F.lit(len(weights))).cast("int")].cast("double"))
    listed = listed.withColumn("weight", F.when(F.col("source_size") > 0, F.col("weight")).otherwise(0.0))
    ratio = F.col("weight") / F.greatest(F.col("source_size"), F.lit(1))
    order = alone.orderBy(ratio.desc(), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(alone)
    left = total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rate = F.when(weight_left > 0, left / weight_left).otherwise(0.0)
    marked = listed.withColumns({"rate": rate, "capped": (F.col("weight") * rate > cap * F.col("source_size")) & (F.col("weight") > 0)})
    # The first source that stays below the cap sets the share of all that follow.
    settled = F.first(F.when(~F.col("capped") & (F.col("weight") > 0), F.col("rate")), ignorenulls=True).over(alone.orderBy(ratio.desc(), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("capped"), cap * F.col("source_size")).otherwise(F.coalesce(F.col("weight") * settled, F.lit(0.0)))
    return marked.select("source", "source_size", target.alias("target"))


def solve(histogram: DataFrame, aims: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, x, mean) with each source's dual variable, by Newton's method kept in a shrinking bracket; null x: take all at the cap.

    ``histogram`` has (source, size, n); ``aims`` has (source, target, n_docs, source_size).
    """
    spark = histogram.sparkSession
    full = (F.col("source_size") > 0) & (F.col("target") >= F.lit(cap) * F.col("source_size"))
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("n_docs")).otherwise(1.0)
    start = aims.select("source", "target", mean.alias("mean"), F.when(~full, 0.0).alias("x"), F.lit(-REACH).alias("low"), F.lit(REACH).alias("high"), (~full).alias("open"))
    state, path = stored(start, "mix-dual")
    for _ in range(STEPS):
        if state.where("open").isEmpty():
            break
        s = state.where("open").select(F.col("source").alias("s"), "mean", "x")
        each = histogram.join(s, histogram["source"].eqNullSafe(F.col("s")))
        z = F.col("x") * F.col("size") / F.col("mean")
        at_cap = z >= F.log(F.lit(cap))
        rate = F.when(at_cap, F.lit(cap)).otherwise(F.exp(z))
        slope = F.when(at_cap, F.lit(0.0)).otherwise(F.exp(z) * F.col("size") / F.col("mean"))
        exact = lambda value: F.sum((F.col("n") * F.col("size") * value).cast(_EXACT)).cast("double")
        summed = each.groupBy(F.col("s")).agg(exact(rate).alias("got"), exact(slope).alias("slope"))
        joined = state.join(summed, state["source"].eqNullSafe(F.col("s")), "left").drop("s")
        over = F.coalesce(F.col("got"), F.lit(0.0)) - F.col("target")
        low = F.when(F.col("open") & (over < 0), F.col("x")).otherwise(F.col("low"))
        high = F.when(F.col("open") & (over >= 0), F.col("x")).otherwise(F.col("high"))
        newton = F.col("x") - F.when(F.col("slope") > 0, over / F.col("slope"))
        step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        done = ~F.col("open") | (F.abs(over) <= TOLERANCE * F.greatest("target", F.lit(1.0)))
        moved = joined.select("source", "target", "mean", F.when(done, F.col("x")).otherwise(step).alias("x"), low.alias("low"), high.alias("high"), (~done & (high - low > 1e-9)).alias("open"))
        before = path
        state, path = stored(moved, "mix-dual")
        drop(spark, before)
    return state.select("source", "x", "mean")


def planned(docs: DataFrame, tag: Column) -> DataFrame:
    """(doc_id, source, size, tag, source_size, target, copies) of every document, in no order; documents that agree in the first four form a class."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "source", sizes().alias("size"), tag.alias("tag"))
    classes = written(own.groupBy("doc_id", "source", "size", "tag").agg(F.count("*").alias("rows")), "mix-classes")
    histogram, at_histogram = stored(classes.groupBy("source", "size").agg(F.sum("rows").alias("n")), "mix-histogram")
    per_source = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    told = targets(per_source.select("source", "source_size")).join(per_source.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    aims, at_aims = stored(told, "mix-targets")
    duals = solve(histogram, aims)
    told = written(aims.join(duals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s"), "mix-rates")
    drop(spark, at_histogram, at_aims)
    z = F.col("x") * F.col("size") / F.col("mean")
    rate = F.when(F.col("x").isNull() | (z >= F.log(F.lit(CAP))), F.lit(CAP)).otherwise(F.exp(z))
    # The sources' table is small beside the documents, but its size has no bound: the join is left to Spark, which splits a hot source.
    rated = classes.join(told, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    n_chunks = F.ceil(F.col("n_docs") / CHUNK)
    parted = rated.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))))
    parted = parted.withColumn("rows", F.least(F.col("rows") - F.col("part") * CHUNK, F.lit(CHUNK).cast("long")))
    dealt = parted.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tag", "part", F.lit(11)), n_chunks))
    kept = ["doc_id", "source", "size", "tag", "source_size", "target"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(*kept, "rate", "rows", "chunk").repartition(n, "source", "chunk").sortWithinPartitions("source", "chunk", F.desc("size"), "doc_id", "tag", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, got = None, 0.0, 0
        for batch in batches:
            copies, at = [], []
            for i, (source, part, size, rate_, rows) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source", "chunk", "size", "rate", "rows")), strict=True)):
                if (source, part) != key:
                    key, asked, got = (source, part), 0.0, 0
                for _ in range(rows):
                    asked += size * rate_
                    n_copies = min(int(CAP), max(0, round((asked - got) / size))) if size else 1
                    got += n_copies * size
                    copies.append(n_copies)
                    at.append(i)
            places = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(places) for c in kept), pa.array(copies, pa.int64())], names=[*kept, "copies"])

    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in kept)
    return dealt.mapInArrow(run, f"{kinds}, copies long")


def mixing_query(docs: DataFrame) -> DataFrame:
    return planned(docs, F.xxhash64("text")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the plan takes it; rows that are equal in all columns share their copies."""
    key, row, copies, each, part = (unused(docs.columns, x) for x in ("key", "row", "copies", "each", "part"))
    # Maps have no hash; rows that differ in nothing else count as equal.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    tag = F.xxhash64(*hashed)

    def named(size: Column, tag_: Column) -> Column:
        return F.to_json(F.struct(F.col("doc_id").alias("d"), F.col("source").alias("s"), size.alias("n"), tag_.alias("t")))

    plan = planned(docs, tag).groupBy(named(F.col("size"), F.col("tag")).alias(key)).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    plan = written(plan, "mix-plan")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row)
    one = docs.select(named(sizes(), tag).alias(key), whole).groupBy(key).agg(F.first(row).alias(row))
    taken = one.join(plan, key)
    if plan.where(F.col(copies) > SPREAD).isEmpty():
        copied = taken.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    else:
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = taken.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / SPREAD)))).repartition(n, key, part)
        copied = parts.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col(copies) - F.col(part) * SPREAD, F.lit(SPREAD).cast("long")))))
    return copied.select(*(F.col(f"{row}.`{c}`") for c in docs.columns))
