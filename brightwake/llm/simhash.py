"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the XXH64 values of its
3-word shingles. Fingerprints within Hamming distance 3 are linked, and linked
documents form a component.

Candidate search. Every bit position gets a nonzero label in GF(2)^4. Table v
(v = 1..15) keeps the bits whose label has odd inner product with v and groups
fingerprints by the kept bits. The labels of three differing bits span at most
three dimensions, so some v is orthogonal to all of them: in that table none of
the differing bits is kept and the pair collides. So no pair within the radius
is missed, whatever the data.

Buckets. A bucket of at most ``BLOCK`` fingerprints is compared in one piece;
a larger one is dealt into blocks that are compared two at a time; beyond
``DENSE`` fingerprints the bucket is resolved in linear time: x and y are within
3 bits exactly if some value v is within 1 bit of one and 2 of the other, so all
that reach v within 2 bits are joined to one that reaches it within 1. Each way
is exact. Only a spanning forest of each comparison is emitted, never all pairs.

Defined results: null, empty or blank text has fingerprint zero and is linked
like any other; fewer than three words hash the whole sequence; null ``doc_id``
rows are kept and take the smallest non-null id of their component; repeated
rows are repeated in the result; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, new_path, stored, unused, written

RADIUS = 3
SEED = 42
BLOCK = 1024
DENSE = 16384
#: Shingles whose bits are counted at once.
_STRIDE = 1 << 15
#: A fingerprint of more documents than this is split where documents meet their classes,
SPLIT = 256
#: and of more than one in so many, which bounds the number of split ones.
MOST_SPLIT = 100_000


def _labels() -> list[int]:
    return [1 + bit % 15 for bit in range(64)]


def covering_masks() -> list[int]:
    """The 15 masks: mask v keeps the bits whose label meets v in an odd number of places."""
    return [sum(1 << bit for bit, label in enumerate(_labels()) if (label & v).bit_count() % 2) for v in range(1, 16)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    if len(words) > 3:
        starts, ends = starts[:-2], ends[2:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STRIDE):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _STRIDE], ends[at : at + _STRIDE], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of each document, with its fingerprint as a signed long ``fp``."""
    text = unused(keep, "text")
    narrow = docs.select(*keep, F.col("text").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py())) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps, pa.int64())], names=[*keep, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != text)
    return narrow.mapInArrow(run, f"{kinds}, fp long")


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that has a smaller one in its component, with the smallest."""
    fps = np.unique(fps)
    near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= RADIUS
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        pairs = [_forest(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.int64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _dense_links(members: DataFrame) -> DataFrame:
    """Links inside very large buckets, in a number of rows that is linear in their size."""

    def flips(patterns: list[int], core: bool) -> Column:
        return F.transform(F.array(*map(F.lit, patterns)), lambda x: F.struct(x.cast("long").alias("x"), F.lit(core).alias("core")))

    def near(t: int, mask: int) -> DataFrame:
        free = [1 << bit for bit in range(64) if not mask >> bit & 1]
        within_one = [0, *map(_signed, free)]
        at_two = [_signed(x | y) for i, x in enumerate(free) for y in free[:i]]
        own = members.where(F.col("t") == t).select("t", "fp", F.explode(F.concat(flips(within_one, True), flips(at_two, False))).alias("f"))
        return own.select("t", "fp", F.col("fp").bitwiseXOR(F.col("f.x")).alias("v"), F.col("f.core").alias("core"))

    reached = reduce(DataFrame.union, [near(t, mask) for t, mask in enumerate(covering_masks())])
    core = reached.where("core").groupBy("t", "v").agg(F.min("fp").alias("b"))
    return reached.join(core, ["t", "v"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def radius_links(distinct_fps: DataFrame) -> tuple[DataFrame, str]:
    """Links (a, b) whose components are those of all pairs within ``RADIUS`` bits, and the folder they are read from."""
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(covering_masks()))))
    keyed = distinct_fps.select("fp", tables.alias("k")).select("k.t", "k.key", "fp")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members, path = stored(keyed.join(shared, ["t", "key"]), "simhash-buckets")
    small = members.where(F.col("n") <= DENSE)
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = small.withColumn("m", n_blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    dealt = dealt.select("t", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    grouped = dealt.groupBy("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))
    links = grouped.select("fps").mapInArrow(_compared, "a long, b long")
    large = members.where(F.col("n") > DENSE)
    if not large.isEmpty():
        links = links.union(_dense_links(large))
    return links, path


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for every end of a link; ends of one component share their root.

    Each round points every node at the smallest node among itself and its
    neighbours and contracts the graph along these pointers, until no link is
    left; the pointers of all rounds are then followed. Later rounds order nodes
    by a hash, which makes the number of rounds logarithmic for any input.
    """
    spark = links.sparkSession
    edges, paths, levels = links.distinct(), [], []
    while True:
        path = new_path(spark, "simhash-edges")
        edges.write.parquet(path)
        edges = spark.read.schema("a long, b long").parquet(path)
        paths.append(path)
        if edges.isEmpty():
            break
        depth = len(levels)
        rank = (lambda c: F.col(c)) if depth < 4 else (lambda c, d=depth: F.xxhash64(c, F.lit(d)))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("m"))
        to = F.when(F.col("m.r") < rank("a"), F.col("m.to")).otherwise(F.col("a"))
        pointers, path = stored(least.select(F.col("a").alias("fp"), to.alias("root")), "simhash-pointers")
        levels.append(pointers)
        paths.append(path)
        left = pointers.select(F.col("fp").alias("a"), F.col("root").alias("ra"))
        right = pointers.select(F.col("fp").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct()
    if not levels:
        found = spark.createDataFrame([], "fp long, root long")
    else:
        found = levels[0]
        for later in levels[1:]:
            step = later.select(F.col("fp").alias("root"), F.col("root").alias("next"))
            found = found.join(step, "root", "left").select("fp", F.coalesce("next", "root").alias("root"))
        found = written(found, "simhash-roots")
    drop(spark, *paths)
    return found


def split_join(rows: DataFrame, classes: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` joined with ``classes`` (fp, ..., n: its number of rows) on ``fp``, a fingerprint of many rows in parts.

    At most ``MOST_SPLIT`` fingerprints can have more than one in so many of the
    rows, so the table that tells into how many parts each is dealt may be broadcast.
    """
    part, parts = unused([*rows.columns, *classes.columns], "part"), unused([*rows.columns, *classes.columns], "parts")
    least = max(SPLIT, n_rows // MOST_SPLIT)
    wide = classes.where(F.col("n") > least).select("fp", F.ceil(F.col("n") / least).cast("int").alias(parts))
    # A row's number in its scan does not change when a task is run again.
    told = rows.join(F.broadcast(wide), "fp", "left").withColumn(part, F.pmod(F.monotonically_increasing_id(), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    each = F.when(F.col("n") > least, F.ceil(F.col("n") / least)).otherwise(1).cast("int")
    dealt = classes.withColumn(part, F.explode(F.sequence(F.lit(0), each - 1)))
    return told.join(dealt.drop("n"), ["fp", part]).drop(part)


def near_duplicates(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: ``doc_id``, ``keep`` columns, signed ``fp``, ``root`` of its component and ``component_id``."""
    spark = docs.sparkSession
    own = written(fingerprints(docs, "doc_id", *keep), "simhash-fingerprints")
    classes, at_classes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-distinct")
    links, at_links = radius_links(classes.select("fp"))
    roots = components(links)
    linked = roots.join(classes, "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = linked.select("fp", "root").join(least, "root")
    of = classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "rep").alias("component_id"), "n")
    of = written(of, "simhash-classes")
    drop(spark, at_classes, at_links)
    n_rows = of.agg(F.sum("n")).first()[0] or 0
    return split_join(own, of, n_rows).select("doc_id", *keep, "fp", "root", "component_id")


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest doc_id, then of the smallest text hash."""
    own, none, id_, kept_hash = (unused(docs.columns, x) for x in ("hash", "none", "id", "kept"))
    hashed = docs.withColumn(own, F.xxhash64("text"))
    found = near_duplicates(hashed, own)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias(none), F.col("doc_id").alias(id_), F.col(own).alias(kept_hash))).alias("k"))
    kept = kept.select(F.col(f"k.{id_}"), F.col(f"k.{kept_hash}"))
    rows = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(kept_hash)))
    return rows.dropDuplicates(["doc_id", own]).select(*(f"`{c}`" for c in docs.columns))


def simhash_query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
