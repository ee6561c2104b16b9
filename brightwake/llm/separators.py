"""Token counts by a separator scan of flat, unindexed token files.

A flat file is nothing but little-endian ids of a fixed width with an
end-of-document id after each document. That id is the first above the
tokenizer's vocabulary, and the width is 16 bits if it fits, else 32. Files are
cut into blocks of a fixed number of ids that are scanned independently: one vectorised comparison finds the separators of a
block. A prefix scan over the blocks' summaries (separators before the block,
last separator before it) then stitches documents that span blocks, so a
document's number, start and length never depend on the block size.

Defined results: null text is an empty document of 0 tokens; null ``doc_id``
rows, repeated rows and texts of any length are counted like any other; ids
after a file's last separator form one document that is marked unterminated; an
empty table or file gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import create, open_for_reading, part_uri
from .scratch import drop, new_path, written
from .tokens import encoder, first_free_id

BLOCK = 1 << 20
_SCAN = "path string, block long, length long, seps array<long>"


def width_of(separator: int) -> str:
    """The type of a file's ids, none of which is above its separator."""
    return "<u2" if separator < 1 << 16 else "<u4"


def write_flat(docs: DataFrame, folder: str, separator: int, tokenizer: str | None = None) -> DataFrame:
    """Write one flat file a partition; returns (doc_id, path, ordinal), a document's place in its file."""
    width = width_of(separator)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([separator], width).tobytes()
        out, n = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                path = part_uri(folder, ".ids")
                out = create(path)
            for text in batch.column(1):
                out.write(np.frombuffer(encode(text.as_py()), "<u4").astype(width).tobytes() + end)
            if batch.num_rows:
                ordinals = pa.array(range(n, n + batch.num_rows), pa.int64())
                n += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([path] * batch.num_rows), ordinals], names=["doc_id", "path", "ordinal"])
        if out is not None:
            out.close()

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, path string, ordinal long")


def scan_blocks(paths: DataFrame, separator: int, block: int = BLOCK) -> DataFrame:
    """(path, block, length, seps) of every block of the files; ``seps`` are positions in the file."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = width_of(separator)
    octets = np.dtype(width).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_for_reading(path) as f:
                    blocks = range(-(-(f.size() // octets) // block))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(blocks), pa.string()), pa.array(blocks, pa.int64())], names=["path", "block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_for_reading(path) as f:
                    f.seek(octets * block * k)
                    data = f.read(octets * block)
                ids = np.frombuffer(data[: len(data) // octets * octets], width)
                found.append((path, k, len(ids), (np.flatnonzero(ids == separator) + block * k)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], names=["path", "block", "length", "seps"])

    blocks = paths.select("path").mapInArrow(cut, "path string, block long")
    return blocks.repartition(n, "path", "block").mapInArrow(scan, _SCAN)


def stitched(blocks: DataFrame) -> DataFrame:
    """(path, ordinal, start, n_tokens, terminated) of every document, from scanned blocks."""
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.element_at("seps", -1)
    marked = blocks.select(
        "path",
        "block",
        "length",
        "seps",
        F.coalesce(F.sum(F.size("seps")).over(before), F.lit(0)).cast("long").alias("base"),
        F.coalesce(F.max(F.when(F.size("seps") > 0, last)).over(before), F.lit(-1)).alias("previous"),
    )
    starts = F.transform("seps", lambda p, i: F.struct((F.col("base") + i).alias("ordinal"), (F.when(i == 0, F.col("previous")).otherwise(F.get("seps", i - 1)) + 1).alias("start"), p.alias("stop")))
    ended = marked.select("path", F.explode(starts).alias("d")).select("path", "d.ordinal", "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    totals = blocks.groupBy("path").agg(F.sum("length").alias("n"), F.sum(F.size("seps")).cast("long").alias("ordinal"), F.coalesce(F.max(F.when(F.size("seps") > 0, last)), F.lit(-1)).alias("previous"))
    loose = totals.where("previous + 1 < n").select("path", "ordinal", (F.col("previous") + 1).alias("start"), (F.col("n") - F.col("previous") - 1).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(loose)


def token_counts(docs: DataFrame, block: int = BLOCK, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, start) of every document, counted from flat files of all texts; ``start`` is its place in its file."""
    spark, separator = docs.sparkSession, first_free_id(tokenizer)
    folder = new_path(spark, "flat")
    places = written(write_flat(docs, folder, separator, tokenizer), "flat-places")
    found = written(scan_blocks(places.select("path").distinct(), separator, block), "flat-blocks")
    drop(spark, folder)
    return places.join(stitched(found), ["path", "ordinal"]).select("doc_id", "n_tokens", "start")
