"""Token-id files by bit-plane shuffling.

Ids are cut into fixed-size blocks. Each block is transposed into bit planes or
byte planes (all first bits or bytes, then all second ones, ...), planes above
the largest id of the block are left out, and each plane is compressed with
zstandard on its own. A file holds the planes of its blocks, the ids and lengths
of its documents, and a chunk index that tells where each block's planes begin,
so that any range of ids is read by decoding only the blocks it touches.

Defined results: null text is an empty document, which has the end id alone;
null ``doc_id`` sorts first; documents with equal ``doc_id`` follow each other in
the order of their text hashes; an empty table writes no file and gives an empty
result; texts of any length are written in blocks; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import create, open_for_reading, part_uri
from .scratch import new_path, written
from .tokens import END_ID, encoder

MAGIC = b"BWPLANE1"
BLOCK = 1 << 16
MODE = "byte"
LEVEL = 3


def split_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of one block, lowest first, without those that are all zero at the top."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [octets[:, i].tobytes() for i in range((width + 7) // 8)]
    return [np.packbits(octets[:, i // 8] >> (i % 8) & 1).tobytes() for i in range(width)]


def join_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    """Inverse of :func:`split_planes`."""
    out = np.zeros(n, "<u4")
    for i, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        part = raw if mode == "byte" else np.unpackbits(raw, count=n)
        out |= part.astype("<u4") << np.uint32(8 * i if mode == "byte" else i)
    return out


class PlaneWriter:
    """Writes documents' ids to one file, a block at a time."""

    def __init__(self, uri: str, mode: str = MODE, block: int = BLOCK) -> None:
        self._out, self._mode, self._block = create(uri), mode, block
        self._zip = zstandard.ZstdCompressor(level=LEVEL)
        self._waiting: list[bytes] = []
        self._held = self._at = 0
        self._chunks: list[list] = []
        self._docs: list[int | None] = []
        self._lengths: list[int] = []
        self.n_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self._out.write(data)
        self._at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append(doc_id)
        self._lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self._waiting.append(ids)
        self._held += len(ids)
        if self._held >= 4 * self._block:
            self._flush(all_of_it=False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.frombuffer(b"".join(self._waiting), "<u4")
        whole = len(ids) if all_of_it else len(ids) // self._block * self._block
        for at in range(0, whole, self._block):
            block = ids[at : min(at + self._block, whole)]
            start = self._at
            sizes = [self._put(self._zip.compress(p)) for p in split_planes(block, self._mode)]
            self._chunks.append([start, len(block), sizes])
        self._waiting = [ids[whole:].tobytes()]
        self._held = 4 * (len(ids) - whole)

    def close(self) -> None:
        self._flush(all_of_it=True)
        docs = np.array([0 if d is None else d for d in self._docs], "<i8").tobytes()
        nulls = np.array([d is None for d in self._docs], np.uint8).tobytes()
        lengths = np.array(self._lengths, "<i8").tobytes()
        places = []
        for section in (docs, nulls, lengths):
            start = self._at
            places.append([start, self._put(self._zip.compress(section))])
        index = json.dumps({"mode": self._mode, "block": self._block, "chunks": self._chunks, "documents": places}).encode()
        size = self._put(self._zip.compress(index))
        self._put(size.to_bytes(8, "little") + MAGIC)
        self._out.close()


class PlaneReader:
    """Reads ids of a file by range, and its documents."""

    def __init__(self, uri: str) -> None:
        self._in = open_for_reading(uri)
        self._unzip = zstandard.ZstdDecompressor()
        end = self._in.size()
        tail = self._read(end - 16, 16)
        if tail[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError(f"{uri} is not a whole plane file")
        size = int.from_bytes(tail[:8], "little")
        index = json.loads(self._unzip.decompress(self._read(end - 16 - size, size)))
        self._mode, self._chunks = index["mode"], index["chunks"]
        self._begins = np.cumsum([0, *(c[1] for c in self._chunks)])
        docs, nulls, lengths = (self._unzip.decompress(self._read(*place)) for place in index["documents"])
        null = np.frombuffer(nulls, np.uint8)
        self.doc_ids = [None if x else d for d, x in zip(np.frombuffer(docs, "<i8").tolist(), null, strict=True)]
        self.lengths = np.frombuffer(lengths, "<i8")

    def _read(self, at: int, n: int) -> bytes:
        self._in.seek(at)
        return self._in.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self._chunks[k]
        data, planes, used = self._read(at, sum(sizes)), [], 0
        for size in sizes:
            planes.append(self._unzip.decompress(data[used : used + size]))
            used += size
        return join_planes(planes, n, self._mode)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file."""
        if not n:
            return np.empty(0, "<u4")
        first = int(np.searchsorted(self._begins, start, "right")) - 1
        last = int(np.searchsorted(self._begins, start + n, "left")) - 1
        got = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return got[start - self._begins[first] :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, first id, ids) of each document, each block decoded once."""
        held, held_from, k = np.empty(0, "<u4"), 0, 0
        start = 0
        for doc, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            pieces = [held[start - held_from :]]
            have = len(pieces[0])
            while have < n:
                pieces.append(self.chunk(k))
                have += len(pieces[-1])
                k += 1
            held, held_from = np.concatenate(pieces) if len(pieces) > 1 else pieces[0], start
            yield doc, start, held[:n].tobytes()
            start += n

    def close(self) -> None:
        self._in.close()


def write_planes(docs: DataFrame, folder: str, mode: str = MODE, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to plane files in ascending doc_id order.

    Returns one row per file: ``part`` (files in order), ``path``, ``n_docs``, ``n_ids``.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([END_ID], "<u4").tobytes()
        writer = path = None
        n_docs = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    path = part_uri(folder, ".planes")
                    writer = PlaneWriter(path, mode)
                writer.add(doc, encode(text.as_py()) + end)
                n_docs += 1
        if writer is not None:
            writer.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [writer.n_ids]})

    return rows.select("doc_id", "text").mapInArrow(run, "part long, path string, n_docs long, n_ids long")


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, ``start`` counting the ids of all files before."""
    # One row a file: the running total orders files, not documents.
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("before")).repartition(n, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = PlaneReader(path)
                rows = [(d, base + s, len(ids) // 4, zlib.crc32(ids)) for d, s, ids in reader.documents()]
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def bitplane_query(docs: DataFrame) -> DataFrame:
    files = written(write_planes(docs, new_path(docs.sparkSession, "planes")), "planes-files")
    return read_documents(files)
