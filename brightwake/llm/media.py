"""Media columns: signature sniffing, structure checks and carving.

An Aho-Corasick automaton finds every known magic number in a value in one pass.
Each hit is only a candidate: a validator of its format walks the structure and
lengths from there and says how long the object is and which samples it holds,
or that it is none. The object at offset 0 gives the value's true type, whatever
was declared; validated objects further in are embedded media, and ``carved``
gives their bytes.

The runs of blocks of a GIF are remembered by place, and gzip data is inflated in
small pieces of bounded output, so that many false hits cost little: work is
linear in a value, except where a value holds many streams that overlap and each
decode far before they fail.

``stored`` keeps each text's bytes, padded with 255 to a positive multiple of
576, as 8-bit samples of a sound or picture (the format follows from the bytes)
in a binary column with a declared type that is often wrong. ``media_query``
reads that column back and takes everything from the stored bytes.

Defined results: null text is empty; empty text is stored as 576 bytes of 255;
null ``doc_id`` rows and repeated rows are kept as rows, equal texts give equal
values; a null or unrecognised value sniffs as ``unknown`` with no samples; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

UNIT = 576
PAD = b"\xff"
FORMATS = ("wav", "au", "bmp", "png")

#: The formats' magic numbers.
MAGIC = {
    b"RIFF": "wav",
    b".snd": "au",
    b"BM": "bmp",
    b"\x89PNG\r\n\x1a\n": "png",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"\x1f\x8b\x08": "gzip",
}
#: (length of the object, its samples)
Found = tuple[int, bytes]


class _Runs:
    """Where runs through a value end; each place is visited once, whatever the number of starts."""

    def __init__(self, size: int) -> None:
        self._run = memoryview(np.zeros(size + 1, np.uint32))
        self._ends: list[int | None] = [None]

    def end(self, at: int, step: Callable[[int], tuple[bool, int | None]]) -> int | None:
        """Follow ``step``: place -> (whether the run is over, its end or else the next place), from ``at``."""
        run, mine = self._run, len(self._ends)
        self._ends.append(None)
        over, place = False, at
        while not over and place is not None and place < len(run):
            if run[place]:
                place = self._ends[run[place]]
                break
            run[place] = mine
            over, place = step(place)
        else:
            place = place if over else None
        self._ends[mine] = place
        return place


class Value:
    """The bytes of a value, and what validators remember of it."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        #: Ends of gzip members, by the place of their compressed data.
        self.members: dict[int, int | None] = {}
        self._searched, self._zero = 0, -1

    def after_zero(self, at: int) -> int | None:
        """The place after the next zero byte."""
        if not self._searched <= at <= self._zero:
            found = self.data.find(0, at)
            self._searched, self._zero = at, found if found >= 0 else len(self.data)
        return self._zero + 1 if self._zero < len(self.data) else None

    @cached_property
    def blocks(self) -> _Runs:
        return _Runs(len(self.data))

    @cached_property
    def sections(self) -> _Runs:
        return _Runs(len(self.data))


def _wav(value: Value, at: int) -> Found | None:
    data = value.data
    if len(data) < at + 12 or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    p, eight_bit, samples = at + 12, False, None
    while p + 8 <= end:
        name, size = data[p : p + 4], struct.unpack_from("<I", data, p + 4)[0]
        if p + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            eight_bit = struct.unpack_from("<H", data, p + 8)[0] == 1 and struct.unpack_from("<H", data, p + 22)[0] == 8
        if name == b"data" and eight_bit:
            samples = data[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    return None if samples is None else (end - at, samples)


def _au(value: Value, at: int) -> Found | None:
    data = value.data
    if len(data) < at + 24:
        return None
    start, size, encoding, rate, channels = struct.unpack_from(">5I", data, at + 4)
    if start < 24 or encoding != 2 or not rate or not 1 <= channels <= 16 or at + start + size > len(data):
        return None
    return start + size, data[at + start : at + start + size]


def _bmp(value: Value, at: int) -> Found | None:
    data = value.data
    if len(data) < at + 54:
        return None
    size, _, start, header, width, height, planes, depth, packing = struct.unpack_from("<IIIIiiHHI", data, at + 2)
    stride = (width + 3) // 4 * 4
    if header != 40 or planes != 1 or depth != 8 or packing or width <= 0 or size != start + stride * abs(height) or at + size > len(data):
        return None
    rows = np.frombuffer(data, np.uint8, stride * abs(height), at + start).reshape(abs(height), stride)[:, :width]
    return size, (rows if height < 0 else rows[::-1]).tobytes()


def _png(value: Value, at: int) -> Found | None:
    data = value.data
    if data[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return None
    p, shape, packed = at + 8, None, []
    while p + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, p)
        if p + 12 + size > len(data) or zlib.crc32(data[p + 4 : p + 8 + size]) != struct.unpack_from(">I", data, p + 8 + size)[0]:
            return None
        body = data[p + 8 : p + 8 + size]
        p += 12 + size
        if name == b"IHDR" and size == 13:
            shape = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            if shape is None or shape[2:] != (8, 0, 0, 0, 0):
                return None
            try:
                raw = zlib.decompress(b"".join(packed))
            except zlib.error:
                return None
            if len(raw) != (shape[0] + 1) * shape[1]:
                return None
            rows = np.frombuffer(raw, np.uint8).reshape(shape[1], shape[0] + 1)
            return None if rows[:, 0].any() else (p - at, rows[:, 1:].tobytes())
    return None


def _gif(value: Value, at: int) -> Found | None:
    data = value.data
    if len(data) < at + 13:
        return None

    def block(q: int) -> tuple[bool, int | None]:
        if q >= len(data):
            return True, None
        return not data[q], q + data[q] + 1

    def section(p: int) -> tuple[bool, int | None]:
        if p >= len(data) or data[p] not in (0x3B, 0x21, 0x2C):
            return True, None
        if data[p] == 0x3B:
            return True, p + 1
        if data[p] == 0x21:
            return False, value.blocks.end(p + 2, block)
        if p + 10 >= len(data):
            return True, None
        return False, value.blocks.end(p + 11 + (3 << (data[p + 9] & 7) + 1 if data[p + 9] & 128 else 0), block)

    start = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 128 else 0)
    if start >= len(data) or data[start] not in (0x3B, 0x21, 0x2C):
        return None
    end = value.sections.end(start, section)
    return None if end is None else (end - at, b"")


def _inflated(data: memoryview, at: int) -> int | None:
    """Where a gzip member ends whose compressed data begin here, if they and its checks hold."""
    unzip, p, piece, crc, size = zlib.decompressobj(-15), at, 64, 0, 0
    try:
        while not unzip.eof:
            if not unzip.unconsumed_tail and p >= len(data):
                return None
            taken = unzip.unconsumed_tail or data[p : p + piece]
            p += 0 if unzip.unconsumed_tail else len(taken)
            got = unzip.decompress(taken, 1 << 20)
            crc, size = zlib.crc32(got, crc), size + len(got)
            piece = min(2 * piece, 1 << 16)
    except zlib.error:
        return None
    p -= len(unzip.unused_data)
    return p + 8 if bytes(data[p : p + 8]) == struct.pack("<II", crc, size & 0xFFFFFFFF) else None


def _gzip(value: Value, at: int) -> Found | None:
    data = value.data
    if len(data) < at + 18 or data[at + 3] > 31:
        return None
    flags, p = data[at + 3], at + 10
    if flags & 4:
        p += 2 + int.from_bytes(data[p : p + 2], "little")
    for named in (8, 16):
        if flags & named and p is not None:
            p = value.after_zero(p)
    if p is None:
        return None
    p += 2 if flags & 2 else 0
    if p not in value.members:
        value.members[p] = _inflated(memoryview(data), p)
    end = value.members[p]
    return None if end is None else (end - at, b"")


VALIDATORS: dict[str, Callable[[Value, int], Found | None]] = {"wav": _wav, "au": _au, "bmp": _bmp, "png": _png, "gif": _gif, "gzip": _gzip}


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def objects(data: bytes) -> list[tuple[str, int, int, bytes]]:
    """(kind, offset, length, samples) of every validated object in the value, by offset."""
    out, value = [], Value(data)
    for end, (n, kind) in _automaton().iter(data.decode("latin-1")):
        at = end - n + 1
        told = VALIDATORS[kind](value, at)
        if told:
            out.append((kind, at, *told))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def sniff(data: bytes | None) -> tuple[str, bytes, list[tuple[str, int, int]]]:
    """True type, samples and embedded (kind, offset, length) of a value."""
    found = objects(data or b"")
    if not found or found[0][1]:
        return "unknown", b"", [x[:3] for x in found]
    return found[0][0], found[0][3], [x[:3] for x in found[1:]]


def padded(text: bytes) -> bytes:
    return text + PAD * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def encoded(samples: bytes, kind: str) -> bytes:
    """The samples in the named format."""
    if kind == "wav":
        fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
        body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(samples)) + samples
        return b"RIFF" + struct.pack("<I", len(body)) + body
    if kind == "au":
        return struct.pack(">4s5I", b".snd", 24, len(samples), 2, 8000, 1) + samples
    rows = len(samples) // UNIT
    if kind == "bmp":
        start = 54 + 1024
        head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(samples), 0, start, 40, UNIT, -rows, 1, 8, 0, len(samples), 2835, 2835, 256, 0)
        return head + np.repeat(np.arange(256, dtype=np.uint8), 4).tobytes() + samples
    if kind == "png":
        raw = np.zeros((rows, UNIT + 1), np.uint8)
        raw[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, UNIT)
        chunks = ((b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(raw.tobytes(), 1)), (b"IEND", b""))
        return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b)) for n, b in chunks)
    raise ValueError(f"no encoder for {kind}")


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``declared`` and ``media``: each text as media of a format that follows from its bytes."""
    kind_of = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, declared, media = batch.slice(at, 256), [], []
                for raw in part.column(1).to_pylist():
                    samples = padded(raw)
                    mark = zlib.crc32(samples)
                    declared.append((*FORMATS, "octet-stream")[(mark >> 8) % 5])
                    media.append(encoded(samples, FORMATS[mark % 4]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(declared, pa.string()), pa.array(media, pa.binary())], names=["doc_id", "declared", "media"])

    return narrow.mapInArrow(run, f"doc_id {kind_of}, declared string, media binary")


def _feature(kind: str, declared: str | None, samples: bytes, embedded: int) -> str:
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts / max(1, counts.sum())
    mean = float(share @ np.arange(256))
    spread = float(np.sqrt(max(0.0, share @ (np.arange(256) - mean) ** 2)))
    some = share[share > 0]
    return f"type={kind};declared={declared};embedded={embedded};mean={mean:.4f};std={spread:.4f};entropy={max(0.0, -float(some @ np.log2(some))) if len(some) else 0.0:.4f}"


def sniffed(media: DataFrame) -> DataFrame:
    """Facts of each stored value (``doc_id``, ``declared``, ``media``), from its bytes alone."""
    kind_of = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind_of}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, embedded array<struct<kind:string,offset:bigint,length:bigint>>"
    embedded_kind = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), embedded_kind]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for declared, value in zip(batch.column(1), batch.column(2), strict=True):
                data = value.as_py() or b""
                kind, samples, inside = sniff(data)
                rows.append(
                    (
                        len(samples.rstrip(PAD)),
                        len(samples),
                        hashlib.sha256(samples).hexdigest(),
                        zlib.crc32(samples[-32:]),
                        len(data),
                        hashlib.sha256(data).hexdigest(),
                        _feature(kind, declared.as_py(), samples, len(inside)),
                        kind,
                        [{"kind": k, "offset": o, "length": n} for k, o, n in inside],
                    )
                )
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return media.select("doc_id", "declared", "media").mapInArrow(run, schema)


def carved(media: DataFrame) -> DataFrame:
    """One row for each object inside a stored value: ``doc_id``, its ``kind``, ``offset`` and ``length``, its ``object`` bytes and its ``samples``."""
    kind_of = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "kind", "offset", "length", "object", "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch.column(1)[at].as_py() or b""
                found = objects(data)
                inside = found[1:] if found and not found[0][1] else found
                if inside:
                    columns = [pa.array([x[i] for x in inside], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
                    pieces = pa.array([data[o : o + n] for _, o, n, _ in inside], pa.binary())
                    ids = batch.column(0).take(pa.array([at] * len(inside)))
                    yield pa.RecordBatch.from_arrays([ids, *columns, pieces, pa.array([x[3] for x in inside], pa.binary())], names=names)

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind_of}, kind string, offset long, length long, object binary, samples binary")


def media_query(docs: DataFrame) -> DataFrame:
    media = written(stored(docs), "media", compression="zstd")
    return sniffed(media)
