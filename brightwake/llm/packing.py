"""Order-preserving packing by dynamic programming.

Documents stay in the order of their input partition and form one stream of
ids. The stream is cut into windows of at most ``LENGTH`` ids; cuts are chosen
among document ends, sentence ends and, inside long stretches without either,
regular positions. A window costs its padding and a fixed amount; a cut inside a
document costs a truncation penalty that is smaller at a sentence end. With
``pos`` the position of a cut and f the least cost up to it,

    f(j) = penalty(j) + WINDOW - pos(j) + LENGTH + min over i of (f(i) + pos(i)),

where i runs over the cuts at most ``LENGTH`` before j: a sliding minimum, kept
in a monotone queue, so the work is linear. A window whose length is a power of
two is not padded; these transitions are looked up by position. What is left at
the end of a partition is cut into powers of two where that saves padding.

Defined results: null text is an empty document, which has the end id alone;
null ``doc_id`` rows and repeated rows are packed like any other; documents
longer than a window are cut; an empty table gives an empty result; extra columns
are ignored. Sequence numbers are unique: partition number * 2**32 + a counter.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .tokens import END_ID, encoder

LENGTH = 4096
#: Costs in ids: of each window, of a cut at a sentence end, of any other cut inside a document.
WINDOW = 64
SENTENCE_CUT = 12
OTHER_CUT = 48
#: Longest stretch without a place to cut.
STRETCH = 256
#: Ids that are planned at a time; the rest of the last window is planned with the next ones.
PLANNED = 1 << 19
_POWERS = [1 << k for k in range(6, 12)]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(tokenizer: Tokenizer) -> np.ndarray:
    """Ids of the pieces that end a sentence."""
    known = [tokenizer.token_to_id(mark + "</w>") for mark in (".", "!", "?")]
    return np.array([x for x in known if x is not None], "<u4")


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where windows may end, ascending from 0, and the penalty of a cut there."""
    at = np.flatnonzero(np.isin(ids, ends_sentence)) + 1
    known = np.union1d(at, np.append(doc_ends, 0))
    gaps = np.diff(known)
    wide = gaps > STRETCH
    fill = [np.arange(p + STRETCH, p + g, STRETCH) for p, g in zip(known[:-1][wide], gaps[wide], strict=True)]
    places = np.union1d(known, np.concatenate(fill)) if fill else known
    penalty = np.full(len(places), OTHER_CUT, np.int64)
    penalty[np.isin(places, at)] = SENTENCE_CUT
    penalty[np.isin(places, doc_ends)] = 0
    penalty[places == 0] = 0
    return places, penalty


def plan(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> tuple[list[float], list[int]]:
    """Least cost up to each place, and the place where the last window then begins."""
    pos, pen = places.tolist(), penalties.tolist()
    index = {p: k for k, p in enumerate(pos)}
    powers = [p for p in _POWERS if p < length]
    cost, back = [0] * len(pos), [-1] * len(pos)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + pos(i), i), ascending
    for j in range(1, len(pos)):
        p = pos[j]
        while p - pos[queue[0][1]] > length:
            queue.popleft()
        least, i = queue[0]
        best = least + length - p
        for power in powers:
            k = index.get(p - power)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += WINDOW + pen[j]
        cost[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    return cost, back


def _ending(rest: int, length: int) -> list[int]:
    """Window lengths for the last ``rest`` ids (fewer than ``length``)."""
    powers = [1 << k for k in range(length.bit_length()) if rest >> k & 1][::-1]
    return powers if WINDOW * len(powers) < WINDOW + length - rest else [rest]


class Packer:
    """Takes documents in order and gives the pieces of finished windows."""

    def __init__(self, first_sequence: int, ends_sentence: np.ndarray, length: int = LENGTH) -> None:
        self._ids = np.empty(0, "<u4")
        self._parts: list[np.ndarray] = []
        self._docs: deque[list] = deque()  # doc_id, ids of it already packed, ids waiting, ids in all
        self._held, self._sequence, self._length = 0, first_sequence, length
        self._ends_sentence = ends_sentence

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        part = np.frombuffer(ids, "<u4")
        self._parts.append(part)
        self._docs.append([doc_id, 0, len(part), len(part)])
        self._held += len(part)
        if self._held >= PLANNED:
            yield from self._cut(last=False)

    def finish(self) -> Iterator[tuple]:
        if self._held:
            yield from self._cut(last=True)

    def _cut(self, last: bool) -> Iterator[tuple]:
        ids = np.concatenate([self._ids, *self._parts])
        self._ids, self._parts = ids, []
        doc_ends = np.cumsum([d[2] for d in self._docs])
        places, penalties = cut_places(ids, doc_ends, self._ends_sentence)
        cost, back = plan(places, penalties, self._length)
        late = int(np.searchsorted(places, len(ids) - self._length, "right"))
        late = min(late, len(places) - 1)
        whole = len(ids) <= self._length
        stop = 0 if whole else late + int(np.argmin(np.array(cost[late:])))
        cuts = [stop]
        while cuts[-1] > 0:
            cuts.append(back[cuts[-1]])
        ends = places[cuts[::-1]].tolist()
        if last:
            ends = [*ends, *(np.cumsum(_ending(len(ids) - ends[-1], self._length)) + ends[-1]).tolist()] if ends[-1] < len(ids) else ends
        for start, end in zip(ends, ends[1:], strict=False):
            yield from self._window(start, end)
        self._ids = ids[ends[-1] :].copy()
        self._held = len(self._ids)
        self._docs = deque(d for d in self._docs if d[2])

    def _window(self, start: int, end: int) -> Iterator[tuple]:
        offset = 0
        while start + offset < end:
            while not self._docs[0][2]:
                self._docs.popleft()
            doc = self._docs[0]
            n = min(doc[2], end - start - offset)
            piece = self._ids[start + offset : start + offset + n]
            yield doc[0], doc[1], n, zlib.crc32(piece.tobytes()), doc[3], self._sequence, offset
            doc[1] += n
            doc[2] -= n
            offset += n
        self._sequence += 1


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: see the module for the plan, and ``_SCHEMA`` for the columns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 32, sentence_ends(own.tokenizer), length)
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        table = lambda pieces: pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*pieces, strict=True)], names=names)
        for batch in batches:
            pieces = [p for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for p in packer.add(doc, own.encode(text.as_py()) + end)]
            if pieces:
                yield table(pieces)
        pieces = list(packer.finish())
        if pieces:
            yield table(pieces)

    return rows.mapInArrow(run, _SCHEMA)
