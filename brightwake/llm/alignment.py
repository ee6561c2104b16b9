"""Alignment of two tokenizers over the same bytes, by a sweep over the ends of their tokens.

A is a byte-level tokenizer of the tokenizers library over a space and the text, B a
sentencepiece model over the text, which adds that space. Every token of either side is
an event at the byte where it ends. The events of both sides are one table, dealt by
document and sorted by offset within each partition; a machine streams over them and
holds only the tokens since the last byte where both sides ended. There it closes a
group and links what ends. Events are stored in blocks: the ids of one side that end in
one window of bytes, from which their ends follow, so a row is no token and a long text
is many rows.

How often a pair of ids is linked is counted over the corpus. Counts come back to the
documents by chunk, which is what a few machines made, by the size of the texts: a chunk
meets its own pairs once, however many documents hold them, so a frequent pair is one row
of each chunk.

Word by word, ids are kept from the first time they are met: A splits a text by its
pattern and B cannot merge over the space before a word, so words are encoded on their
own. Texts with unusual characters, and models without those rules, are encoded whole.

Defined results: null or empty texts, and those whose tokens' bytes differ from space
and text on either side, have no tokens; repeated rows give repeated results and count as
often; null ``doc_id`` is a value like others; an empty table gives an empty result;
extra columns are ignored; a text is encoded whole, so memory grows with the longest.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import stored
from .tokens import letters_of_bytes

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in one block of events, and in one chunk.
WINDOW, CHUNK = 1 << 16, 1 << 25
#: Characters of texts that are encoded together.
TOGETHER = 1 << 21
#: Words whose ids a worker keeps of each tokenizer; longer words are not kept.
KEPT_WORDS, KEPT_CHARS = 300_000, 64
#: Pairs that a machine counts before it hands them on.
PAIRS = 1 << 20

#: Letters whose class is the same everywhere, and the byte-level split for texts of them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTERS}]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_SPACED = re.compile(r" +[^ ]*")
_SPACE = "\u2581"


class _Kept(dict):
    """Ids of words as bytes; all go when there are too many. ``wrong`` has the words whose tokens have other bytes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], side: _Side) -> None:
        super().__init__()
        self._encode, self._side = encode, side
        self.wrong: set[str] = set()

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not kept yet, together."""
        if len(self) >= KEPT_WORDS:
            self.clear()
        new = [w for w in words if w not in self and len(w) <= KEPT_CHARS]
        found = self._encode(new)
        flat = list(chain.from_iterable(found))
        ends = np.cumsum([len(ids) for ids in found], dtype=np.int64)
        data = np.array(flat, "<u4").tobytes()
        at = (4 * ends).tolist()
        self.update(zip(new, map(data.__getitem__, map(slice, [0, *at], at)), strict=True))
        # All at once, and one by one only if anything is wrong.
        octets = [w.encode() for w in new]
        sizes = np.diff(np.append(0, np.cumsum(self._side.sizes[flat])[ends - 1]) if new else [0])
        if self._side.text_of(flat) != b"".join(octets) or (sizes != [len(o) for o in octets]).any():
            self.wrong.update(w for w, o, ids in zip(new, octets, found, strict=True) if self._side.text_of(ids) != o)

    def _judged(self, word: str, ids: list[int]) -> bytes:
        if self._side.text_of(ids) != word.encode():
            self.wrong.add(word)
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        return self._judged(word, self._encode([word])[0])


class _Side:
    """One tokenizer: the ids of space and text, and the bytes of each id."""

    tokens: list[bytes]
    sizes: np.ndarray
    _kept: _Kept

    def text_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def split(self, text: str) -> list[str] | None:
        """The words of space and text that can be encoded on their own, if it has only such."""
        raise NotImplementedError

    def whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def checked(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each whole text, if their bytes are those of space and text."""
        found = [self.split(t) for t in texts]
        self._kept.learn(set().union(*filter(None, found)))
        out: list[np.ndarray | None] = []
        for text, words in zip(texts, found, strict=True):
            if words is not None:
                ids = np.frombuffer(b"".join(map(self._kept.__getitem__, words)), "<u4")
                out.append(ids if not self._kept.wrong or self._kept.wrong.isdisjoint(words) else None)
            else:
                plain = self.whole(text)
                out.append(np.array(plain, "<u4") if self.text_of(plain) == b" " + text.encode() else None)
        return out


class ByteLevel(_Side):
    def __init__(self, path: str | None = None) -> None:
        self._library = Tokenizer.from_file(path or public_tokenizers.path(A_FILE))
        self._library.encode_special_tokens = True
        rules = json.loads(self._library.to_str())
        before = rules["pre_tokenizer"] or {}
        self.by_words = (rules["normalizer"], before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == (None, "ByteLevel", False, True)
        letters = letters_of_bytes()
        byte = {c: bytes([b]) for b, c in enumerate(letters)}
        words = self._library.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.tokens[i] = b"".join([byte.get(c) or c.encode() for c in word])
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        model = self._library.model
        shown = lambda word: word.replace(" ", letters[32]) if word.isascii() and word.lstrip(" ").isprintable() else "".join([letters[b] for b in word.encode()])
        self._kept = _Kept(lambda words: [[t.id for t in model.tokenize(shown(w))] for w in words], self)

    def split(self, text: str) -> list[str] | None:
        return _SPLIT.findall(" " + text) if self.by_words and _PLAIN.fullmatch(text) else None

    def whole(self, text: str) -> list[int]:
        return self._library.encode(" " + text, add_special_tokens=False).ids


class Pieces(_Side):
    def __init__(self, path: str | None = None) -> None:
        self._library = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(B_FILE))
        pieces = [self._library.id_to_piece(i) for i in range(self._library.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self._library.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        space = self._library.piece_to_id(_SPACE)
        # The model adds the first space itself, but to an empty text.
        self._kept = _Kept(lambda words: [ids if w != " " else [space] for w, ids in zip(words, self._library.encode([w[1:] for w in words], num_threads=1), strict=True)], self)
        # The one rule that cutting before a word needs; it is tried on a text, too.
        inside, probe = re.compile(f"[^{_SPACE}]{_SPACE}"), "a  b c \n d  "
        self.by_words = not any(inside.search(p) for p in pieces) and self._library.id_to_piece(space) == _SPACE
        self.by_words = self.by_words and sum(self._library.encode([w[1:] for w in _SPACED.findall(" " + probe)]), []) == self._library.encode(probe)

    def split(self, text: str) -> list[str] | None:
        return _SPACED.findall(" " + text) if self.by_words and _SPACE not in text else None

    def whole(self, text: str) -> list[int]:
        return self._library.encode(text)


_sides: dict[tuple, tuple[ByteLevel, Pieces]] = {}


def sides(paths: tuple[str | None, str | None] = (None, None)) -> tuple[ByteLevel, Pieces]:
    """The worker's two tokenizers."""
    if paths not in _sides:
        _sides[paths] = ByteLevel(paths[0]), Pieces(paths[1])
    return _sides[paths]


EVENTS = "doc_id long, h long, part int, offset long, side int, ids binary"


def token_events(docs: DataFrame, paths: tuple[str | None, str | None] = (None, None), window: int = WINDOW) -> DataFrame:
    """The end events of both tokenizers, in blocks: ``ids`` of ``side`` (0 is A) that end up to ``window`` bytes after byte ``offset``.

    A text without tokens is one row with null ``ids``. ``h`` and ``part`` tell rows of one ``doc_id`` apart; equal rows of one part stay equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part, press = sides(paths), TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1).compress

        def encoded(held: list[tuple]) -> pa.RecordBatch:
            rows: list[tuple] = []
            there = [i for i, (_, _, text) in enumerate(held) if text]
            ids_of = dict(zip(there, zip(*(side.checked([held[i][2] for i in there]) for side in both), strict=True), strict=True))
            for i, (doc, h, _) in enumerate(held):
                found = ids_of.get(i, (None,))
                if any(ids is None for ids in found):
                    rows.append((doc, h, part, 0, 0, None))
                    continue
                for k, (ids, side) in enumerate(zip(found, both, strict=True)):
                    ends = np.cumsum(side.sizes[ids])
                    cuts = np.searchsorted(ends, np.arange(0, ends[-1] + window, window), "right")
                    for w, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                        if b > a:
                            data = ids[a:b].astype("<u2") if len(side.tokens) <= 1 << 16 else ids[a:b]
                            # Low and high bytes apart.
                            rows.append((doc, h, part, w * window, k, press(np.ascontiguousarray(data.view(np.uint8).reshape(len(data), -1).T).tobytes())))
            return _batch(rows, EVENTS)

        for batch in batches:
            held, size = [], 0
            for doc, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                held.append((doc, h, text.as_py()))
                size += len(held[-1][2] or "")
                if size > TOGETHER:
                    yield encoded(held)
                    held, size = [], 0
            if held:
                yield encoded(held)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, EVENTS)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def _unpressed(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{width}").reshape(-1)


class Machine:
    """What is open in one document: tokens since the last byte where both sides ended, and counts."""

    def __init__(self, both: tuple[_Side, _Side]) -> None:
        self._both = both
        self._ids = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self._ends = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self._at = [0, 0]
        self.n = [0, 0]

    def feed(self, side: int, ids: np.ndarray) -> None:
        ids = ids.astype(np.int64)
        ends = self._at[side] + np.cumsum(self._both[side].sizes[ids])
        self._at[side] = int(ends[-1])
        self.n[side] += len(ids)
        self._ids[side] = np.concatenate([self._ids[side], ids])
        self._ends[side] = np.concatenate([self._ends[side], ends])

    def closed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What can be closed now: A's ids, B's ids, the number of tokens of each group on both sides, and the bytes where groups end."""
        common, a, b = np.intersect1d(*self._ends, assume_unique=True, return_indices=True)
        cut = (int(a[-1]) + 1, int(b[-1]) + 1) if len(common) else (0, 0)
        out = [self._ids[k][: cut[k]] for k in (0, 1)]
        for k in (0, 1):
            self._ids[k], self._ends[k] = self._ids[k][cut[k] :], self._ends[k][cut[k] :]
        return out[0], out[1], np.diff(a, prepend=-1), np.diff(b, prepend=-1), common


def _streamed(batches: Iterator[pa.RecordBatch], both: tuple[_Side, _Side]) -> Iterator[tuple]:
    """(doc_id, copies, machine, closed groups, last) in order; equal rows of a document come as copies.

    The groups are null for a text without tokens.
    """
    width = [2 if len(s.tokens) <= 1 << 16 else 4 for s in both]
    key = machine = place = None
    copies = 0
    open_at = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:5]]
        for doc, h, part, offset, side, ids in zip(*columns, batch.column(5), strict=True):
            if (doc, h, part) != key:
                if machine is not None:
                    yield key[0], copies, machine, machine.closed() if open_at is not None else None, True
                key, machine, place, copies, open_at, first = (doc, h, part), Machine(both), (offset, side), 1, None, (offset, side)
            elif (offset, side) == place:
                copies += place == first
                continue
            place = (offset, side)
            ids = ids.as_py()
            if ids is None:
                continue
            if open_at is not None and offset != open_at:
                yield key[0], copies, machine, machine.closed(), False
            open_at = offset
            machine.feed(side, _unpressed(ids, width[side]))
    if machine is not None:
        yield key[0], copies, machine, machine.closed() if open_at is not None else None, True


def _sorted_events(docs: DataFrame, paths: tuple[str | None, str | None], window: int, chunks: int) -> DataFrame:
    parts = max(chunks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return token_events(docs, paths, window).repartition(parts, "doc_id", "h", "part").sortWithinPartitions("doc_id", "h", "part", "offset", "side")


def chunks_for(docs: DataFrame) -> int:
    """Enough chunks that each has about ``CHUNK`` bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // CHUNK))


GROUPS = "doc_id long, start long, end long, a_ids array<long>, b_ids array<long>"


def aligned_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Every group of every document: its bytes in space and text, and the ids of both sides. The last ids of a group are linked."""
    paths = (a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for doc, copies, _, closed, last in _streamed(batches, sides(paths)):
            if closed is not None and len(closed[4]):
                a, b, many_a, many_b, ends = closed
                rows = [
                    (doc, s, e, x.tolist(), y.tolist())
                    for s, e, x, y in zip([start, *ends[:-1].tolist()], ends.tolist(), np.split(a, np.cumsum(many_a)[:-1]), np.split(b, np.cumsum(many_b)[:-1]), strict=True)
                ]
                start = int(ends[-1])
                for _ in range(copies):
                    yield _batch(rows, GROUPS)
            if last:
                start = 0

    return _sorted_events(docs, paths, window, 1).mapInArrow(run, GROUPS)


MADE = "chunk int, seq long, pair long, n long, doc_id long, copies int, last boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _swept(docs: DataFrame, paths: tuple[str | None, str | None], window: int) -> DataFrame:
    """Rows of documents (``links``: their linked pairs in one window, with how often) and counts of pairs (``pair``, ``n``) of each chunk."""

    chunks = chunks_for(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part = sides(paths), TaskContext.get().partitionId()
        chunk = part % chunks
        size_a, size_b = (len(s.tokens) for s in both)
        # The text of each id and what follows it: A before "," or "|", B before "," or ";".
        shown = np.array([f"{i}{c}" for c, size in ((",", size_a), ("|", size_a), (",", size_b), (";", size_b)) for i in range(size)], object)
        press = zstandard.ZstdCompressor(level=1).compress
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows: list[tuple] = []
        waiting = bytes_waiting = groups = 0
        seq = part << 32
        digest, late = hashlib.sha256(), ""

        def counted() -> pa.RecordBatch:
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            many = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            return _batch([(chunk, None, p, n, *(None,) * 9) for p, n in zip(pairs.tolist(), many.tolist(), strict=True)], MADE)

        for doc, copies, machine, closed, last in _streamed(batches, both):
            links = None
            if closed is not None:
                a, b, many_a, many_b, ends = closed
                tail_a, tail_b = np.cumsum(many_a) - 1, np.cumsum(many_b) - 1
                # Each group's A ids, then its B ids.
                codes = np.empty(len(a) + len(b), np.int64)
                codes[np.arange(len(a)) + np.repeat(tail_b + 1 - many_b, many_a)] = a
                codes[tail_a + tail_b + 1 - many_b] += size_a
                codes[np.arange(len(b)) + np.repeat(tail_a + 1, many_b)] = 2 * size_a + b
                codes[tail_a + tail_b + 1] += size_b
                text = late + "".join(shown[codes].tolist())
                late = text[-1:]
                digest.update(text[:-1].encode())
                groups += len(ends)
                pairs, n = np.unique(a[tail_a] * size_b + b[tail_b], return_counts=True)
                held.append((pairs, n * copies))
                waiting += len(pairs)
                links = press(np.concatenate([np.diff(pairs, prepend=0), n]).astype("<i8").tobytes())
                bytes_waiting += len(links)
            if last:
                # The last group's separator is not part of the text.
                end = (*machine.n, groups, groups, digest.hexdigest() if closed is not None else "")
                digest, late, groups = hashlib.sha256(), "", 0
            rows.append((chunk, seq, None, None, doc, copies, last, *(end if last else (None,) * 5), links))
            seq += 1
            if bytes_waiting > 1 << 23 or len(rows) >= 10_000:
                yield _batch(rows, MADE)
                rows, bytes_waiting = [], 0
            if waiting > PAIRS:
                yield counted()
                held, waiting = [], 0
        if rows:
            yield _batch(rows, MADE)
        if held:
            yield counted()

    return _sorted_events(docs, paths, window, chunks).mapInArrow(run, MADE)


def pair_counts(made: DataFrame) -> DataFrame:
    """(chunk, pair, n): how often each chunk links each pair of ids."""
    return made.where("pair IS NOT NULL").groupBy("chunk", "pair").agg(F.sum("n").alias("n"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignment_query(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row a document: tokens, groups, links, how many of these are the most frequent of their B id, and the sum of their counts."""
    paths = (a_path, b_path)
    made, _ = stored(_swept(docs, paths, window), "alignment")
    size_b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path(B_FILE)).get_piece_size()
    of_chunk = pair_counts(made)
    counts = of_chunk.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % size_b)
    # A B id has at most as many pairs as A has ids.
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    judged = counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    known = of_chunk.select("chunk", "pair").join(judged, "pair").select("chunk", F.lit(0).alias("kind"), F.col("pair").alias("at"), "count", "best")
    rows = made.where("pair IS NULL").select("chunk", F.lit(1).alias("kind"), F.col("seq").alias("at"), "doc_id", "copies", "last", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    both = known.unionByName(rows, allowMissingColumns=True)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = pairs = None
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        best_sum = total = 0
        for batch in batches:
            # A batch is cut where its chunk or kind changes.
            chunk_of, kind_of = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(chunk_of) != 0) | (np.diff(kind_of) != 0)) + 1).tolist(), len(chunk_of)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                piece = batch.slice(begin, end - begin)
                if chunk_of[begin] != chunk:
                    chunk, parts, pairs = chunk_of[begin], [], None
                if kind_of[begin] == 0:
                    parts.append(tuple(piece.column(c).to_numpy(zero_copy_only=False) for c in ("at", "count", "best")))
                    continue
                if pairs is None:
                    pairs, count, best_of = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
                    best_of, parts = best_of.astype(np.int64), []
                out: list[tuple] = []
                names = ("doc_id", "copies", "last", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
                for doc, copies, last, *counts_of, sha, links in zip(*(piece.column(c).to_pylist() for c in names), piece.column("links"), strict=True):
                    links = links.as_py()
                    if links is not None:
                        of_doc, many = np.frombuffer(zstandard.ZstdDecompressor().decompress(links), "<i8").reshape(2, -1)
                        at = np.searchsorted(pairs, np.cumsum(of_doc))
                        best_sum += int((best_of[at] * many).sum())
                        total += int((count[at] * many).sum())
                    if last:
                        out += [(doc, *counts_of, best_sum, total, sha)] * copies
                        best_sum = total = 0
                if out:
                    yield _batch(out, RESULT)

    return dealt.mapInArrow(run, RESULT)
