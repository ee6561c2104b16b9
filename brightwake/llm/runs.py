"""Runs of repeated word sequences, by the Gusfield-Stoye linear tandem-repeat method.

Words of a text are numbered. A run is a stretch of consecutive words that has a
smallest period and that no neighbouring word extends. The method has three steps:

1. Lempel-Ziv blocks: a square (two equal stretches side by side) whose second half lay
   inside one block would have occurred before, so common extensions from the ends of
   blocks give, for each kind of square, one that starts at or left of its first
   occurrence and from which one-word shifts reach it.
2. Those squares are placed on the edges of the suffix tree bottom-up, and suffix-link
   walks from each place add every rotation that occurs, which completes the vocabulary
   of squares.
3. The occurrences of squares with a primitive root are read from the tree's intervals;
   those of one period at consecutive words merge into a run.

Only stretches that can hold a run go through it. A run of period q and at least
4 q words repeats its word triples at a distance of at most q, over at least 3 q - 2
words in a row, so a stretch of such triples that is too short for the distances in it
has no run. Nothing that has one is left out. Several stretches share one tree, with
words between them that occur once.

Defined results: null or empty text, or one of white space, has no words and no run; a
null ``doc_id`` leaves its text as it is; repeated rows give repeated results; ties
between runs of equal exponent go to the smallest start, then period; texts of any
length are taken whole, and memory grows with the longest text of a task; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_POWER = 6, 4
#: Words of texts that are looked at together.
TOGETHER = 1 << 19
_NEVER = np.iinfo(np.int64).max

Run = tuple[int, int, int]


class SuffixStructure:
    """Classes of equal stretches of 1, 2, 4, ... words, the suffix array and the suffix tree of a sequence.

    The sequence has to end in a word that occurs once.
    """

    def __init__(self, seq: np.ndarray) -> None:
        self.seq, self.n = seq, len(seq)
        n = self.n
        rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
        self.levels = [rank.astype(np.int32)]
        width = 1
        while rank.max() + 1 < n:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            self.levels.append(rank.astype(np.int32))
            width *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from ``i`` on and from ``j`` on; ``i`` and ``j`` differ."""
        i, j = i.copy(), j.copy()
        began = i.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            same = self.levels[level][i] == self.levels[level][j]
            i += same << level
            j += same << level
        return i - began

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words up to ``i`` and up to ``j``, both included; -1 stands before the first word."""
        i, j = i.copy(), j.copy()
        began = i.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            width = 1 << level
            fits = np.minimum(i, j) + 1 >= width
            at, to = np.where(fits, i - width + 1, 0), np.where(fits, j - width + 1, 0)
            same = fits & (self.levels[level][at] == self.levels[level][to])
            i -= same << level
            j -= same << level
        return began - i

    def blocks(self) -> np.ndarray:
        """Where Lempel-Ziv blocks begin, and the end: each is the longest stretch that began before, or one new word."""
        n = self.n
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        left, right = [-1] * n, [-1] * n
        order = self.order.tolist()
        # Suffixes leave the sorted list from the last one on, so neighbours are those that begin before.
        for i, r in zip(range(n - 1, -1, -1), self.rank[::-1].tolist(), strict=True):
            p, q = before[r], after[r]
            if p >= 0:
                left[i] = order[p]
                after[p] = q
            if q < n:
                right[i] = order[q]
                before[q] = p
        here, longest = np.arange(n), np.zeros(n, np.int64)
        for side in (left, right):
            other = np.array(side, np.int64)
            known = other >= 0
            longest[known] = np.maximum(longest[known], self.ahead(here[known], other[known]))
        step = np.maximum(longest, 1).tolist()
        starts, h = [], 0
        while h < n:
            starts.append(h)
            h += step[h]
        return np.array([*starts, n], np.int64)

    def grow_tree(self) -> None:
        """Leaves 0 to n-1 in sorted order, then the root, then the other inner nodes."""
        n = self.n
        shared = self.ahead(self.order[:-1], self.order[1:]).tolist()
        self.root = n
        parent, depths, lows, highs = [n] * (n + 1), [0], [0], [n - 1]
        path, top, deep = [n], n, 0
        for r, l in enumerate([*shared, 0]):
            if l > deep:
                top, deep = n + len(depths), l
                depths.append(l)
                lows.append(r)
                highs.append(r)
                parent.append(n)
                path.append(top)
                parent[r] = top
                continue
            parent[r] = top
            while deep > l:
                v = path.pop()
                highs[v - n] = r
                top = path[-1]
                deep = depths[top - n]
                if deep < l:
                    top, deep = n + len(depths), l
                    depths.append(l)
                    lows.append(lows[v - n])
                    highs.append(r)
                    parent.append(n)
                    path.append(top)
                parent[v] = top
        self.parent = np.array(parent, np.int64)
        self.depth = np.concatenate([n - self.order, np.array(depths, np.int64)])
        self.low = np.concatenate([np.arange(n), np.array(lows, np.int64)])
        self.high = np.concatenate([np.arange(n), np.array(highs, np.int64)])
        self.first = self.order[self.low]
        nodes = np.delete(np.arange(len(parent)), n)
        words = self.seq[self.first[nodes] + self.depth[self.parent[nodes]]]
        self.span = int(self.seq.max()) + 1
        self.child = dict(zip((self.parent[nodes] * self.span + words).tolist(), nodes.tolist(), strict=True))

    def earliest(self, nodes: np.ndarray) -> np.ndarray:
        """The first place of the words of each node."""
        low, high = self.low[nodes], self.high[nodes] + 1
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(nodes), np.int64)
        least = self.order
        for l in range(int(level.max(initial=-1)) + 1):
            at = level == l
            out[at] = np.minimum(least[low[at]], least[high[at] - (1 << l)])
            if len(least) > 1 << l:
                least = np.minimum(least[: -(1 << l)], least[1 << l :])
        return out

    def _names(self, i: np.ndarray, length: np.ndarray) -> list[tuple[int, int, int]]:
        """What tells stretches of words apart: their length and the classes of their two halves, which overlap."""
        level = np.frexp(length)[1] - 1
        ends = i + length - (1 << level)
        one, two = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        for l in np.unique(level):
            at = level == l
            one[at], two[at] = self.levels[l][i[at]], self.levels[l][ends[at]]
        return list(zip(length.tolist(), one.tolist(), two.tolist(), strict=True))

    def link_suffixes(self) -> None:
        """For each inner node the node of the same words without the first."""
        inner = np.arange(self.n + 1, len(self.parent))
        self.suffix = np.full(len(self.parent), self.root, np.int64)
        if not len(inner):
            return
        named = dict(zip(self._names(self.first[inner], self.depth[inner]), inner.tolist(), strict=True))
        longer = inner[self.depth[inner] > 1]
        self.suffix[longer] = [named[x] for x in self._names(self.first[longer] + 1, self.depth[longer] - 1)]


def covering_squares(tree: SuffixStructure) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares that cover the first occurrence of every square, from common extensions at blocks' ends."""
    ends = tree.blocks()
    here, to = ends[:-1], ends[1:]
    size = to - here
    following = np.append(size[1:], 0)

    def dealt(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block the numbers 1 to ``many`` of it."""
        block = np.repeat(np.arange(len(many)), many)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many) + 1

    found = []
    block, k = dealt(size[:-1])
    for at, q, k in ((to[block], to[block] - k, k), (lambda b, j: (here[b], here[b] + j, j))(*dealt(size + following))):
        inside = q < tree.n
        at, q, k = at[inside], q[inside], k[inside]
        right, left = tree.ahead(at, q), tree.behind(at - 1, q - 1)
        start = np.minimum(at, q) - np.minimum(left, k - 1)
        good = (left + right >= k) & (right > 0)
        found.append(np.stack([start[good], k[good]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pairs[0], pairs[1]


def vocabulary(tree: SuffixStructure, starts: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All squares that occur: the tree node at or below the end of each, and its period."""
    root, parent, depth, first = tree.root, tree.parent.tolist(), tree.depth.tolist(), tree.first.tolist()
    least = tree.earliest(np.arange(len(parent))).tolist()
    waiting: dict[int, list[int]] = defaultdict(list)
    for start, k in zip(starts.tolist(), periods.tolist(), strict=True):
        waiting[start].append(2 * k)
    marked: set[tuple[int, int]] = set()
    rank = tree.rank.tolist()
    # Bottom-up: a node takes over the list of the child with its first occurrence; the longest squares end lowest.
    for start, lengths in waiting.items():
        v = rank[start]
        while lengths:
            up = parent[v]
            while lengths and lengths[-1] > depth[up]:
                marked.add((v, lengths.pop()))
            if least[up] != start:
                break
            v = up
    seq, child, suffix, span = tree.seq.tolist(), tree.child, tree.suffix.tolist(), tree.span
    for v, length in list(marked):
        while True:
            i = first[v]
            lead, below = seq[i], parent[v]
            node = suffix[below] if below != root else root
            reach = length - 1
            while depth[node] < reach:
                nxt = child[node * span + seq[i + 1 + depth[node]]]
                if depth[nxt] > reach:
                    break
                node = nxt
            if depth[node] == reach:
                nxt = child.get(node * span + lead)
                if nxt is None:
                    break
            elif seq[first[nxt] + reach] != lead:
                break
            v = nxt
            if (v, length) in marked:
                break
            marked.add((v, length))
    held = np.array(list(marked), np.int64).reshape(-1, 2)
    return held[:, 0], held[:, 1] // 2


def _primitive(tree: SuffixStructure, i: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether no proper divisor of the period is a period of the square at ``i``."""
    keep = np.ones(len(i), bool)
    left, prime = period.copy(), 2
    most = int(period.max(initial=1))
    while prime <= most:
        if prime * prime > most:
            primes = np.unique(left[left > 1])
        else:
            primes = np.array([prime])
        for p in primes.tolist():
            at = np.flatnonzero(left % p == 0)
            at = at[left[at] > 1]
            part = period[at] // p
            keep[at] &= tree.ahead(i[at], i[at] + part) < 2 * period[at] - part
            while True:
                more = at[left[at] % p == 0]
                if not len(more):
                    break
                left[more] //= p
                at = more[left[more] > 1]
        if prime * prime > most:
            break
        prime += 1 if prime == 2 else 2
    return keep


def all_runs(seq: np.ndarray) -> np.ndarray:
    """(start, length, period) of every maximal run of at least two periods, in a sequence whose last word occurs once."""
    if len(seq) < 3:
        return np.empty((0, 3), np.int64)
    tree = SuffixStructure(seq.astype(np.int64))
    starts, periods = covering_squares(tree)
    if not len(starts):
        return np.empty((0, 3), np.int64)
    tree.grow_tree()
    tree.link_suffixes()
    node, period = vocabulary(tree, starts, periods)
    keep = _primitive(tree, tree.first[node], period)
    node, period = node[keep], period[keep]
    many = tree.high[node] - tree.low[node] + 1
    which = np.repeat(np.arange(len(node)), many)
    within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    at, q = tree.order[tree.low[node][which] + within], period[which]
    line = np.lexsort((at, q))
    at, q = at[line], q[line]
    new = np.ones(len(at), bool)
    new[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return np.stack([at[first], at[last] - at[first] + 2 * q[first], q[first]], axis=1)


def _stretches(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of texts that can hold a run; parts that overlap are one."""
    n = len(ids)
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if n < LEAST_WORDS:
        return nothing
    spread = int(ids.max()) + 1
    # Equal triples share a bucket; only those of shared buckets are compared.
    bucket = (ids[:-2] * 0x9E3779B1 + ids[1:-1] * 0x85EBCA77 + ids[2:] * 0xC2B2AE3D) >> 7 & (1 << (4 * n).bit_length()) - 1
    some = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
    pair = ids[some] * spread + ids[some + 1]
    if spread >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair * spread + ids[some + 2]
    line = np.argsort(triple, kind="stable")
    again = np.flatnonzero(triple[line][1:] == triple[line][:-1])
    far = np.full(n, _NEVER)
    far[some[line[again + 1]]] = some[line[again + 1]] - some[line[again]]
    # A triple across two texts, or seen before in another text only, is no repeat.
    far[: n - 2][owner[: n - 2] != owner[2:]] = _NEVER
    seen = np.flatnonzero(far < _NEVER)
    far[seen[owner[seen] != owner[seen - far[seen]]]] = _NEVER
    alive = far < _NEVER
    begin = end = np.empty(0, np.int64)
    for _ in range(32):
        edge = np.diff(alive.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = end - begin >= 3
        begin, end = begin[keep], end[keep]
        allowed = np.zeros(n, np.int64)
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            allowed[b:e] = (e - b + 2) // 3
        now = alive & (far <= allowed)
        if (now == alive).all():
            break
        alive = now
    if not len(begin):
        return nothing
    low = begin - (end - begin + 2) // 3
    low = np.maximum(low, np.searchsorted(owner, owner[begin]))
    high = end + 2
    joined: list[list[int]] = []
    for b, e in zip(low.tolist(), high.tolist(), strict=True):
        if joined and b < joined[-1][1]:
            joined[-1][0], joined[-1][1] = min(joined[-1][0], b), max(joined[-1][1], e)
            while len(joined) > 1 and joined[-1][0] < joined[-2][1]:
                b2, e2 = joined.pop()
                joined[-1][0], joined[-1][1] = min(joined[-1][0], b2), max(joined[-1][1], e2)
        else:
            joined.append([b, e])
    return np.array([x[0] for x in joined]), np.array([x[1] for x in joined])


def long_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """For each sequence of word numbers its runs of ``LEAST_WORDS`` words and ``LEAST_POWER`` periods or more, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[Run]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    ids = np.concatenate(texts).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.cumsum(sizes) - sizes
    begin, end = _stretches(ids, owner)
    at = 0
    while at < len(begin):
        held = at + max(1, int(np.searchsorted(np.cumsum(end[at:] - begin[at:]), TOGETHER, "right")))
        fresh = count(int(ids.max()) + 1)
        parts, places = [], []
        for b, e in zip(begin[at:held].tolist(), end[at:held].tolist(), strict=True):
            parts += [ids[b:e], [next(fresh)]]
            places.append(np.arange(b, e + 1))
        place = np.concatenate(places)
        for start, length, period in all_runs(np.concatenate(parts)).tolist():
            if length >= max(LEAST_WORDS, LEAST_POWER * period):
                start = int(place[start])
                doc = int(owner[start])
                out[doc].append((start - int(offset[doc]), length, period))
        at = held
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where, and with which period, the words of a document are made to repeat; ``None`` for most."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def sharpest(runs: Iterable[Run]) -> Run | None:
    """The run of greatest length by period; the first, then the one of the smallest period, of equal ones."""
    best = None
    for run in runs:
        if best is None or (run[1] * best[2], -run[0], -run[2]) > (best[1] * run[2], -best[0], -best[2]):
            best = run
    return best


def kept_words(words: list[str], runs: list[Run]) -> list[str]:
    """Words that no run has after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def runs_of_documents(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, words) of every document: all its long runs and the words that stay when each run is cut to its first period.

    With ``plant`` the words of some documents repeat first, as the query's contract has it.
    """
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _run_batches(batches, plant, _whole_rows),
        "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, words string",
    )


def _whole_rows(rows: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r[2]] for r in rows], kind),
            pa.array([" ".join(kept_words(r[1], r[2])) for r in rows], pa.string()),
        ],
        names=["doc_id", "n_words", "runs", "words"],
    )


_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    out = []
    for doc, words, runs in rows:
        best = sharpest(runs)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join([f"{s},{n},{p}\n" for s, n, p in runs])
        texts = (listed, " ".join(kept_words(words, runs)))
        out.append((doc, len(runs), *four, *(hashlib.sha256(t.encode()).hexdigest() for t in texts)))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _run_batches(batches: Iterator[pa.RecordBatch], plant: bool, shaped) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    held = 0

    def done() -> pa.RecordBatch:
        texts, used = [], 0
        for row in rows:
            # Words are told apart within a text only.
            number: defaultdict[str, int] = defaultdict(count(used).__next__)
            ids = np.fromiter(map(number.__getitem__, row[1]), np.int64, len(row[1]))
            used += len(number)
            made = planted(row[0], len(ids)) if plant else None
            if made:
                a, p = made
                places = np.arange(len(ids))
                places[a:] = a + (places[a:] - a) % p
                ids = ids[places]
                row[1] = [row[1][i] for i in places.tolist()]
            texts.append(ids)
        return shaped([(doc, words, runs) for (doc, words), runs in zip(rows, long_runs(texts), strict=True)])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = WORD.findall(text.as_py() or "")
            rows.append([doc, words])
            held += len(words) + 1
            if held >= TOGETHER:
                yield done()
                rows, held = [], 0
    if rows:
        yield done()


def runs_query(docs: DataFrame) -> DataFrame:
    """The digest of each document's runs, after the contract's repeats."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _run_batches(batches, True, _digest_rows), _DIGEST)
