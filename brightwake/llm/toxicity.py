"""Toxicity by subword bags.

A word is the bag of its character n-grams (with word boundaries), hashed to
embedding rows; a window of words is the mean of its words' mean rows, and a
linear softmax over that mean gives the class. Embeddings and softmax are
trained jointly in numpy, so a misspelling or an unseen ending shares most rows
with words seen in training. Labels belong to whole documents, so training
alternates: it begins with random windows of ``FIRST`` words, and then represents
every document by its ``TOP_WORDS`` most toxic distinct words under the model so
far (and clean documents by random words too). Once trained, a model is one
number for each embedding row, and a word's logit is the mean of its rows'.

A document is judged by its ``TOP`` greatest distinct word logits and its number
of words, by a logistic map with weights that are not negative on the logits.
That map is fitted out of fold: the labelled documents are dealt into ``FOLDS``
parts by a hash, a model is trained without each part and rates it, and the model
that scores is the mean of these. Both classes weigh the same in the map, so a
score is the probability of label 1 where both labels are equally frequent.

Fitting uses about ``SAMPLE`` toxic and ``CLEAN`` times as many clean labelled
rows, picked by a hash of ``doc_id``, one text for each, in the order of another
hash. Each label has half of ``CHARACTERS``; a text that does not fit into what is
left of that is passed over. Scoring covers every document's whole text.

Defined results: null, empty or blank text scores 0; null ``doc_id`` rows are
scored and count as not held out; a document with repeated or conflicting labels
counts as toxic if any label is; of several texts of one id, the one with the
least hash is learned from; without labels of both classes every score is 0;
repeated rows are scored alike; an empty table gives an empty result; extra
columns are ignored by the query and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import fitting
from .scratch import unused

ROWS = 1 << 17
DIM = 4
GRAMS = (3, 4, 5, 6)
#: Words in a window of the first round, and such windows of a document.
FIRST, WINDOWS = 96, 2
SAMPLE = 1500
#: Clean documents for each toxic one.
CLEAN = 3
#: Most characters that are learned from.
CHARACTERS = 50_000_000
FOLDS = 3
ROUNDS = 5
EPOCHS = 18
#: Words that stand for a document in a later round, and random ones that stand for a clean one.
TOP_WORDS, RANDOM_WORDS = 5, 2
#: Word logits that a document is judged by.
TOP = 6
#: Longest move of an entry in a step.
RATE = {"E": 0.5, "W": 0.02, "b": 0.1}
#: Number of entries that move that far.
FAST = 1000
DECAY = 1e-6
THRESHOLD = 0.7
#: Words whose rows are gathered at once.
CHUNK = 20_000
#: Word logits kept in a task.
KEPT_WORDS = 150_000
_EDGES = string.punctuation + "«»“”„’‘¡¿…–—"


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bags(of: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the words' n-grams, word after word, and the number of rows of each word."""
    parts = [_bags(of[at : at + 10_000]) for at in range(0, len(of), 10_000)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _bags(of: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w.strip(_EDGES) or w}>" for w in of]
    sizes = np.array([len(w) for w in marked])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    stop = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(of)), sizes)
    rows, owners = [], []
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, GRAMS[-1] + 1):
        reach = len(codes) - n + 1
        if reach <= 0:
            break
        rolled = rolled[:reach] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in GRAMS:
            whole = np.arange(reach) + n <= stop[:reach]
            h = (rolled[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            rows.append((h >> np.uint64(64 - 17)).astype(np.int32))
            owners.append(owner[:reach][whole])
    row, own = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return row[order], np.bincount(own, minlength=len(of)).astype(np.int32)


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts = np.cumsum(counts, dtype=np.int64) - counts
    return np.add.reduceat(values, starts, axis=0) / (counts[:, None] if values.ndim > 1 else counts)


def _scattered(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], axis=1).astype(np.float32)


class Bags:
    """Rows of many words, read and written a bounded number of words at a time."""

    def __init__(self, row: np.ndarray, counts: np.ndarray) -> None:
        self.row, self.counts = row, counts
        self._begins = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.counts)

    def _chunks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(self), CHUNK):
            words_ = slice(at, min(at + CHUNK, len(self)))
            yield words_, self.row[self._begins[words_.start] : self._begins[words_.stop]]

    def of(self, used: np.ndarray) -> Bags:
        """The bags of some of the words."""
        counts = self.counts[used]
        offset = np.arange(counts.sum(dtype=np.int64)) - np.repeat(np.cumsum(counts, dtype=np.int64) - counts, counts)
        return Bags(self.row[np.repeat(self._begins[used], counts) + offset], counts)

    def means(self, table: np.ndarray) -> np.ndarray:
        """Each word's mean of the table's entries at its rows."""
        out = np.empty((len(self), *table.shape[1:]), np.float32)
        for words_, row in self._chunks():
            out[words_] = _means(table[row], self.counts[words_])
        return out

    def spread(self, each: np.ndarray, rows: int) -> np.ndarray:
        """The transpose of ``means``: what the words' values give to every row."""
        out = np.zeros((rows, each.shape[1]), np.float32)
        for words_, row in self._chunks():
            n = self.counts[words_]
            out += _scattered(row, np.repeat(each[words_] / n[:, None], n, axis=0), rows)
        return out


@dataclass
class Model:
    """One logit for each embedding row, the softmax's bias, and the map from a document's facts to its score."""

    table: np.ndarray
    bias: float
    weights: np.ndarray
    shift: float
    #: What stands for the logits that a text of few words lacks.
    usual: np.ndarray

    def word_logits(self, of: list[str]) -> np.ndarray:
        return Bags(*bags(of)).means(self.table) + self.bias

    def probability(self, logits: np.ndarray, n_words: int) -> float:
        """Score of a document from the logits of its distinct words."""
        z = float(facts(logits, n_words, self.usual) @ self.weights) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def facts(logits: np.ndarray, n_words: int, usual: np.ndarray | None = None) -> np.ndarray:
    """The greatest ``TOP`` logits, descending (NaN or the ``usual`` ones where there are fewer), and the log of the number of words."""
    top = np.full(TOP, np.nan) if usual is None else usual.astype(float).copy()
    best = np.sort(np.partition(logits, len(logits) - TOP)[-TOP:] if len(logits) > TOP else logits)[::-1]
    top[: len(best)] = best
    return np.append(top, np.log(n_words))


class Scorer:
    """Scores texts with a model; keeps the logits of words it has met."""

    def __init__(self, model: Model) -> None:
        self._model, self._known = model, {}

    def score(self, texts: list[str | None]) -> list[float]:
        split = [words(t) for t in texts]
        distinct = [dict.fromkeys(s) for s in split]
        known = self._known
        new = list(dict.fromkeys(w for s in distinct for w in s if w not in known))
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = list(dict.fromkeys(w for s in distinct for w in s))
        if new:
            known.update(zip(new, self._model.word_logits(new).tolist(), strict=True))
        own = [np.fromiter(map(known.__getitem__, d), float, len(d)) for d in distinct]
        return [self._model.probability(x, len(s)) if s else 0.0 for x, s in zip(own, split, strict=True)]


def _epoch(state: dict, used: Bags, word: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """One full-batch step of the embeddings, the softmax weights and its bias.

    Each matrix moves along its averaged gradient, scaled as a whole: rows that
    many documents share move most, and rows of single documents hardly move.
    """
    E, W, b = state["E"], state["W"], state["b"]
    hidden = _means(used.means(E)[word], sizes)
    z = hidden @ W + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    dz = p * weight[:, None]
    d_words = _scattered(word, np.repeat((dz @ W.T / sizes[:, None]).astype(np.float32), sizes, axis=0), len(used))
    grads = {"E": used.spread(d_words, len(E)) + DECAY * E, "W": hidden.T @ dz + DECAY * W, "b": dz.sum(axis=0)}
    for name, g in grads.items():
        m = state["m" + name]
        m += 0.2 * (g - m)
        size = np.abs(m)
        top = float(np.partition(size.ravel(), -FAST)[-FAST]) if size.size > FAST else float(size.max())
        state[name] -= RATE[name] * np.clip(m / (top + 1e-12), -1, 1)


def _embedded(bag: Bags, docs: list[np.ndarray], distinct: list[np.ndarray], y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Table and bias of a model trained on these documents (ids of their words, and of their distinct words)."""
    rng = np.random.default_rng(seed)
    state = {"E": rng.normal(0, 0.05, (ROWS, DIM)).astype(np.float32), "W": rng.normal(0, 0.3, (DIM, 2)), "b": np.zeros(2)}
    state |= {"m" + name: np.zeros_like(state[name]) for name in ("E", "W", "b")}

    def folded() -> tuple[np.ndarray, float]:
        direction = state["W"][:, 1] - state["W"][:, 0]
        return state["E"] @ direction.astype(np.float32), float(state["b"][1] - state["b"][0])

    begins = [(d, int(rng.integers(max(1, len(docs[d]) - FIRST + 1)))) for d in range(len(docs)) for _ in range(WINDOWS)]
    pieces, target = [docs[d][at : at + FIRST] for d, at in begins], np.repeat(y, WINDOWS)
    clean = [rng.choice(distinct[d], RANDOM_WORDS) for d in np.flatnonzero(y == 0)]
    for turn in range(ROUNDS):
        if turn:
            logits = bag.means(folded()[0])
            chosen = [own[np.argsort(-logits[own], kind="stable")[:TOP_WORDS]] for own in distinct]
            clean += [c for c, label in zip(chosen, y, strict=True) if not label]
            toxic = [c for c, label in zip(chosen, y, strict=True) if label]
            pieces = np.concatenate([*toxic, *clean])[:, None]
            target = np.repeat([1, 0], [sum(map(len, toxic)), sum(map(len, clean))])
        sizes = np.array([len(p) for p in pieces])
        used, word = np.unique(np.concatenate(pieces), return_inverse=True)
        weight = 0.5 / np.maximum(np.bincount(target, minlength=2), 1)[target]
        own = bag.of(used)
        for _ in range(EPOCHS):
            _epoch(state, own, word, sizes, target, weight)
    return folded()


def fit(texts: list[str | None], toxic: list[int], seed: int = 7) -> Model:
    """Train on whole documents with labels 0 and 1."""
    vocabulary: dict[str, int] = {}
    docs, labels, part = [], [], []
    for text, label in zip(texts, toxic, strict=True):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
        if ids:
            docs.append(np.array(ids, np.int32))
            labels.append(label)
            part.append(zlib.crc32(text.encode("utf-8", "surrogatepass")) % FOLDS)
    y, fold = np.array(labels, np.int64), np.array(part)
    if any(len(set(y[fold != k])) < 2 for k in range(FOLDS)):
        fold = np.arange(len(y)) % FOLDS
    if any(len(set(y[fold != k])) < 2 for k in range(FOLDS)):
        return Model(np.zeros(ROWS, np.float32), 0.0, np.zeros(TOP + 1), -500.0, np.zeros(TOP))
    bag = Bags(*bags(list(vocabulary)))
    del vocabulary
    distinct = [np.unique(d) for d in docs]
    table, bias, told = np.zeros(ROWS), 0.0, np.empty((len(docs), TOP + 1))
    for k in range(FOLDS):
        inside = np.flatnonzero(fold != k)
        own, own_bias = _embedded(bag, [docs[d] for d in inside], [distinct[d] for d in inside], y[inside], seed + k)
        table += own / FOLDS
        bias += own_bias / FOLDS
        logits = bag.means(own) + own_bias
        for d in np.flatnonzero(fold == k):
            told[d] = facts(logits[distinct[d]], len(docs[d]))
    usual = np.nan_to_num(np.nanmean(told[y == 0, :TOP], axis=0)) if np.isfinite(told[y == 0, :TOP]).any(axis=0).all() else np.full(TOP, bias)
    told[:, :TOP] = np.where(np.isnan(told[:, :TOP]), usual, told[:, :TOP])
    weights, shift = judged(told, y)
    return Model(table.astype(np.float32), bias, weights, shift, usual)


def judged(told: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and shift of a logistic map with classes of equal weight; logits that would count against toxicity are left out, one at a time."""
    mean, spread = told.mean(axis=0), told.std(axis=0) + 1e-9
    x = np.hstack([(told - mean) / spread, np.ones((len(y), 1))])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    used = np.ones(x.shape[1], bool)
    while True:
        w, cells = np.zeros(x.shape[1]), np.flatnonzero(used)
        penalty = np.append(np.full(len(cells) - 1, ridge), 1e-3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            own = x[:, cells]
            gradient = own.T @ (share * (p - y)) + penalty * w[cells]
            step = np.linalg.solve((own * (share * p * (1 - p))[:, None]).T @ own + np.diag(penalty), gradient)
            w[cells] -= step / max(1.0, float(np.abs(step).max()) / 3)
        least = int(np.argmin(w[:TOP]))
        if w[least] >= 0:
            break
        used[least] = False
    weights = w[:-1] / spread
    return weights, float(w[-1] - weights @ mean)


def held_out(doc_id: str = "doc_id"):
    """True for the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS) -> Model:
    """Fit on labelled documents that are not held out: about ``sample`` toxic and ``CLEAN * sample`` clean ones."""
    known = labels.where(~held_out()).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(sample / max(1, sizes.get(1, 0)))).otherwise(F.lit(CLEAN * sample / max(1, sizes.get(0, 0))))
    # The whole hash as a number from 0 to 1, so that any share can be drawn.
    picked = known.where(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 < share)
    # About (1 + CLEAN) * sample rows by the shares, whatever the tables' sizes.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    ordered = rows.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
    found = fitting(((r["text"] or "", (r["toxic"], r["doc_id"])) for r in ordered.toLocalIterator()), characters // 2, of=lambda label: label[0])
    found.sort(key=lambda f: f[1][1])
    return fit([text for text, _ in found], [label[0] for _, label in found])


def scored(docs: DataFrame, model: Model, score: str, *keep: str) -> DataFrame:
    """``keep`` columns of every document with its score in a column of that name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own_text = unused(keep, "text")
    narrow = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias(own_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            own = []
            for at in range(0, batch.num_rows, 64):
                own += scorer.score(batch.column(own_text).slice(at, 64).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(own, pa.float64())], names=[*keep, score])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema if f.name != own_text)
    return narrow.mapInArrow(run, f"{kinds}`{score}` double")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs, train(docs, labels), "score", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    score = unused(docs.columns, "score")
    rows = scored(docs, train(docs, labels), score, *docs.columns)
    return rows.where(F.col(score) < THRESHOLD).select(*(f"`{c}`" for c in docs.columns))
