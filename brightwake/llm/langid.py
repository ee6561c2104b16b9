"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (orders 1 to 4, the
blended spectrum) present in both, divided by the root of the product of their
numbers of n-grams. N-grams are taken from the lower-cased text with runs of
other characters than letters as one space, and hashed to ``CELLS`` cells.
Landmark texts give a Nystroem approximation of the kernel, on which one-versus-
rest kernel ridge regression is solved: with K_nm the kernel between training
texts and landmarks and K_mm that among landmarks, the coefficients are
(K_nm' K_nm + ridge K_mm)^-1 K_nm' Y. As the kernel is a product of presence
vectors, a batch of texts is scored by one matrix product of its presence matrix
with the landmarks' presence matrix times the coefficients.

Fitting uses up to ``SAMPLE`` texts of each language, those of the least hashes of
``doc_id`` and text, and its shortest one, repeated rows once. All languages share
``CHARACTERS`` in equal parts; a text that does not fit into what is left of its
language's part is passed over, so a language is learned if its shortest text fits.
Every document is predicted from its whole text.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
if nothing could be learned; null ``doc_id`` rows are predicted and count as not
held out; ties go to the language that sorts first; repeated rows are predicted
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .samples import fitting

ORDERS = 4
CELLS = 1 << 15
SAMPLE = 200
LANDMARKS = 40
RIDGE = 1e-2
BATCH = 32
#: Up to so many languages have the full sample and landmarks; with more, each has less, and none is left out.
FULL_LANGUAGES = 50
#: Most characters that are learned from.
CHARACTERS = 100_000_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _cells(text: str) -> np.ndarray | None:
    """Cells of all n-grams of a text, with repeats; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first of each run of other characters
    runs = np.where(letter, codes, np.uint32(32))[kept].astype(np.uint64)
    runs = np.concatenate([np.array([32], np.uint64), runs[int(runs[0] == 32) : len(runs) - int(runs[-1] == 32)], np.array([32], np.uint64)])
    out, rolled = [], np.zeros(len(runs), np.uint64)
    for n in range(1, ORDERS + 1):
        if len(runs) < n:
            break
        rolled = rolled[: len(runs) - n + 1] * np.uint64(0x100000001B3) + runs[n - 1 :]
        out.append(((rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15))
    return np.concatenate(out).astype(np.int64)


def presence(texts: list[str | None], into: np.ndarray | None = None) -> tuple[np.ndarray, list[bool]]:
    """Presence matrix of the texts, each row divided by the root of its number of n-grams, and which have letters."""
    matrix = np.zeros((len(texts), CELLS), np.float32) if into is None else into[: len(texts)]
    matrix.fill(0)
    there = []
    for i, text in enumerate(texts):
        cells = _cells(text) if text else None
        there.append(cells is not None)
        if cells is not None:
            matrix[i, cells] = 1
    n = matrix.sum(axis=1)
    matrix /= np.sqrt(np.maximum(n, 1))[:, None]
    return matrix, there


@dataclass
class Model:
    """Languages, and the weight of each cell for each of them."""

    languages: list[str]
    weights: np.ndarray


def fit(texts: list[str | None], languages: list[str], ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nystroem landmarks; texts should come in a random order."""
    names = sorted(set(languages))
    most = max(1, min(LANDMARKS, LANDMARKS * FULL_LANGUAGES // max(1, len(names))))
    taken: dict[str, int] = dict.fromkeys(names, 0)
    chosen = []
    for i, name in enumerate(languages):
        if taken[name] < most:
            taken[name] += 1
            chosen.append(i)
    if not chosen:
        return Model([], np.zeros((CELLS, 0), np.float32))
    landmarks, _ = presence([texts[i] for i in chosen])
    kernel = np.concatenate([presence(texts[at : at + BATCH])[0] @ landmarks.T for at in range(0, len(texts), BATCH)]).astype(float)
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    among = (landmarks @ landmarks.T).astype(float)
    system = kernel.T @ kernel + ridge * len(texts) / len(chosen) * among + 1e-6 * np.eye(len(chosen))
    coefficients = np.linalg.solve(system, kernel.T @ target)
    return Model(names, (landmarks.T @ coefficients.astype(np.float32)))


def predict(model: Model, texts: list[str | None], into: np.ndarray | None = None) -> list[tuple[str, float]]:
    matrix, there = presence(texts, into)
    if not model.languages:
        return [(UNKNOWN, 0.0)] * len(texts)
    values = matrix @ model.weights
    best = values.argmax(axis=1)
    scores = np.clip((values[np.arange(len(texts)), best] + 1) / 2, 0, 1)
    return [(model.languages[b], float(s)) if ok else (UNKNOWN, 0.0) for b, s, ok in zip(best, scores, there, strict=True)]


def held_out():
    """True for the documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS) -> Model:
    """Fit on up to ``sample`` documents of each language, and its shortest one, that are not held out."""
    known = docs.select("doc_id", "text", "lang").where(~held_out()).where("lang is not null and doc_id is not null and text is not null")
    known = known.withColumn("key", F.xxhash64("doc_id", "text"))
    shortest = F.min(F.struct(F.length("text").alias("n"), F.col("key").alias("key")))["key"]
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n"), shortest.alias("shortest")).collect()  # a row a language
    if not sizes:
        return fit([], [])
    sample = max(1, min(sample, sample * FULL_LANGUAGES // len(sizes)))
    # More are drawn than are taken, so that a language has its least hashes among them.
    shares = [(r["lang"], min(1.0, (3 * sample + 20) / max(1, r["n"])), r["shortest"]) for r in sizes]
    drawn = known.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double, shortest long")), "lang")
    # The whole hash as a number from 0 to 1, so that any share can be drawn.
    drawn = drawn.where((F.col("key") / F.lit(2.0**64) + 0.5 < F.col("share")) | (F.col("key") == F.col("shortest")))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    taken = drawn.dropDuplicates(["doc_id", "text", "lang"]).withColumn("turn", turn).where((F.col("turn") <= sample) | (F.col("key") == F.col("shortest")))
    ordered = taken.orderBy(F.xxhash64("text", "doc_id"), "doc_id", "lang").select("text", "lang")
    found = fitting(((r["text"], r["lang"]) for r in ordered.toLocalIterator()), characters // len(sizes))
    return fit([t for t, _ in found], [lang for _, lang in found])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = np.zeros((BATCH, CELLS), np.float32)
        for batch in batches:
            found: list[tuple[str, float]] = []
            for at in range(0, batch.num_rows, BATCH):
                found += predict(sent.value, batch.column(1).slice(at, BATCH).to_pylist(), buffer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_query(docs: DataFrame) -> DataFrame:
    return identified(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
