"""Runs of repeated words against all periods tried at all places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from brightwake.llm import runs


def plain_runs(words) -> set[tuple[int, int, int]]:
    """Every maximal run of two periods or more, by its smallest period."""
    seen: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                seen.setdefault((i, j - i + q), q)
            i = j + 1
    return {(s, n, q) for (s, n), q in seen.items()}


def plain_long_runs(words) -> list[tuple[int, int, int]]:
    return sorted((r for r in plain_runs(words) if r[1] >= max(6, 4 * r[2])), key=lambda r: (r[0], r[2]))


def made_up(rng: random.Random, most: int) -> list[int]:
    n, k = rng.randint(0, most), rng.choice([1, 2, 2, 3, 4, 30])
    words = [rng.randrange(k) for _ in range(n)]
    if n > 4 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + rng.randrange((n - a) // 2 + 1)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_any_power(seed):
    rng = random.Random(seed)
    for _ in range(400):
        words = made_up(rng, 60)
        assert {tuple(r) for r in runs.all_runs(np.array([*words, 99])).tolist()} == plain_runs(words), words


def test_long_runs_of_many_texts_at_once():
    rng = random.Random(9)
    for _ in range(120):
        texts = [made_up(rng, 50) for _ in range(rng.randint(1, 12))]
        assert runs.long_runs([np.array(t, np.int64) for t in texts]) == [plain_long_runs(t) for t in texts]


def test_known_shapes():
    fibonacci = [0], [0, 1]
    for _ in range(12):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for words in ([0] * 500, [0, 1] * 300, ([0] * 9 + [1]) * 12, fibonacci[1][:400], list(range(50)) * 5, [1, 2, 3] * 3):
        assert runs.long_runs([np.array(words)])[0] == plain_long_runs(words)
    assert runs.long_runs([np.arange(200_000) % 40_000])[0] == [(0, 200_000, 40_000)]


def test_rules_of_the_digest():
    assert runs.sharpest([(0, 8, 2), (9, 12, 3), (30, 8, 2)]) == (0, 8, 2)
    assert runs.sharpest([]) is None
    assert runs.kept_words(list("xababababyy"), [(1, 8, 2)]) == list("xabyy")
    assert runs.planted(None, 9) is None
    assert runs.planted(1, 0) is None


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, p = (h // 10) % n, None
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_long_runs(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    four = (*best, int(1000 * best[1] // best[2])) if best else (None,) * 4
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(w for i, w in enumerate(words) if i not in drop))]
    return (doc_id, len(found), *four, *sha)


def test_query_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").where("length(text) < 4000")
    odd = [(1, None, "a"), (2, "", "a"), (3, " \n ", "a"), (None, "go " * 9, "a"), (None, "go " * 9, "a"), (4, "x y " * 20_000, "a")]
    both = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("start", docs.doc_id)
    got = sorted(map(str, map(tuple, runs.runs_query(both).collect())))
    want = [plain_digest(r.doc_id, r.text) for r in both.where("length(text) < 70000 OR text IS NULL").collect()]
    long = (4, 1, 0, 40_000, 2, 20_000_000, hashlib.sha256(b"0,40000,2\n").hexdigest(), hashlib.sha256(b"x y").hexdigest())
    assert zlib.crc32(b"4") % 10
    assert got == sorted(map(str, [*want, long]))
    assert sum(w[1] > 0 for w in want) > 3


def test_whole_results_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c")], "doc_id long, text string")
    row = runs.runs_of_documents(docs).first()
    assert (row.doc_id, row.n_words, [tuple(r) for r in row.runs], row.words) == (1, 9, [(0, 8, 2)], "a b c")
    none = docs.limit(0)
    assert runs.runs_query(none).count() == runs.runs_of_documents(none).count() == 0
