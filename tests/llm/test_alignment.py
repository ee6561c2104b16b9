"""Alignment of two tokenizers against the definition, token by token."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brightwake.llm import alignment
from brightwake.llm.tokens import letters_of_bytes

A = Tokenizer.from_file(public_tokenizers.path(alignment.A_FILE))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_FILE))
BYTE = {c: b for b, c in enumerate(letters_of_bytes())}
WORD = {i: w for w, i in A.get_vocab().items()}

ODD = [
    None, "", " ", "  a", "a ", "a▁b", "x　y\xa0 z", "<|endoftext|> <s> </s> <0x41>", "naïve café — “q” ﬁ", "😀\t\n\r\n  b",
    "don't we'll 'S ª º × 12a3 ſŉ", "\x00\x1f a", "日本語 テキスト" * 20, "word " * 9000, "q" * 700, "é" * 300,
]


def bytes_a(i: int) -> bytes:
    return bytes(BYTE[c] for c in WORD[i])


def bytes_b(i: int) -> bytes:
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def swept(text: str | None):
    """(n_a, n_b, groups, links) by walking both lists; ``None`` without tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    if not b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == b" " + text.encode():
        return None
    groups, links, x, y, ga, gb, i, j = [], [], 0, 0, [], [], 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            ga.append(a[i])
            x += len(bytes_a(a[i]))
            i += 1
        else:
            gb.append(b[j])
            y += len(bytes_b(b[j]))
            j += 1
        if x == y and ga and gb:
            groups.append((ga, gb))
            links.append((ga[-1], gb[-1]))
            ga, gb = [], []
    return len(a), len(b), groups, links


def plain(rows):
    found = [(doc, swept(text)) for doc, text in rows]
    count = Counter(link for _, f in found if f for link in f[3])
    most: dict[int, int] = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    for doc, f in found:
        if f is None:
            yield doc, 0, 0, 0, 0, 0, 0, ""
            continue
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in f[2])
        yield doc, f[0], f[1], len(f[2]), len(f[3]), sum(count[k] == most[k[1]] for k in f[3]), sum(count[k] for k in f[3]), hashlib.sha256(shown.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark, data):
    held = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    odd = [(None if i % 5 == 0 else 10**6 + i, text) for i, text in enumerate(ODD)]
    return [*held, *odd, *[held[3]] * 3, (7, "dup text"), (7, "other"), *[(None, "same text here")] * 50, *[(None, None)] * 50]


@pytest.mark.parametrize("window", [alignment.WINDOW, 40])
def test_query_against_the_definition(spark, rows, window):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS pair", "'x' AS chunk", "1 AS h")
    got = Counter(map(tuple, alignment.alignment_query(docs, window=window).collect()))
    assert got == Counter(plain(rows))


def test_groups_hold_all_bytes_and_tokens(spark, rows):
    docs = spark.createDataFrame(rows[-90:], "doc_id long, text string")
    groups = alignment.aligned_groups(docs, window=30).collect()
    want = [(doc, f) for doc, f in ((doc, swept(text)) for doc, text in rows[-90:]) if f]
    assert len(groups) == sum(len(f[2]) for _, f in want)
    assert Counter((g.doc_id, tuple(g.a_ids), tuple(g.b_ids)) for g in groups) == Counter((doc, tuple(x), tuple(y)) for doc, f in want for x, y in f[2])
    assert all(sum(len(bytes_a(i)) for i in g.a_ids) == sum(len(bytes_b(i)) for i in g.b_ids) == g.end - g.start for g in groups)


def test_events_end_where_tokens_end(spark):
    docs = spark.createDataFrame([(1, "a text of words " * 30)], "doc_id long, text string")
    events = alignment.token_events(docs, window=50).collect()
    assert {e.side for e in events} == {0, 1}
    assert sorted({e.offset for e in events}) == list(range(0, 481, 50))


def test_words_give_the_libraries_ids(rows):
    for side, want in ((alignment.ByteLevel(), lambda t: A.encode(" " + t, add_special_tokens=False).ids), (alignment.Pieces(), B.encode)):
        assert side.by_words
        texts = [text for _, text in rows if text]
        assert sum(side.split(t) is not None for t in texts) > 200
        for text, ids in zip(texts, side.checked(texts), strict=True):
            assert (ids is None) == (side.text_of(want(text)) != b" " + text.encode())
            assert ids is None or ids.tolist() == want(text)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_query(none).count() == 0
    assert alignment.aligned_groups(none).count() == 0
