"""Embedded media come out."""

from __future__ import annotations

import gzip
import random
import struct
import time

import pytest

from brightwake.llm import media


def test_embedded_objects_come_out(spark):
    inner = {k: media.encoded(media.padded(f"inside {k}".encode()), k) for k in media.FORMATS}
    values = [(k, b"prefix" + v + b"rest") for k, v in inner.items()]
    rows = spark.createDataFrame([(i, "octet-stream", bytearray(v)) for i, (_, v) in enumerate(values)] + [(9, "wav", None)], "doc_id long, declared string, media binary")
    found = {r.doc_id: r for r in media.carved(rows).collect()}
    assert set(found) == set(range(len(values)))
    for i, (k, _) in enumerate(values):
        assert (found[i].kind, found[i].offset, bytes(found[i].object)) == (k, 6, inner[k])
        assert bytes(found[i].samples) == media.padded(f"inside {k}".encode())


def test_query_lists_embedded_objects(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert media.media_query(docs).first().embedded == []


def plain_gif_end(data, at):
    """The end of a GIF by walking it on its own."""
    if len(data) < at + 13:
        return None
    p = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 128 else 0)
    while p < len(data):
        if data[p] == 0x3B:
            return p + 1
        if data[p] == 0x21:
            p += 2
        elif data[p] == 0x2C and p + 10 < len(data):
            p += 11 + (3 << (data[p + 9] & 7) + 1 if data[p + 9] & 128 else 0)
        else:
            return None
        while p < len(data) and data[p]:
            p += data[p] + 1
        p += 1
    return None


def test_gif_runs_equal_plain_walks():
    rng = random.Random(4)
    for _ in range(300):
        data = b"".join(rng.choice((b"GIF89a", b"GIF87a" + bytes(7), b"!\xf9", b",", b"\0", b"\x01a", b"\x02ab", b"\0\0", b";", bytes(10))) for _ in range(80))
        want = [("gif", i, plain_gif_end(data, i) - i) for i in range(len(data)) if data[i : i + 6] in (b"GIF89a", b"GIF87a") and plain_gif_end(data, i)]
        assert [x[:3] for x in media.objects(data) if x[0] == "gif"] == want


def test_gzip_members_come_out():
    rng = random.Random(5)
    inner = [gzip.compress(rng.randbytes(n) + b"a" * n) for n in (0, 10, 5000, 3_000_000)]
    data = b"xx".join([b"", *inner, b"\x1f\x8b\x08\0 broken"])
    at, want = 0, []
    for x in inner:
        want.append(("gzip", at + 2, len(x)))
        at += 2 + len(x)
    assert [x[:3] for x in media.objects(data) if x[0] == "gzip" and x[1:3] in {w[1:] for w in want}] == want


@pytest.mark.parametrize("unit", [b"GIF89a", b"GIF89a\0\0\0\0\0\0\0!a\x01a", b"GIF89a\0\0\0\0\0\0\0,0123456789", b"\x1f\x8b\x08", b"\x1f\x8b\x08\0\0\0\0\0\0\0\0", b"RIFF\x40\0\0\0WAVEfmt ", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR", b"BM"])
def test_hostile_values_take_linear_time(unit):
    data = unit * (10_000_000 // len(unit))
    began = time.process_time()
    media.objects(data)
    assert time.process_time() - began < 15


def test_padded_stream_lengths_are_checked():
    wav = media.encoded(media.padded(b"a"), "wav")
    assert media.sniff(wav[:4] + struct.pack("<I", len(wav)) + wav[8:])[0] == "unknown"
