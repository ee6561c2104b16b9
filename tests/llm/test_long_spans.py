"""Spans that reach beyond a base span."""

from __future__ import annotations

import random
import string

from brightwake.llm import pii


def test_spans_beyond_a_base_span_stay(spark):
    text = "my secret key: sk_live_4572801887383181abcd end"
    docs = spark.createDataFrame([(i, text) for i in range(20)] + [(99, "card 4572801887383181 end")], "doc_id long, text string")
    cands = pii.annotate(docs, "base", "cand", "doc_id").where("doc_id = 0").first()["cand"]
    assert [(c.kind_name, c.start, c.end) for c in cands] == [("secret", 15, 43)]
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "my secret key: [SECRET] end"
    assert clean[99] == "card [CARD] end"


def account(rng, country, length):
    body = "".join(rng.choice(string.digits) for _ in range(length - 4))
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02}{body}"


def test_account_checks(spark):
    rng = random.Random(3)
    good = [account(rng, c, n) for c, n in pii._IBAN_LENGTHS.items() for _ in range(5)] + ["GB82 WEST 1234 5698 7654 32"]
    bad = [x[:-1] + str((int(x[-1]) + 1) % 10) for x in good] + [account(rng, "DE", 20)]
    rows = spark.createDataFrame([(x,) for x in good + bad], "m string")
    assert [r.ok for r in rows.select(pii.account_checks(rows.m).alias("ok")).collect()] == [True] * len(good) + [False] * len(bad)


def test_added_kinds_on_planted_spans(spark):
    """Precision and recall of the added kinds where the truth is known; decoys look alike and are not personal."""
    rng = random.Random(11)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    real = {
        "secret": lambda: (rng.choice(('token = "', "api_key: ", "password=")), rng.choice((hexed(40), "sk_live_" + hexed(24), "ghp_" + hexed(36)))),
        "national_id": lambda: (rng.choice(("ssn ", "tax id: ", "")), f"{rng.randrange(100, 660)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        "iban": lambda: (rng.choice(("iban ", "account: ", "")), account(rng, *rng.choice(list(pii._IBAN_LENGTHS.items())))),
        "local_phone": lambda: (rng.choice(("call ", "phone: ", "")), f"{rng.randrange(201, 989)}-{rng.randrange(201, 989)}-{digits(4)}"),
        "person": lambda: (rng.choice(("dear Mr. ", "signed Dr. ", "name: Mrs. ")), rng.choice(pii._NAMES) + " " + rng.choice(("Miller", "Schmidt", "Garcia", "Durand"))),
    }
    decoy = [
        lambda: "release-candidate-build-" + digits(2),
        lambda: f"000-{digits(2)}-{digits(4)}",
        lambda: "version XX" + digits(2) + digits(16),
        lambda: f"score 0{digits(2)}-1{digits(2)}-{digits(4)}",
    ]
    words = [rng.choice(("erst", "wird", "alpha", "beta", "sombra", "livre")) + rng.choice("aeiou") for _ in range(50)]
    rows, truth, wrong = [], set(), set()
    for i in range(1500):
        text = " ".join(rng.choices(words, k=12)) + " "
        kind = rng.choice(list(real)) if i % 3 else None
        before, m = real[kind]() if kind else ("", rng.choice(decoy)())
        at = len(text) + len(before)
        (truth if kind else wrong).add((i, at, at + len(m)))
        if kind:
            truth.discard((i, at, at + len(m)))
            truth.add((i, kind, at, at + len(m)))
        rows.append((i, text + before + m + " " + " ".join(rng.choices(words, k=8))))
    found = set()
    for r in pii.pii_query(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for s in filter(None, r.spans.split(",")):
            kind, start, end = s.split(":")
            found.add((r.doc_id, kind, int(start), int(end)))
    added = {f for f in found if f[1] in pii.ADDED_KINDS}
    for kind in pii.ADDED_KINDS:
        mine = {t for t in truth if t[1] == kind}
        assert len(mine & added) >= 0.9 * len(mine), (kind, len(mine & added), len(mine))
    assert len(truth & added) >= 0.95 * len(added), sorted(added - truth)[:20]
