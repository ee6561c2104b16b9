"""Mentions, entities, listings and review groups on small cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from brightwake.operators import extraction, mentions, ranking
from brightwake.operators.pairing import weighted_ratio

NAMES = [("CS", ("computer science", "cs")), ("AI", ("applied computer science", "ai")), ("ME", ("mechanics",))]


def mentioned(text: str | None, names: list[tuple[str, tuple[str, ...]]]) -> list[dict]:
    """Places of each member's first term that occurs; places inside a longer one are none; without any, the most similar full name."""
    lower = (text or "").lower()
    if not lower.strip():
        return []
    spans = []
    for code, terms in names:
        term = next((t for t in terms if t and t in lower), None)
        at = lower.find(term) if term else -1
        while at >= 0:
            spans.append((at, -(at + len(term)), code, term))
            at = lower.find(term, at + 1)
    found, first, last = [], 0, 0  # of the span that ends last so far
    for start, minus_end, code, term in sorted(spans):
        end = -minus_end
        if not (end <= last and end - start < last - first):
            found.append({"code": code, "start": start, "term": term, "score": 100.0})
        if end > last:
            first, last = start, end
    if not found:
        score, code, term = max(((weighted_ratio(lower, terms[0]), code, terms[0]) for code, terms in names), key=lambda m: m[0], default=(0.0, "", ""))
        if score >= mentions.SIMILAR:
            found.append({"code": code, "start": None, "term": term, "score": score})
    return found


def frame(spark, names=NAMES):
    return spark.createDataFrame([(code, rank, term) for code, terms in names for rank, term in enumerate(terms)], "code string, rank int, term string")


def places(text):
    return [(m["code"], m["start"], m["score"]) for m in mentioned(text, NAMES)]


def test_mentions_keep_the_longest_place():
    assert places("Applied Computer Science and computer science") == [("AI", 0, 100.0), ("CS", 29, 100.0)]
    assert places("CS, and cs once") == [("CS", 0, 100.0), ("CS", 8, 100.0)]
    assert places("mechanics, AI") == [("ME", 0, 100.0), ("AI", 11, 100.0)]


def test_mentions_fall_back_to_similar_names():
    (code, start, score), = places("mechanicz")
    assert (code, start) == ("ME", None) and 80 <= score < 100
    assert places("nothing here") == places("") == places(None) == places("  ") == []


def test_places_agree_with_all_pairs_of_spans():
    names = [(t, (t,)) for t in ("a", "ab", "bc", "abc", "ca", "b")]
    for text in ("abcab", "aabbcca", "bcabcabcb", "cab"):
        spans = [(i, i + len(t), t) for t, _ in names for i in range(len(text)) if text.startswith(t, i)]
        want = sorted((s, t) for s, e, t in spans if not any(s2 <= s and e <= e2 and e2 - s2 > e - s for s2, e2, _ in spans))
        assert sorted((m["start"], m["code"]) for m in mentioned(text, names)) == want


def test_each_entity_once(spark):
    text = "It was held in the Mechanics. A talk by Dr. Ann Lee. Organised by CS. It was held in the Mechanics by mechanics and CS."
    found = extraction.entities(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), frame(spark)).collect()
    assert sorted(map(tuple, found)) == [(1, "ORG", "CS", 1.0), (1, "ORG", "ME", 1.0), (1, "PERSON", "Dr. Ann Lee", 0.85), (1, "VENUE", "Mechanics", 0.85)]


def test_listings(spark):
    html = '<div class="a event b"><p class="t"><a class="x" href="/one">One <b>two</b></a></p><i class="d">May 2</i></div><div class="events"><p class="t"><a href="/no">No</a></p></div>'
    rows = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(extraction.listed_items(F.col("h"), "event", "t", "d").alias("e")).collect()
    assert [tuple(e) for e in rows[0]["e"]] == [("One two", "/one", "May 2")]
    assert not rows[1]["e"] and rows[2]["e"] == []


def test_numbering_over_parts(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5000).alias("o"))
    found = ranking.numbered(rows, ["o"], "place", ("g",)).collect()
    for g in range(3):
        own = sorted((r["o"], r["place"]) for r in found if r["g"] == g)
        assert [p for _, p in own] == list(range(1, len(own) + 1))


def compared(spark, texts, names):
    names = sorted(names)
    records = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("*", "'x' AS code")
    got = sorted((r.id, r.code, -1 if r.start is None else r.start, r.term, round(r.score, 4)) for r in mentions.mentions(records, frame(spark, names)).collect())
    want = sorted((i, m["code"], -1 if m["start"] is None else m["start"], m["term"], round(m["score"], 4)) for i, t in enumerate(texts) for m in mentioned(t, names))
    assert got == want


def test_mentions_of_a_table_equal_those_of_each_text(spark, monkeypatch):
    rng = random.Random(6)
    words = ["applied", "computer", "science", "cs", "ai", "mechanics", "mechanicz", "of", "art", "party", "élan", "sciences"]
    names = [(f"D{i:02}", tuple(dict.fromkeys(" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 3))))) for i in range(25)]
    texts = [" ".join(rng.choices([*words, "Xyz", "QQ", "MECHANICAL"], k=rng.randint(0, 9))) for _ in range(150)] + [None, "", "   ", "mechnics artz", "zzzz", "word " * 400]
    compared(spark, texts, NAMES)
    compared(spark, texts, names)
    # Names in several blocks.
    monkeypatch.setattr(mentions, "BLOCK", 7)
    compared(spark, texts, names)
    assert mentions.mentions(spark.createDataFrame([(1, "x")], "id long, text string"), frame(spark).limit(0)).count() == 0


def test_records_are_read_once_and_repeated_ids_are_texts_of_their_own(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = [(1, "mechanicz"), (1, "art by ai"), (2, "It was held in the Hall. No names"), (3, None), (4, "mechanics and applied computer science")]
    records = spark.createDataFrame(texts, "id long, text string")
    found = extraction.entities(records.mapInArrow(seen, records.schema), frame(spark)).collect()
    assert read.value == len(texts)
    assert {(r.id, r.type, r.text) for r in found} == {(1, "ORG", "ME"), (1, "ORG", "AI"), (2, "VENUE", "Hall"), (4, "ORG", "ME"), (4, "ORG", "AI")}
    # The same from names in several blocks.
    monkeypatch.setattr(mentions, "BLOCK", 2)
    assert sorted(extraction.entities(records, frame(spark)).collect()) == sorted(found)


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).selectExpr("concat('N', id) AS code", "0 AS rank", "concat('unit ', id, ' of works') AS term")
    texts = [(i, f"The Unit {i * 37} of Works and unit {i} of works met.") for i in range(50)] + [(99, "unit 123456789 of works")]
    got = mentions.mentions(spark.createDataFrame(texts, "id long, text string"), names).collect()
    assert {(r.id, r.code) for r in got if r.start is not None} == {(i, f"N{k}") for i in range(50) for k in (i, 37 * i)}
    assert [(r.id, r.start) for r in got if r.start is None] == [(99, None)]


def test_baselines_read_the_records_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, ("rude words here" if i % 3 == 0 else "kind words there") + f" no {i}", int(i % 3 == 0), int(i % 2)) for i in range(120)] + [(500, None, 0, 0)]
    records = spark.createDataFrame(rows, "id long, text string, toxic int, quality int")
    held = {r.id for r in records.where("pmod(xxhash64(id, 42), 10) >= 7").select("id").collect()}
    found = {(r.model, r.label): r for r in extraction.baselines(records.mapInArrow(seen, records.schema), ("toxic", "quality"), features=1 << 10, rounds=5).collect()}
    assert read.value == len(rows)
    assert {m for m, _ in found} == {"logistic", "svc", "bayes"} and len(found) == 6
    for (_, label), r in found.items():
        assert r.tp + r.fn == sum(1 for x in rows if x[0] in held and x[2 if label == "toxic" else 3])
    assert all((found[(m, "toxic")].fp, found[(m, "toxic")].fn) == (0, 0) for m in ("logistic", "svc"))
