"""Rare languages are learned."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightwake.llm import langid, samples, toxicity


def test_no_language_is_left_out(spark):
    names = [f"l{i:03}" for i in range(240)]
    rows = [(3 * i + k, f"{chr(0x4E00 + i) * 3} {name}", name) for i, name in enumerate(names) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {r["lang"] for r in docs.where(~langid.held_out()).select("lang").distinct().collect()}
    assert len(known) > 200
    assert set(langid.train(docs).languages) == known


def test_repeated_rows_are_learned_from_once(spark, monkeypatch):
    docs = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, languages: seen.append((texts, languages)))
    monkeypatch.setattr(langid, "SAMPLE", 1_000_000)
    langid.train(docs, 1_000_000)
    langid.train(docs, 1_000_000, characters=5)
    assert seen == [(["the same text"], ["en"]), ([], [])]


def test_two_thousand_languages_are_all_learned(spark, monkeypatch):
    # 30 rows of each, with few draws a language.
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('w', id % 2000, ' text ', id) AS text", "concat('l', id % 2000) AS lang")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, languages: seen.append(languages))
    langid.train(docs)
    assert len(set(seen[0])) == 2000
    assert max(seen[0].count(x) for x in ("l0", "l1", "l1999")) <= langid.SAMPLE * langid.FULL_LANGUAGES // 2000 + 1


def test_a_text_above_the_bound_takes_nothing_from_the_others(spark, monkeypatch):
    rows = [(3 * i, "abc " * 20, ("en", "de")[i % 2]) for i in range(40)] + [(3 * i, "x" * 5000, "en") for i in range(100, 104)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~langid.held_out())
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, languages: seen.append((texts, languages)))
    langid.train(docs, characters=8000)
    texts, languages = seen[0]
    assert set(languages) == {"en", "de"}
    assert len(texts) == docs.where("length(text) < 4000").count()


def test_the_same_for_labels(spark, monkeypatch):
    rows = [(i, "abc " * 20) for i in range(60)] + [(100, "x" * 5000), (101, "y" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    toxicity.train(docs, labels, characters=8000)
    texts, toxic = seen[0]
    known = labels.where(~toxicity.held_out()).where("doc_id < 60").count()
    assert (len(texts), set(toxic)) == (known, {0, 1})


def test_fitting_passes_over_what_does_not_fit():
    assert samples.fitting([("aaaa", 1), ("b" * 9, 1), ("cc", 1), ("ddddd", 2)], 6) == [("aaaa", 1), ("cc", 1), ("ddddd", 2)]
