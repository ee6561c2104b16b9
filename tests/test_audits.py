"""The seven audits on cases, on no records, and the plan of their examples."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from brightwake.operators.audits import audits, marks

FACT = "id long, title string, description string, day string, day_text string, evidence string, academic_year string, period string, department_display string, stakeholder_display string, outcome string, url string, n int, marks string"


def today():
    return F.lit("2000-01-01").cast("date")


def inputs(spark, facts, categories, sources):
    return spark.createDataFrame(facts, FACT), spark.createDataFrame(categories, "id long, code string, n int"), spark.createDataFrame(sources, "id long, url string, kind string")


def told(df):
    return {(r["audit"], r["metric"], r["value"]): (r["n"], r["examples"]) for r in df.collect()}


def test_cases(spark):
    facts = [
        (1, "Open Day", "open day", "1998-02-30", "in 1998", None, "1996-97", "1996-97", "A; B;C", "Students", None, None, 7, "m"),
        (2, "Open Day", " \n ", "2001-01-01", "in 1998 and 1999", "31998", "1996-97", "1999-00", "General", " ", "won", " ", 7, "m"),
        (3, None, "A long enough description", None, None, None, None, "Before 1996", None, None, " ", "https://x.org", 7, "m"),
        (4, "", "", "", "no. 120001", "", "1850-51", "Before 1996", " ", "Guests", None, None, 7, None),
    ]
    found = told(audits(*inputs(spark, facts, [(1, "LARGE", 1), (1, "LARGE", 2), (1, "OLD", 1), (2, "PROMO", 1), (3, None, 1)], [(1, "HTTPS://X.org/a/", "web"), (1, "https://x.org/a", None), (2, None, None), (9, "https://x.org/b", "web")]), today(), ("Students",)))
    want = {
        ("period", "resolved", "Before 1996"): (2, None), ("period", "stored", "(missing)"): (1, None), ("period", "outside", "1850-51"): (1, None), ("period", "early_without_evidence", ""): (2, [3, 4]),
        ("category", "public", "LARGE"): (1, None), ("category", "public", "SMALL"): (0, None), ("category", "legacy", "OLD"): (1, None), ("category", "several", ""): (1, [1]), ("category", "none", ""): (2, None),
        ("category", "scope", "general"): (3, None), ("category", "general_scope", "PROMO"): (1, None), ("category", "low_outlier", "LARGE"): (1, None),
        ("department", "part", "B"): (1, None), ("department", "several", ""): (1, [1]), ("department", "general", ""): (3, None), ("department", "spelling", "A; B;C"): (1, None),
        ("stakeholder", "missing", ""): (2, None), ("stakeholder", "outside", "(missing)"): (2, None), ("stakeholder", "outside", "Guests"): (1, None), ("stakeholder", "value", "Students"): (1, None),
        ("date", "invalid", ""): (1, [1]), ("date", "future", ""): (1, [2]), ("date", "inconsistent", ""): (1, [2]), ("date", "only_year", ""): (1, None), ("date", "several_years", ""): (1, None), ("date", "first", "2001-01-01"): (1, None),
        ("description", "empty", ""): (2, [2, 4]), ("description", "short", ""): (1, [1]), ("description", "repeats_title", ""): (1, [1]), ("description", "with_outcome", ""): (1, None),
        ("source", "with_sources", ""): (2, None), ("source", "with_url", ""): (1, None), ("source", "no_trace", ""): (1, [4]), ("source", "kind", "web"): (1, None), ("source", "distinct_urls", ""): (2, None),
    }
    assert {k: found.get(k) for k in want} == want


def test_no_records(spark):
    found = told(audits(*inputs(spark, [], [], []), today(), ()))
    assert found and all(n == 0 and examples is None for n, examples in found.values())


def test_examples_are_the_smallest_ids_and_cut_before_the_shuffle(spark):
    facts = spark.range(3000, numPartitions=6).select("id", *(F.lit(None).cast("string").alias(c) for c in ("title", "description", "day", "day_text", "evidence", "academic_year")), F.lit("Before 1996").alias("period"), *(F.lit(None).cast("string").alias(c) for c in ("department_display", "stakeholder_display", "outcome", "url")))
    _, categories, sources = inputs(spark, [], [], [])
    result = audits(facts, categories, sources, today(), ())
    found = told(result)
    assert found[("description", "empty", "")] == (3000, [0, 1, 2, 3, 4]) and found[("period", "early_without_evidence", "")] == (3000, [0, 1, 2])
    assert marks(facts, categories, sources, today(), ()).columns == ["id", "marks"]
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        result.explain()
    assert "WindowGroupLimit" in shown.getvalue()


def test_facts_are_read_once_and_bounds_lose_no_example(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    facts, categories, sources = inputs(spark, [(i // 2, "Title", "short" if i > 900 else None, None, None, None, None, "Before 1996", None, None, None, None, 1, "m") for i in range(1000)] + [(None, None, None, None, None, None, None, "Before 1996", None, None, None, None, 1, "m")], [], [(0, "u", "web"), (0, " ", " "), (0, "https://x.org", "web"), (1, "u", "")])
    found = told(audits(facts.mapInArrow(seen, FACT), categories, sources, today(), ()))
    assert read.value == 1001
    assert found[("description", "empty", "")] == (902, [0, 0, 1, 1, 2]) and found[("description", "short", "")] == (99, [450, 451, 451, 452, 452])
    assert found[("source", "with_sources", "")] == (4, None) and found[("source", "kind", "web")] == (4, None) and found[("source", "distinct_urls", "")] == (2, None)
