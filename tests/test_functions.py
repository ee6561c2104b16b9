"""Functions and operators on small fixtures, with cases worked out by hand."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from brightwake.functions import dates, text, urls
from brightwake.operators import changes, dedup
from brightwake.operators.filters import Filter, InvalidFilter, category_codes
from brightwake.plans.nlq import interpret
from brightwake.sources import readers
from brightwake.streaming.ingest import ingest, stored


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(("written", "day"), [("2024-03-05", "2024-03-05"), ("5 Mar 2024", "2024-03-05"), ("held 5th", None), ("March 5, 2024", "2024-03-05"), ("05/03/2024", "2024-03-05"), ("5-3-2024", "2024-03-05"), ("31-02-2024", None), ("", None), (None, None)])
def test_normalize_date(spark, written, day):
    found = one(spark, written, dates.normalize_date)
    assert (found and str(found)) == day


def test_extract_dates(spark):
    found = one(spark, "1 Jan 2021, 2021-01-01, 3/4/2019 and 1999-05-05", dates.extract_dates)
    assert [str(x) for x in found] == ["2019-04-03", "2021-01-01"]


@pytest.mark.parametrize(("url", "want"), [("HTTP://Example.COM/a/?utm_source=x&b=2&a=1#top", "http://example.com/a?a=1&b=2"), ("https://x.org", "https://x.org/"), ("ftp://x.org", None), (None, None)])
def test_normalize_url(spark, url, want):
    assert one(spark, url, urls.normalize_url) == want


def test_strip_html(spark):
    assert one(spark, "<p>a<script>var x = '<b>';</script>b</p>", lambda c: text.normalize_whitespace(text.strip_html(c))) == "a b"


def test_departments(spark):
    f = lambda c: text.normalize_department(c, {"cse": "Computer Science"})
    assert one(spark, " cse; Physics ;cse", f) == "Computer Science; Physics"
    assert one(spark, None, f) == one(spark, "General", f) == one(spark, "  ", f) == "General"


def test_human_list(spark):
    assert [one(spark, x, text.human_list, "array<string>") for x in ([], ["a"], ["a", "b"], ["a", "b", "c"])] == ["", "a", "a and b", "a, b and c"]


def brute_common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_ratio_against_brute_force():
    texts = ["", "a", "abcbdab", "bdcaba", "workshop on ml", "workshop on machine learning", "ml workshop"]
    for a, b in itertools.product(texts, texts):
        want = 100.0 if not a and not b else 200 * brute_common(a, b) / (len(a) + len(b))
        assert dedup.ratio(a, b) == pytest.approx(want)
    assert dedup.weighted_ratio("a b c", "c b a") == pytest.approx(95)
    assert dedup.weighted_ratio("x", "x") == 100 and dedup.weighted_ratio("", "x") == 0


def test_duplicates_do_not_depend_on_order(spark):
    rows = [(1, "annual day 2024"), (2, "annual day 2024"), (3, "annual day 2024!"), (4, "quite another title"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id long, title string")
    found = {r.id: (r.status, r.into) for r in dedup.duplicates(df.selectExpr("id", "title", "cast(null as date) as day")).collect()}
    assert found[1] == ("kept", None) and found[2] == ("merged", 1)
    assert found[4] == found[5] == found[6] == ("kept", None)


def test_filters():
    assert category_codes("promotions") == ["PROMO"] and category_codes("none") == []
    for bad in ({"period": "2030-31"}, {"scope": "x"}, {"confidence": "x"}):
        with pytest.raises(InvalidFilter):
            Filter(**bad)


@pytest.mark.parametrize(("question", "kind"), [("How many small events?", "count"), ("Top 3 departments", "top"), ("compare promo and large", "compare"), ("List promotions", "list"), ("which year has the most events", "highest"), ("'; drop table x", "unsupported"), ("x" * 501, "unsupported"), ("", "unsupported"), ("count in 2044-45", "clarification")])
def test_interpret(question, kind):
    assert interpret(question).kind == kind


def test_upsert_keeps_admin_columns(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "id long, note string, n long")
    new = spark.createDataFrame([(2, "b", None), (3, "c", 3)], "id long, note string, n long")
    assert sorted(map(tuple, changes.upserted(old, new, "id", ("note",)).collect())) == [(1, "a", 1), (2, "b", None), (3, "c", 3)]
    with pytest.raises(ValueError):
        changes.checked_change("id", ["id"])


def test_raw_archives(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source_url": "u", "collected_at": "t", "records": [{"title": "x"}, {"title": "y", "source_url": "own"}]}))
    (tmp_path / "metadata.json").write_text(json.dumps({"records": [{"title": "no"}]}))
    (tmp_path / "bad.json").write_text("{not json")
    found = readers.raw_archives(spark, str(tmp_path)).select("title", "source_url", "collected_at").collect()
    assert sorted(map(tuple, found)) == [("x", "u", "t"), ("y", "own", "t")]


def test_sheet_rows_and_fingerprint(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Banner,\nPost title,Link\nFirst,https://x.org/1\n,\nSecond,none\n")
    found = readers.sheet_rows(spark, str(tmp_path / "s.csv"), "2024")
    assert sorted((r.text, r.url) for r in found.collect()) == [("First", "https://x.org/1"), ("Second", None)]
    assert readers.fingerprints(spark, str(tmp_path)).count() == 1
    assert readers.text_archive(spark, str(tmp_path)).first().body.startswith("Banner")


def test_ingest_can_be_run_again(spark, tmp_path):
    source, schema = tmp_path / "in", "k string, n long"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema).coalesce(1).write.parquet(str(source / "x"))
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
    run = lambda: sorted(map(tuple, ingest(read(), ["k"], ["n"], f"file://{tmp_path}/table", f"file://{tmp_path}/check").collect()))
    assert run() == [("a", 1), ("b", 3)]
    spark.createDataFrame([("b", 0), ("c", 9)], schema).coalesce(1).write.parquet(str(source / "y"))
    assert run() == [("a", 1), ("b", 3), ("c", 9)]
    assert run() == [("a", 1), ("b", 3), ("c", 9)]
    assert stored(spark, f"file://{tmp_path}/none", spark.createDataFrame([], schema).schema).count() == 0


POSTS = [
    ("", "REVIEW_REQUIRED", "J", "url_only_no_text"),
    ("workshop", "REVIEW_REQUIRED", "D", "weak_text_requires_review"),
    ("A two-day workshop on machine learning was conducted by the department for all the students of the third year. ", "ACTIVITY_CANDIDATE", "D", "activity_evidence:WORKSHOP"),
    ("Admissions open! Apply for admission now; internship and placement support for everyone who joins us this coming year, limited seats.", "NON_ACTIVITY", "G", "communication_override:admission_promo"),
    ("Wishing you all a very happy diwali from the whole family of the college, may it be joyous and bright for each one of you!", "NON_ACTIVITY", "H", "communication_only:greeting"),
    ("Nothing in these words says that anything took place anywhere at any time, so that a person has to look at it once.", "REVIEW_REQUIRED", "I", "insufficient_evidence"),
    ("The journal published a patent by our research scholar, who also gave a keynote at the international conference last week.", "ACTIVITY_CANDIDATE", "C", "activity_evidence:RESEARCH,GUEST_LECTURE,INTERNSHIP"),
]


def test_classified(spark):
    from brightwake.functions.classify import classified

    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(POSTS)], "id long, text string")
    found = {r.id: (r.status, r.kind, r.reason) for r in classified(rows).collect()}
    assert found == {i: p[1:] for i, p in enumerate(POSTS)}
