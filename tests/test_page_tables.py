"""Grids of cells, and the records of each type of page, on pages written by hand."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from brightwake.functions import page_tables


def cells(html):
    return [(parent, rows) for _, parent, rows in page_tables.grids(html)]


def test_spans_fill_every_place_they_cover():
    html = "<table><tr><th rowspan=2>a<th colspan='2'>b</tr><tr><td>c<td>d</tr><tr><td rowspan=3>e<td>f</table>"
    assert cells(html) == [(None, [["a", "b", "b"], ["a", "c", "d"], ["e", "f"]])]
    assert cells("<table><tr><td rowspan=2 colspan=2>x<td>y<tr><td>z</table>") == [(None, [["x", "x", "y"], ["x", "x", "z"]])]


def test_tables_within_tables_are_tables_of_their_own():
    html = "<table><tr><td>one<table><tr><td>two<table><tr><td>three</table>more</table>last<td>x</table>"
    assert cells(html) == [(None, [["one last", "x"]]), (0, [["two more"]]), (1, [["three"]])]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, []),
        ("", []),
        ("no table <td>x</td>", []),
        ("<table><tr><td>a<tr><td><tr><td>b", [(None, [["a"], ["b"]])]),
        ("<TABLE class=x><TR><TD>a<br>b &amp; <b>c</b><script>'<td>no'</script><!-- <td>no --></TABLE>", [(None, [["a b & c"]])]),
        ("<table><td>menu</table> Breadcrumb <table><td>x</table> Quick Links <table><td>foot</table>", [(None, [["x"]])]),
        ("<table><td colspan=9999999 rowspan=0>x</table>", [(None, [["x"] * 1000])]),
    ],
)
def test_odd_tables(html, want):
    assert cells(html) == want


def table(heading, *rows):
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + line(heading, "th") + "".join(line(r, "td") for r in rows) + "</table>"


def records(spark, *pages):
    rows = [(i, f"https://x.org/departments/physics/{kind}", html) for i, (kind, html) in enumerate(pages)]
    found = page_tables.page_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return sorted((r.page_id, r.title, r.day and r.day.isoformat(), r.academic_year, r.category, tuple(r.people), r.details) for r in found)


def test_each_type_of_page(spark):
    mou = table(("S.No", "Industry", "Year of signing"), ("1", "Acme Works", "2022"), ("2", "Old Co", "2015"), ("3", "-", "2022"), ("4", "No Year Ltd", ""))
    awards = "<table><tr><td>2022-23</td></tr><tr><th>Award</th><th>Name of the student</th><th>Event</th></tr><tr><td>First prize</td><td>Ann</td><td>Quiz</td></tr><tr><td>First  Prize</td><td>Bob</td><td>quiz</td></tr><tr><td>2023-24</td></tr><tr><td>First prize</td><td>Cy</td><td>Quiz</td></tr><tr><td>Nil</td><td>Dee</td><td>Quiz</td></tr></table>"
    patents = table(("S.No", "Title", "Inventor", "Filed"), ("1", "A pump", "Dr. X", "12 March 2023"), ("2", "A valve", "Dr. Y", "2021-2022"), ("3", "An old one", "Dr. Z", "12 March 2003"))
    sponsored = table(("Title", "Funding agency", "Amount", "Duration"), ("Deep sea", "Council", "5", "2022-23"), ("na", "Council", "5", "2022-23"))
    consultancy = table(("Nature of work", "Company", "Cost"), ("Testing of beams", "Acme", "10"))
    outreach = table(("Outreach activity", "Place", "Date"), ("Tree planting", "The park", "2022-09-01"), ("2023-24",), ("Blood camp", "Hall", ""))
    events = table(("S.No", "Event name", "Date"), ("1", "A workshop on sails", "5 January 2024"), ("2", "A Workshop, on sails", "5 January 2024"), ("3", "Undated talk", ""))
    counted = table(("Event name", "Date", "Number of events"), ("A workshop", "5 January 2024", "3"))
    clubs = table(("Name of the event", "Date", "Details"), ("Dance night", "7 July 2022", "Ms. D"), ("Undated", "", "x"))
    societies = table(("Name of professional society", "Activities"), ("Society of Sails", "a seminar in 2022-23"), ("Empty Society", "Nil"))
    interface = table(("Industry", "Theme of MoU"), ("Sail Makers", "Cloth 2024"))
    got = records(
        spark, ("mou", mou), ("achievements", awards), ("patents/", patents), ("research?x=1", sponsored), ("consultancy-projects", consultancy), ("outreach-activities", outreach),
        ("past-events", events), ("past-events", counted), ("associations", clubs), ("professional-societies", societies), ("industry-interface", interface), ("publications", patents),
    )
    assert got == [
        (0, "MoU with Acme Works", None, "2022-23", "INDUSTRY", (), None),
        (0, "MoU with No Year Ltd", None, None, "INDUSTRY", (), None),
        (1, "First prize", None, "2022-23", "ACHIEVEMENT", ("Ann", "Bob"), "Quiz"),
        (1, "First prize", None, "2023-24", "ACHIEVEMENT", ("Cy",), "Quiz"),
        (2, "A pump", "2023-03-12", "2022-23", "RESEARCH", (), "Dr. X"),
        (2, "A valve", None, "2021-22", "RESEARCH", (), "Dr. Y"),
        (3, "Deep sea", None, "2022-23", "RESEARCH", (), "Council | 5 | 2022-23"),
        (4, "Testing of beams", None, None, "RESEARCH", (), "Acme | 10"),
        (5, "Blood camp", None, "2023-24", "OUTREACH", (), "Hall"),
        (5, "Tree planting", "2022-09-01", "2022-23", "OUTREACH", (), "The park"),
        (6, "A workshop on sails", "2024-01-05", "2023-24", "WORKSHOP", (), None),
        (8, "Dance night", "2022-07-07", "2021-22", "CULTURAL", (), "Ms. D"),
        (9, "Society of Sails", None, "2022-23", "SEMINAR", (), "a seminar in 2022-23"),
        (10, "MoU with Sail Makers", None, "2024-25", "INDUSTRY", (), "Cloth 2024"),
    ]


def test_planted_titles_keep_cut_references(spark):
    raw = {10: "a &amp;&amp", 20: "a &amp;&amp;", 30: "&quot;x&quot;  &lt; y", 40: "2 < 3 &#39;", 50: "&amp;quot;", 60: "AT&T &copy"}
    pages = spark.createDataFrame([(i, "u", f"<title>{t}</title>") for i, t in raw.items()], "page_id long, url string, html string")
    got = {r.page_id: r.cells[1] for r in page_tables.page_grids(page_tables.planted_pages(pages)).where('`table` = 0 and `row` = 1').collect()}
    assert got == {i: " ".join(t.replace("&quot;", '"').replace("&amp;", "&").split()) for i, t in raw.items()}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "https://x.org/patents", None), (None, "https://x.org/patents", "<table><tr><td>x"), (3, "https://x.org/patents", table(("a", "b"), ("c", "d")))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit(1))
    assert page_tables.page_records(pages).count() == 0
    assert page_tables.page_grids(pages).count() == 3
    assert page_tables.page_records(pages.limit(0)).count() == 0


def test_slots_and_spans(spark):
    row = spark.range(1).select(page_tables.slots_of(F.array(*map(F.lit, ("S.No", "Name of the faculty", "Title", "Title of award", "Date")))).alias("s"), page_tables.slots_of(F.array(F.lit("Title"))).alias("one")).first()
    assert row.s == {"s_no": 0, "person": 1, "title": 2, "date": 4} and row.one is None
    texts = {"in 2022-23": "2022-23", "2022–2023 and": "2022-23", "2022/23": "2022-23", "2019-20": None, "2022-24": None, "none": None}
    frame = spark.createDataFrame(list(texts.items()), "t string, w string")
    assert all(r.got == r.w for r in frame.select("*", page_tables.span_named(F.col("t")).alias("got")).collect())
    days = spark.createDataFrame([(date(2022, 7, 31),), (date(2022, 8, 1),), (date(2001, 1, 1),)], "d date")
    assert [r[0] for r in days.select(page_tables.year_of(F.col("d"))).collect()] == ["2021-22", "2022-23", None]
