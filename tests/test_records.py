"""Record functions, questions and logs on small cases."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from brightwake.functions import records
from brightwake.operators import audit
from brightwake.plans import nlq


def one(spark, text, column):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(column(F.col("t")).alias("x")).first().x


def test_unicode(spark):
    df = spark.createDataFrame([("ﬁne ² Ａ😀 ☕",), (None,), ("",)], "t string")
    want = [unicodedata.normalize("NFKC", "ﬁne ² Ａ ").rstrip() + " ", None, ""]
    assert [r.x for r in df.select(records.normalize_unicode("t").alias("x")).collect()] == want


def test_tables_of_untidy_html(spark):
    html = "<TABLE><thead><tr><th>Name<br></th><th>Date</th></tr></thead><tr class=x><td>A <b>b</b></td><td> 1 </td></tr><tr></tr></TABLE> x <table></table>"
    assert one(spark, html, records.tables_of) == [[["Name", "Date"], ["A b", "1"]], []]
    assert [tuple(r) for r in one(spark, html, records.table_records)] == [("A b", "1", None)]
    assert one(spark, "no table", records.table_records) == []


def test_headers_are_read_once(spark, data):
    from brightwake.plans.model import universe

    plan = records.table_records_query(universe(spark, data), spark)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("RLIKE") == len(records.SLOTS)
    html = "<table><tr><th>x</th></tr><tr><td>1</td></tr></table><table><tr><th>Event name</th><th>Title</th><th>Held on</th></tr><tr><td>a</td><td>b</td></tr></table>"
    assert [tuple(r) for r in one(spark, html, records.table_records)] == [("a", None, None)]


def test_years_and_titles(spark):
    assert one(spark, "AY 2021-22 or session: 2021-22", records.explicit_year) == "2021-22"
    assert one(spark, "AY 2021-22 or AY 2022-23", records.explicit_year) is None
    assert one(spark, "in 1998 and 1998, not 119983", records.single_year) == 1998
    assert one(spark, "The annual fair on 3 May 1998 was held", records.title_from_block) == "annual fair"
    assert one(spark, "1998-2000", records.normalize_period) is None


def test_phrases_and_ranges():
    assert nlq.event_phrase('Find "Blue Moon" now') == "blue moon"
    assert nlq.event_phrase("Show the Spring Music Fest of Large Events") == "spring music fest"
    assert nlq.interpret("count activities between 1998-99 and 1996-97").filters.from_year == 1996
    assert nlq.interpret("").kind == "unsupported"


def test_numbered_and_crawled(spark):
    rows = spark.range(200).select((F.col("id") * 7 % 1000).alias("k"))
    found = {r.k: r.n for r in audit.numbered(rows, "k", "n").collect()}
    assert [found[k] for k in sorted(found)] == list(range(1, 201))
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "page long, to long")
    seeds = spark.createDataFrame([(1,)], "page long")
    assert {r.page: r.depth for r in audit.crawled(links, seeds, 3).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
