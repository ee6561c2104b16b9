"""Main text of pages against the article of each page, and on pages written by hand."""

from __future__ import annotations

import html as std
import re
import time

import pytest

from brightwake.llm import html

LONG = "A first paragraph with quite a lot of words, that goes on and on until it is long enough."
MORE = "And the last paragraph that has enough words too, I would say, to be counted as a text."


def test_articles_of_the_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    found = {r.page_id: r for r in html.extracted(pages).collect()}
    assert len(found) == pages.count()
    for row in pages.collect():
        article = re.search(r"<article>(.*)</article>", row.html, re.S).group(1)
        blocks = [" ".join(std.unescape(re.sub("<br>|<b>", "", x)).split()) for x in re.split("</?p>|</?h1>", article)]
        want = "\n".join(b for b in blocks if b)
        got = found[row.page_id]
        assert (got.url, got.text, got.n_chars) == (row.url, want, len(want))


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>x", 1), (3, "v", f"<p>{LONG}", 1), (3, "v", f"<p>{LONG}", 1), (4, "w", f"<article>{'ab ' * 300_000}", 1)]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 0), (2, 0), (3, len(LONG)), (3, len(LONG)), (4, 899_999)]
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div id=header><a href=/>Site</a></div><ul class=topnav><li><a>Home</a><li><a>News</a></ul><h1>Head</h1><p>{LONG}<p>Yes.<p>{MORE}<div class=related><p>{LONG}</div>", ["Head", LONG, "Yes.", MORE]),
        (f"<table><tr><td><a>Home</a><td><a>About</a></tr></table><p>{LONG}</p><p>Short.</p><p>{MORE}</p><p><a>Older</a> | <a>Newer</a></p>", [LONG, "Short.", MORE]),
        (f"<div class='cookie-notice'>{LONG}</div><div>{LONG}<br>{MORE}</div><div id=comments>{LONG}</div>", [f"{LONG} {MORE}"]),
        ("<header><h1>Site</h1></header><main><h1>Head</h1><p>Text.</p><aside>no</aside><p>More &lt;b&gt; &#39;x&#39;</p><section class=comments><article>No, a reader said.</article></section></main><footer>f</footer>", ["Head", "Text.", "More <b> 'x'"]),
        ("<form id=pageForm><div class=nav>x</div><article><header><h1>H</h1><p>by</p></header><p>One<br>two</p><article><p>comment</p></article><div class=share>Tweet</div><p>Three</article></form>", ["H", "One two", "Three"]),
        ('<article>a<script>if (a<b) "</p>"</script><style>p{}</style>b <!-- c --> d<b>e</b></article><script>x', ["ab de"]),
        (f"<body class='has-sidebar'><p style='display: none'>{LONG}</p><span class=ad>buy</span><p>x < y &amp; {LONG}", [f"x < y & {LONG}"]),
        ("<article><ul><li>one<li>two<ul><li>three</ul><li><p>four<p>five</ul><table><tr><td>a<td>b</table>", ["one", "two", "three", "four", "five", "a", "b"]),
        ("<article>abc <b>def", ["abc def"]),
        ("<nav><a>only links</a></nav>", []),
    ],
)
def test_pages_by_hand(page, want):
    assert html.main_lines(page) == want


def test_surges_are_windows_at_or_above_the_threshold():
    weights = [0, 50, 0, 60, 0, 0, 0, 0, 95, 0]
    assert html.surges(weights, 90) == [(1, 3), (8, 8)]
    assert html.surges(weights, 1) == [(1, 3), (8, 8)]
    assert html.surges([], 1) == []


@pytest.mark.parametrize("part", ['<a "', "<li><div>", "<span>", "<p>", "</b>", "<script>", "<!--", "<", "<ul><li>", "<div class=ad>", "<td>", "<textarea>"])
def test_time_is_linear_in_the_page(part):
    began = time.process_time()
    html.main_lines(part * 50_000)
    assert time.process_time() - began < 4
