"""URL and JSON functions as columns, and the queries over pages and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import query, tables

#: Query parameters that only track.
TRACKING = ("fbclid", "gclid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
_URL = r"(?i)^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment or tracking parameters, sorted query, no trailing slash; null unless http(s)."""
    group = lambda g: F.regexp_extract(url, _URL, g)
    path = F.regexp_replace(group(3), "/+$", "")
    kept = F.filter(F.split(group(4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    rest = F.array_join(F.sort_array(kept), "&")
    built = F.concat(F.lower(group(1)), F.lit("://"), F.lower(group(2)), F.when(path == "", "/").otherwise(path), F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest)))
    return F.when(url.rlike(_URL), built)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def url_key(url: Column) -> Column:
    """Without scheme, www and trailing slash."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://(www\.)?", ""), "/$", "")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)<a[^>]*href="([^"]*)"'), F.lit(1))


_TRACK = ", ".join(f"'{t}'" for t in TRACKING)
_PARTS = r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host,
  rtrim(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/') AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)"""


@query(
    "x01_normalize_url",
    f"""{_PARTS}, k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_TRACK}))) AS kept FROM p)
SELECT page_id, CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END END AS url FROM k""",
    base=False,
)
def normalize_url_query(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "pages").select("page_id", normalize_url(F.col("url")).alias("url"))


@query("x02_url_tests", f"{_PARTS} SELECT page_id, host LIKE '%.example.com' AS internal, path ILIKE '%.pdf' AS pdf FROM p", base=False)
def url_tests(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", _URL, 3)
    return tables(spark, d, "pages").select("page_id", host(F.col("url")).endswith(".example.com").alias("internal"), F.lower(path).endswith(".pdf").alias("pdf"))


@query("x03_discover_links", """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""", base=False)
def discover_links(spark: SparkSession, d: str) -> DataFrame:
    each = tables(spark, d, "pages").select("page_id", F.explode(links(F.col("html"))).alias("link"))
    return each.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("x04_relevant_pages", "SELECT page_id, regexp_matches(lower(url || ' ' || html), 'event|award|training|research|student') AS relevant FROM pages", base=False)
def relevant_pages(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "pages").select("page_id", F.lower(F.concat_ws(" ", "url", "html")).rlike("event|award|training|research|student").alias("relevant"))


@query("x05_url_key_groups", r"SELECT key, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '/$', '') AS key FROM pages) GROUP BY key", base=False)
def url_key_groups(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "pages").groupBy(url_key(F.col("url")).alias("key")).agg(F.count("*").alias("n"))


@query("x06_id_from_url", r"SELECT page_id, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS id FROM pages", base=False)
def id_from_url(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract("url", "/([0-9]+)", 1)
    return tables(spark, d, "pages").select("page_id", F.when(found != "", found).alias("id"))


@query("x07_json_load", "SELECT event_type, (props->>'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL", base=False)
def json_load(spark: SparkSession, d: str) -> DataFrame:
    """Bad JSON gives an empty object, and so a null."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return tables(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("x08_page_titles", r"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<p>')) AS n_paragraphs FROM pages", base=False)
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("html", F.lit("(?i)<p>"), F.lit(0))).cast("long")
    return tables(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), n.alias("n_paragraphs"))
