"""Audits of stored records: seven of them, all metrics and capped examples from one read of the records.

Each record says which metrics it counts for: one bit for each metric without a value, and
the few values of the others. That narrow table is counted by bits and by each of the values,
so that no row is made for a metric of a record. The examples come from a window whose limit
Spark applies before the shuffle, so a task sends on no more than the cap of each metric,
however many records have it.

Nulls and white space count as missing. A record without an id counts, and is no example.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..plans.model import CATEGORIES, FIRST_YEAR, GENERAL, LAST_YEAR, PERIODS, PUBLIC_YEARS, clamped_period, query, tables, universe
from ..sources.store import stored_table
from .merging import stripped

#: How many examples a metric has, where it has any.
EXAMPLES = {
    ("period", "early_without_evidence"): 3, ("category", "several"): 5, ("department", "several"): 8, ("date", "future"): 3, ("date", "inconsistent"): 5, ("date", "invalid"): 3,
    ("description", "empty"): 5, ("description", "short"): 5, ("description", "repeats_title"): 5, ("source", "no_trace"): 5,
}
#: Metrics without a value, each with its bit.
FLAGS = (
    ("period", "early_without_evidence"), ("category", "several"), ("category", "none"), ("department", "general"), ("department", "several"), ("stakeholder", "missing"),
    ("date", "invalid"), ("date", "future"), ("date", "inconsistent"), ("date", "only_year"), ("date", "several_years"),
    ("description", "empty"), ("description", "short"), ("description", "repeats_title"), ("description", "with_outcome"), ("source", "with_sources"), ("source", "with_url"), ("source", "no_trace"),
)
MISSING = "(missing)"
SHORT = 20
#: Counts of a public category from which it is an outlier.
HIGH, LOW = 200, 5


def blank(text: Column) -> Column:
    return stripped(text) == ""


def years_in(*texts: Column) -> Column:
    """Distinct years of four digits in texts, not part of a longer number."""
    return F.array_distinct(F.regexp_extract_all(F.concat_ws(" | ", *texts), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)))


def department_parts(shown: Column) -> Column:
    return F.filter(F.split(shown, r"\s*;\s*"), lambda p: (p != "") & (p != GENERAL))


def is_general(shown: Column) -> Column:
    return (shown == "") | (shown == GENERAL)


def marks(facts: DataFrame, categories: DataFrame, sources: DataFrame, today: Column, stakeholders: Sequence[str]) -> DataFrame:
    """(id, marks) of each record: its period, stored year, department, stakeholder, day, categories, kinds of sources and the bits of ``FLAGS``.

    Records have id, title, description, day (text), day_text, evidence, academic_year,
    period, department_display, stakeholder_display, outcome and url; categories (id,
    code), sources (id, url, kind).
    """
    codes = categories.groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    # Kinds of sources are few; their numbers are counted here, so that no list grows with a record's sources.
    traced = sources.groupBy("id", "kind").agg(F.count("*").alias("n")).groupBy("id").agg(F.collect_list(F.struct("kind", "n")).alias("kinds"))
    rows = facts.join(codes, "id", "left").join(traced, "id", "left")

    # What several conditions need is a column of its own, computed once.
    rows = rows.select(
        "id", "period", F.col("academic_year").alias("year"), "codes", "kinds", stripped(F.col("department_display")).alias("shown"),
        F.when(blank(F.col("stakeholder_display")), MISSING).otherwise(F.col("stakeholder_display")).alias("who"),
        F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("date").alias("day"), blank(F.col("day")).alias("undated"),
        years_in("day_text").alias("said"), years_in("evidence").alias("proved"),
        F.lower(stripped(F.col("description"))).alias("text"), F.lower(stripped(F.col("title"))).alias("title"),
        blank(F.col("outcome")).alias("no_outcome"), blank(F.col("url")).alias("no_url"),
    )
    rows = rows.withColumns({"told": F.size(F.array_union("said", "proved")), "said": F.size("said"), "proved": F.size("proved"), "held": F.coalesce(F.size("codes"), F.lit(0)), "length": F.length("text")})
    day, text, title, length, untraced = F.col("day"), F.col("text"), F.col("title"), F.col("length"), F.col("kinds").isNull()
    when = {
        ("period", "early_without_evidence"): (F.col("period") == PERIODS[5]) & F.col("undated") & (F.col("told") == 0),
        ("category", "several"): F.col("held") > 1,
        ("category", "none"): F.col("held") == 0,
        ("department", "general"): is_general(F.col("shown")),
        ("department", "several"): F.size(department_parts(F.col("shown"))) > 1,
        ("stakeholder", "missing"): F.col("who") == MISSING,
        ("date", "invalid"): ~F.col("undated") & day.isNull(),
        ("date", "future"): day > today,
        ("date", "inconsistent"): F.col("year").isin(*PUBLIC_YEARS) & (clamped_period(F.year(day)) != F.col("year")),
        ("date", "only_year"): day.isNull() & (F.col("said") > 0) & (F.col("proved") == 0),
        ("date", "several_years"): F.col("told") > 1,
        ("description", "empty"): length == 0,
        ("description", "short"): length.between(1, SHORT - 1),
        ("description", "repeats_title"): (length > 0) & (title != "") & (length <= F.length(title)) & F.contains(title, text),
        ("description", "with_outcome"): ~F.col("no_outcome"),
        ("source", "with_sources"): ~untraced,
        ("source", "with_url"): ~F.col("no_url"),
        ("source", "no_trace"): untraced & F.col("no_url"),
    }
    bits = reduce(Column.__add__, (F.when(when[f], 1 << i).otherwise(0) for i, f in enumerate(FLAGS)))
    return rows.select("id", F.struct("period", "year", "shown", "who", "day", "codes", "kinds", bits.alias("bits")).alias("marks"))


def _counted(held: DataFrame, stakeholders: Sequence[str]) -> DataFrame:
    """(audit, metric, value, n) of marked records; what only a value decides is asked once a value."""

    def row(audit: str, metric: Column | str, value: Column, when: Column | None = None) -> Column:
        told = F.struct(F.lit(audit).alias("audit"), (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), value.alias("value"))
        return told if when is None else F.when(when, told)

    def each(df: DataFrame, *rows: Column) -> DataFrame:
        return df.select(F.explode(F.array_compact(F.array(*rows))).alias("r"), "n").select("r.*", "n")

    by = lambda *fields: held.select(*(f"marks.{f}" for f in fields)).groupBy(*fields).agg(F.count("*").alias("n"))
    flags = held.select("marks.bits").agg(*(F.count_if(_has(f)).alias(f"f{i}") for i, f in enumerate(FLAGS)))
    flags = flags.select(F.explode(F.array(*(F.struct(F.lit(a).alias("audit"), F.lit(m).alias("metric"), F.lit("").alias("value"), F.col(f"f{i}").alias("n")) for i, (a, m) in enumerate(FLAGS)))).alias("r")).select("r.*").where("n > 0")
    year, shown, who = F.col("year"), F.col("shown"), F.col("who")
    periods = each(by("period", "year"), row("period", "resolved", F.col("period")), row("period", "stored", F.coalesce(year, F.lit(MISSING))), row("period", "outside", year, ~year.isin(*PUBLIC_YEARS)))
    spelled = by("shown")
    departments = each(spelled, row("category", "scope", F.when(is_general(shown), "general").otherwise("departmental")), row("department", "spelling", shown))
    parts = each(spelled.select(F.explode(department_parts(shown)).alias("part"), "n"), row("department", "part", F.col("part")))
    known = reduce(Column.__or__, (F.contains(who, F.lit(s)) for s in stakeholders), F.lit(False))
    people = each(by("who"), row("stakeholder", "value", who), row("stakeholder", "outside", who, ~known))
    code = F.col("code")
    coded = held.select("marks.codes", "marks.bits").select("codes", _has(("department", "general")).alias("general")).groupBy("codes", "general").agg(F.count("*").alias("n")).select(F.explode("codes").alias("code"), "general", "n")
    public = F.when(code.isin(*CATEGORIES), "public").otherwise("legacy")
    categories = each(coded, row("category", public, code), row("category", "general_scope", code, F.col("general")))
    kinds = held.select(F.explode("marks.kinds").alias("k")).groupBy("k.kind").agg(F.sum("k.n").alias("n"))
    sources = each(kinds.where(~blank(F.col("kind"))), row("source", "kind", F.col("kind")))
    return reduce(DataFrame.unionByName, (flags, periods, departments, parts, people, categories, sources)).groupBy("audit", "metric", "value").agg(F.sum("n").alias("n"))


def _has(flag: tuple[str, str]) -> Column:
    return F.col("bits").bitwiseAND(1 << FLAGS.index(flag)) != 0


def _bounds(held: DataFrame) -> DataFrame:
    """One row: an id for each metric with examples, up to which there are as many ids as it needs; null if too few parts of the ids have one.

    The smallest ids of 64 parts differ, so the third of them has two smaller ones.
    """
    lowest = held.select("id", "marks.bits").groupBy(F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(*(F.min(F.when(_has(f), F.col("id"))).alias(f"m{i}") for i, f in enumerate(EXAMPLES)))
    return lowest.agg(*(F.try_element_at(F.array_sort(F.collect_list(f"m{i}")), F.lit(k)).alias(f"b{i}") for i, k in enumerate(EXAMPLES.values())))


def audits(facts: DataFrame, categories: DataFrame, sources: DataFrame, today: Column, stakeholders: Sequence[str]) -> DataFrame:
    """(audit, metric, value, n, examples) of all seven audits; ``examples`` are the smallest ids, as many as ``EXAMPLES`` has, else null.

    Metrics that no record counts for are zero where they have no value. The range of
    dates, the number of distinct normalised URLs and outlying categories are rows too.
    """
    held = stored_table(marks(facts, categories, sources, today, stakeholders), "audit-marks")
    counted = stored_table(_counted(held, stakeholders), "audit-counts")
    known = held.where("id is not null").select("id", "marks.bits").crossJoin(F.broadcast(_bounds(held)))
    shown = F.array_compact(F.array(*(F.when(_has(f) & (F.col(f"b{i}").isNull() | (F.col("id") <= F.col(f"b{i}"))), F.struct(F.lit(f[0]).alias("audit"), F.lit(f[1]).alias("metric"), F.lit(k).alias("cap"))) for i, (f, k) in enumerate(EXAMPLES.items()))))
    place = F.row_number().over(Window.partitionBy("audit", "metric").orderBy("id"))
    # The constant bound is what Spark pushes below the shuffle; the metric's own one follows.
    first = known.select("id", F.explode(shown).alias("m")).select("id", "m.*").withColumn("place", place)
    first = first.where(F.col("place") <= max(EXAMPLES.values())).where("place <= cap")
    examples = first.groupBy("audit", "metric").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    found = counted.join(F.broadcast(examples), ["audit", "metric"], "left")  # one row a metric
    return found.select("audit", "metric", "value", "n", "examples").unionByName(_further(held, sources, counted))


def _further(held: DataFrame, sources: DataFrame, counted: DataFrame) -> DataFrame:
    spark, none = held.sparkSession, F.lit(None).cast("array<bigint>").alias("examples")
    row = lambda df, audit, metric, value, n: df.select(F.lit(audit).alias("audit"), F.lit(metric).alias("metric"), value.alias("value"), n.cast("long").alias("n"), none)
    day = F.col("marks.day")
    span = held.agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(day).alias("n"))
    # Many sources share a URL, so each spelling is normalised once. Without its number in use, Spark would drop that grouping and normalise each row.
    spelled = sources.groupBy("url").agg(F.count("*").alias("n")).where("n > 0")
    urls = spelled.select(F.when(~blank(F.col("url")), F.struct(normalize_url(F.col("url")))).alias("u")).distinct().agg(F.count("u").alias("n"))
    public = counted.where("audit = 'category' and metric = 'public'")
    out = row(span, "date", "first", F.col("first").cast("string"), F.col("n")).unionByName(row(span, "date", "last", F.col("last").cast("string"), F.col("n")))
    out = out.unionByName(row(urls, "source", "distinct_urls", F.lit(""), F.col("n")))
    outlier = F.when(F.col("n") >= HIGH, "high_outlier").when(F.col("n") < LOW, "low_outlier")
    out = out.unionByName(public.where(outlier.isNotNull()).select("audit", outlier.alias("metric"), "value", "n", none))
    every = spark.createDataFrame([(*f, "") for f in FLAGS] + [("category", "public", c) for c in CATEGORIES], "audit string, metric string, value string")
    zero = every.join(counted, ["audit", "metric", "value"], "left_anti")
    return out.unionByName(zero.select("audit", "metric", "value", F.lit(0).cast("long").alias("n"), none))


_TODAY, _KNOWN = "1998-06-01", ("FURNITURE", "BUILDING")
_STORED = f"""
, rec AS (SELECT id, title, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'short' WHEN 2 THEN lower(title) ELSE description END AS description,
    CASE WHEN id % 9 = 0 THEN 'someday' WHEN id % 10 <> 0 THEN strftime(day, '%Y-%m-%d') END AS day, CASE WHEN id % 9 <> 0 AND id % 10 <> 0 THEN day END AS date,
    CASE WHEN id % 4 = 0 THEN cy END AS said, CASE WHEN id % 8 = 0 THEN cy + 1 END AS told, CASE WHEN id % 13 = 0 THEN '1990-91' ELSE academic_year END AS academic_year, period,
    CASE WHEN id % 17 = 0 THEN '' ELSE coalesce(department_display, '') END AS department, coalesce(stakeholder_display, '{MISSING}') AS who, CASE WHEN id % 3 = 0 THEN 'won' END AS outcome, url FROM act
), cats AS (SELECT id, code FROM cat WHERE id % 19 <> 0 UNION ALL SELECT id, 'OLD' FROM act WHERE id % 23 = 0 AND id % 19 <> 0
), srcs AS (SELECT l_orderkey AS id, 'https://example.org/p/' || l_partkey AS url, l_returnflag AS kind FROM lineitem WHERE l_orderkey % 7 <> 0
), ncat AS (SELECT r.id, count(DISTINCT code) AS n FROM rec r LEFT JOIN cats USING (id) GROUP BY r.id
), part AS (SELECT id, p FROM (SELECT id, unnest(string_split(department, '; ')) AS p FROM rec) WHERE p NOT IN ('', '{GENERAL}')
), flag AS (
  SELECT 'period' AS audit, 'resolved' AS metric, period AS value, id FROM rec
  UNION ALL SELECT 'period', 'stored', coalesce(academic_year, '{MISSING}'), id FROM rec
  UNION ALL SELECT 'period', 'outside', academic_year, id FROM rec WHERE academic_year NOT IN (SELECT year FROM years)
  UNION ALL SELECT 'period', 'early_without_evidence', '', id FROM rec WHERE period = '{PERIODS[5]}' AND day IS NULL AND said IS NULL AND told IS NULL
  UNION ALL SELECT 'category', CASE WHEN code IN (SELECT code FROM categories) THEN 'public' ELSE 'legacy' END, code, id FROM cats
  UNION ALL SELECT 'category', 'several', '', id FROM ncat WHERE n > 1
  UNION ALL SELECT 'category', 'none', '', id FROM ncat WHERE n = 0
  UNION ALL SELECT 'category', 'scope', CASE WHEN department IN ('', '{GENERAL}') THEN 'general' ELSE 'departmental' END, id FROM rec
  UNION ALL SELECT 'category', 'general_scope', code, id FROM cats JOIN rec USING (id) WHERE department IN ('', '{GENERAL}')
  UNION ALL SELECT 'department', 'general', '', id FROM rec WHERE department IN ('', '{GENERAL}')
  UNION ALL SELECT 'department', 'part', p, id FROM part
  UNION ALL SELECT 'department', 'several', '', id FROM part GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'department', 'spelling', department, id FROM rec
  UNION ALL SELECT 'stakeholder', 'value', who, id FROM rec
  UNION ALL SELECT 'stakeholder', 'missing', '', id FROM rec WHERE who = '{MISSING}'
  UNION ALL SELECT 'stakeholder', 'outside', who, id FROM rec WHERE {" AND ".join(f"NOT contains(who, '{k}')" for k in _KNOWN)}
  UNION ALL SELECT 'date', 'invalid', '', id FROM rec WHERE day IS NOT NULL AND date IS NULL
  UNION ALL SELECT 'date', 'future', '', id FROM rec WHERE date > DATE '{_TODAY}'
  UNION ALL SELECT 'date', 'inconsistent', '', id FROM rec WHERE academic_year IN (SELECT year FROM years) AND CASE WHEN year(date) < {FIRST_YEAR} THEN '{PERIODS[5]}' WHEN year(date) >= {LAST_YEAR} THEN '{PERIODS[4]}' ELSE year(date) || '-' || right('0' || ((year(date) + 1) % 100), 2) END <> academic_year
  UNION ALL SELECT 'date', 'only_year', '', id FROM rec WHERE date IS NULL AND said IS NOT NULL AND told IS NULL
  UNION ALL SELECT 'date', 'several_years', '', id FROM rec WHERE said <> told
  UNION ALL SELECT 'description', 'empty', '', id FROM rec WHERE description = ''
  UNION ALL SELECT 'description', 'short', '', id FROM rec WHERE length(description) BETWEEN 1 AND {SHORT - 1}
  UNION ALL SELECT 'description', 'repeats_title', '', id FROM rec WHERE description <> '' AND length(description) <= length(title) AND contains(lower(title), lower(description))
  UNION ALL SELECT 'description', 'with_outcome', '', id FROM rec WHERE outcome IS NOT NULL
  UNION ALL SELECT 'source', 'with_sources', '', id FROM rec WHERE id IN (SELECT id FROM srcs)
  UNION ALL SELECT 'source', 'with_url', '', id FROM rec WHERE url IS NOT NULL
  UNION ALL SELECT 'source', 'no_trace', '', id FROM rec WHERE url IS NULL AND id NOT IN (SELECT id FROM srcs)
  UNION ALL SELECT 'source', 'kind', kind, id FROM srcs WHERE id IN (SELECT id FROM rec)
), caps AS (SELECT unnest({[a for a, _ in EXAMPLES]}) AS audit, unnest({[m for _, m in EXAMPLES]}) AS metric, unnest({list(EXAMPLES.values())}) AS cap
), ex AS (SELECT audit, metric, list(id ORDER BY id) AS examples FROM (SELECT audit, metric, id, row_number() OVER (PARTITION BY audit, metric ORDER BY id) AS p FROM flag) JOIN caps USING (audit, metric) WHERE p <= cap GROUP BY audit, metric
), counted AS (SELECT audit, metric, value, count(*) AS n FROM flag GROUP BY ALL
), zero AS (SELECT unnest(['period', 'category', 'category', 'department', 'department', 'stakeholder', 'date', 'date', 'date', 'date', 'date', 'description', 'description', 'description', 'description', 'source', 'source', 'source']) AS audit,
    unnest(['early_without_evidence', 'several', 'none', 'general', 'several', 'missing', 'invalid', 'future', 'inconsistent', 'only_year', 'several_years', 'empty', 'short', 'repeats_title', 'with_outcome', 'with_sources', 'with_url', 'no_trace']) AS metric, '' AS value
  UNION ALL SELECT 'category', 'public', code FROM categories)
"""


def audited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Activities as stored records, their categories and sources, with faults by the remainder of the id."""
    u, id_ = universe(spark, d), F.col("id")
    year = F.year("day").cast("string")
    text = F.when(id_ % 6 == 0, " ").when(id_ % 6 == 1, "short").when(id_ % 6 == 2, F.lower("title")).otherwise(F.col("description"))
    day = F.when(id_ % 9 == 0, "someday").when(id_ % 10 != 0, F.date_format("day", "yyyy-MM-dd"))
    facts = u.activities.select(
        "id", "title", text.alias("description"), day.alias("day"), F.when(id_ % 4 == 0, F.concat(F.lit("held in "), year)).alias("day_text"), F.when(id_ % 8 == 0, F.concat(F.lit("planned for "), (F.year("day") + 1).cast("string"), F.lit(", no. 120001"))).alias("evidence"),
        F.when(id_ % 13 == 0, "1990-91").otherwise(F.col("academic_year")).alias("academic_year"), "period", F.when(id_ % 17 == 0, " ").otherwise(F.col("department_display")).alias("department_display"), "stakeholder_display", F.when(id_ % 3 == 0, "won").alias("outcome"), "url",
    )
    old = u.activities.where("id % 23 = 0").select("id", F.lit("OLD").alias("code"))
    categories = u.categories.select("id", "code").unionByName(old).where("id % 19 <> 0")
    part = F.col("l_partkey").cast("string")
    url = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("HTTPS://Example.org/p/"), part, F.lit("/"))).otherwise(F.concat(F.lit("https://example.org/p/"), part))
    sources = tables(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), url.alias("url"), F.col("l_returnflag").alias("kind")).where("id % 7 <> 0")
    return facts, categories, sources


@query(
    "a45_seven_audits",
    _STORED
    + f"""SELECT audit, metric, value, n, examples FROM counted LEFT JOIN ex USING (audit, metric)
UNION ALL SELECT 'date', 'first', min(date)::DATE::VARCHAR, count(date), NULL FROM rec UNION ALL SELECT 'date', 'last', max(date)::DATE::VARCHAR, count(date), NULL FROM rec
UNION ALL SELECT 'source', 'distinct_urls', '', count(DISTINCT url), NULL FROM srcs
UNION ALL SELECT 'category', CASE WHEN n >= {HIGH} THEN 'high_outlier' ELSE 'low_outlier' END, value, n, NULL FROM counted WHERE audit = 'category' AND metric = 'public' AND (n >= {HIGH} OR n < {LOW})
UNION ALL SELECT audit, metric, value, 0, NULL FROM zero ANTI JOIN counted USING (audit, metric, value)""",
)
def seven_audits(spark: SparkSession, d: str) -> DataFrame:
    """Period, category, department, stakeholder, date, description and source audits of all activities."""
    return audits(*audited(spark, d), F.lit(_TODAY).cast("date"), _KNOWN)
