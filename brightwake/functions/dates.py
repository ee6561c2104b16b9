"""Dates, academic years and periods as columns, and the queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import FIRST_YEAR, LAST_YEAR, PERIODS, Universe, august_year, clamped_period, june_year, modelled

_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
#: Patterns of a day, in order of preference; the groups' places give year, month and day.
DATE_FORMS = (
    (r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", (1, 2, 3)),
    (rf"(?i)\b(\d{{1,2}})\s+({_MONTHS})[a-z]*\s*,?\s*(\d{{4}})\b", (3, 2, 1)),
    (rf"(?i)\b({_MONTHS})[a-z]*\s+(\d{{1,2}})\s*,?\s*(\d{{4}})\b", (3, 1, 2)),
    (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", (3, 2, 1)),
    (r"\b(\d{1,2})-(\d{1,2})-(\d{4})\b", (3, 2, 1)),
)


def _month(name: Column) -> Column:
    """Number of a month given by name or number."""
    names = F.create_map(*(F.lit(x) for i, m in enumerate(_MONTHS.split("|")) for x in (m, i + 1)))
    return F.coalesce(name.try_cast("int"), F.try_element_at(names, F.lower(F.left(name, F.lit(3)))))


def _day_of(text: Column, form: tuple[str, tuple[int, int, int]]) -> Column:
    pattern, (y, m, d) = form
    group = lambda g: F.regexp_extract(text, pattern, g)
    written = F.concat_ws("-", group(y), F.lpad(_month(group(m)).cast("string"), 2, "0"), F.lpad(group(d), 2, "0"))
    return F.when(text.rlike(pattern), F.try_to_date(written, "yyyy-MM-dd"))


def normalize_date(text: Column) -> Column:
    """First form that gives a valid day, as a date; null if none does."""
    return F.coalesce(*(_day_of(text, form) for form in DATE_FORMS))


def extract_dates(text: Column, first: int = 2000, last: int = 2030) -> Column:
    """All days of all forms, distinct and sorted, with years from ``first`` to ``last``."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), _reader((p, places))) for p, places in DATE_FORMS]
    days = F.filter(F.concat(*found), lambda d: F.year(d).between(first, last))
    return F.sort_array(F.array_distinct(days))


def _reader(form: tuple[str, tuple[int, int, int]]):
    return lambda m: _day_of(m, form)


def report_date(day: Column) -> Column:
    return F.date_format(day, "d MMMM yyyy")


_SHAPES_SQL = """CASE id % 6 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN day(day) || ' ' || strftime(day, '%b') || ' ' || year(day)
WHEN 2 THEN day(day) || ' ' || strftime(day, '%B') || ', ' || year(day) WHEN 3 THEN strftime(day, '%b') || ' ' || day(day) || ', ' || year(day)
WHEN 4 THEN day(day) || '/' || month(day) || '/' || year(day) ELSE '31-02-' || year(day) END"""


def _shaped(u: Universe) -> DataFrame:
    """The activities' days written in six ways, the last of which is no day."""
    day, kind = F.col("day"), F.col("id") % 6
    text = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "d MMM yyyy")).when(kind == 2, F.date_format(day, "d MMMM, yyyy")).when(kind == 3, F.date_format(day, "MMM d, yyyy")).when(kind == 4, F.date_format(day, "d/M/yyyy")).otherwise(F.concat(F.lit("31-02-"), F.year(day).cast("string")))
    return u.activities.select("id", "day", text.alias("written"))


@modelled("d01_normalize_date", f"SELECT id, {_SHAPES_SQL} AS written, CASE WHEN id % 6 < 5 THEN day END AS parsed FROM act")
def normalize_date_query(u: Universe, spark: SparkSession) -> DataFrame:
    return _shaped(u).select("id", "written", normalize_date(F.col("written")).alias("parsed"))


@modelled("d02_extract_dates", "SELECT id, CASE WHEN year(day) >= 1996 THEN list_sort(list_distinct([day, (day + INTERVAL 40 DAY)::DATE])) WHEN year(day + INTERVAL 40 DAY) >= 1996 THEN [(day + INTERVAL 40 DAY)::DATE] ELSE []::DATE[] END AS days FROM act WHERE id % 2 = 0 UNION ALL SELECT id, [] FROM act WHERE id % 2 = 1")
def extract_dates_query(u: Universe, spark: SparkSession) -> DataFrame:
    """Days named in a sentence that gives them in two forms; odd rows name none."""
    later = F.date_add("day", 40)
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Held on "), F.date_format("day", "d MMMM yyyy"), F.lit(" and again on "), F.date_format(later, "yyyy-MM-dd"), F.lit("; see "), F.date_format("day", "d/M/yyyy"), F.lit("."))).otherwise(F.lit("No day is named."))
    return u.activities.select("id", extract_dates(text, 1996, 2030).alias("days"))


@modelled("d04_june_year", "SELECT id, (y4 || '-' || right('0' || ((y4 + 1) % 100), 2)) AS year FROM (SELECT id, year(day - INTERVAL 5 MONTH) AS y4 FROM act)")
def june_year_query(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id", june_year(F.col("day")).alias("year"))


@modelled("d05_august_year", "SELECT id, academic_year AS year FROM act")
def august_year_query(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id", august_year(F.col("day")).alias("year"))


@modelled("d06_calendar_year_id", "SELECT id, place::INT AS year_id FROM act LEFT JOIN years ON left(year, 4)::INT = year(day)")
def calendar_year_id(u: Universe, spark: SparkSession) -> DataFrame:
    """Place of the master year that begins in the day's calendar year."""
    y = F.year("day")
    return u.activities.select("id", F.when(y.between(FIRST_YEAR, LAST_YEAR), y - FIRST_YEAR).alias("year_id"))


@modelled("d07_clamped_period", f"SELECT id, CASE WHEN year(day) < {FIRST_YEAR} THEN '{PERIODS[5]}' WHEN year(day) >= {LAST_YEAR} THEN '{PERIODS[4]}' ELSE year(day) || '-' || right('0' || ((year(day) + 1) % 100), 2) END AS period FROM act")
def clamped_period_query(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id", clamped_period(F.year("day")).alias("period"))


@modelled("d08_resolved_period", "SELECT id, period FROM act")
def resolved_period_query(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id", "period")


@modelled(
    "d11_year_reason",
    """SELECT id, CASE WHEN academic_year IS NOT NULL THEN academic_year WHEN id % 2 = 0 THEN period END AS year,
CASE WHEN academic_year IS NOT NULL THEN 'stored' WHEN id % 2 = 0 THEN 'date' WHEN url IS NOT NULL THEN 'source_only' ELSE 'unknown' END AS reason FROM act""",
)
def year_reason(u: Universe, spark: SparkSession) -> DataFrame:
    """Year and why it was chosen: stored, from the date where the date is trusted, or none."""
    trusted = F.col("id") % 2 == 0
    year = F.coalesce("academic_year", F.when(trusted, F.col("period")))
    reason = F.when(F.col("academic_year").isNotNull(), "stored").when(trusted, "date").when(F.col("url").isNotNull(), "source_only").otherwise("unknown")
    return u.activities.select("id", year.alias("year"), reason.alias("reason"))


@modelled("d14_report_date", "SELECT id, day(day) || ' ' || strftime(day, '%B') || ' ' || year(day) AS shown FROM act")
def report_date_query(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id", report_date(F.col("day")).alias("shown"))


@modelled("d17_date_audit", "SELECT count(*) FILTER (day IS NULL) AS missing, count(*) FILTER (day > DATE '2001-01-01') AS late, count(*) FILTER (academic_year IS NOT NULL AND left(academic_year, 4)::INT <> year(day)) AS other_year FROM act")
def date_audit(u: Universe, spark: SparkSession) -> DataFrame:
    start = F.substring("academic_year", 1, 4).try_cast("int")
    return u.activities.agg(F.count_if(F.col("day").isNull()).alias("missing"), F.count_if(F.col("day") > F.lit("2001-01-01").cast("date")).alias("late"), F.count_if(start != F.year("day")).alias("other_year"))
