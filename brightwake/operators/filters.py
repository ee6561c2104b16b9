"""Filters as data: a :class:`Filter` becomes one predicate and a few semi-joins."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import CATEGORIES, DEFAULT_STAKEHOLDER, DEPARTMENTAL, GENERAL, PERIODS, PUBLIC_NAMES, Universe, modelled
from .aggregates import parts

SEARCHED = ("title", "description", "department_display", "stakeholder_display", "period", "status", "url")


class InvalidFilter(ValueError):
    """A filter value that no data could have."""


@dataclass(frozen=True)
class Filter:
    """What a list or dashboard can be narrowed by; None leaves a field open."""

    period: str | None = None
    category: str | None = None
    department: str | None = None
    stakeholder: str | None = None
    scope: str | None = None
    status: str | None = None
    confidence: str | None = None
    from_year: int | None = None
    to_year: int | None = None
    from_day: date | None = None
    to_day: date | None = None
    search: str | None = None

    def __post_init__(self) -> None:
        if self.period is not None and self.period not in PERIODS:
            raise InvalidFilter(f"unknown period {self.period}")
        if self.scope not in (None, "general", "departmental"):
            raise InvalidFilter(f"unknown scope {self.scope}")
        if self.confidence not in (None, "low", "medium", "high"):
            raise InvalidFilter(f"unknown confidence {self.confidence}")
        if self.from_day and self.to_day and self.from_day > self.to_day:
            raise InvalidFilter("the range of days is empty")


def category_codes(value: str) -> list[str]:
    """Stored codes of a code or public name; none for an unknown value."""
    return [c for c in CATEGORIES if value.lower() in (c.lower(), PUBLIC_NAMES[c].lower())]


def confidence_band(band: str) -> Column:
    """The bands low and medium share the score 4."""
    return {"low": F.col("score") <= 4, "medium": F.col("score").between(4, 7), "high": F.col("score") >= 8}[band]


def matches_search(text: str, columns: tuple[str, ...] = SEARCHED) -> Column:
    """Case-insensitive substring in any of the columns; % and _ stay wildcards."""
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return found


def predicate(f: Filter) -> Column:
    """The part of a filter that looks at the fact alone."""
    held = F.lit(True)
    if f.period:
        held &= F.col("period") == f.period
    if f.department:
        held &= F.coalesce(F.array_contains(parts(F.col("department_display")), f.department), F.lit(False))
    if f.status and f.status != "ALL":
        held &= F.col("status") == f.status
    if f.confidence:
        held &= confidence_band(f.confidence)
    start = F.substring("academic_year", 1, 4).try_cast("int")
    if f.from_year is not None:
        held &= start >= f.from_year
    if f.to_year is not None:
        held &= start <= f.to_year
    if f.from_day:
        held &= F.col("day") >= F.lit(f.from_day)
    if f.to_day:
        held &= F.col("day") <= F.lit(f.to_day)
    if f.search:
        held &= matches_search(f.search)
    return held


def narrowed(u: Universe, f: Filter) -> DataFrame:
    """Activities that pass the filter."""
    rows = u.activities.where(predicate(f))
    if f.category:
        rows = rows.join(u.categories.where(F.col("code").isin(category_codes(f.category) or [""])), "id", "left_semi")
    if f.stakeholder:
        rows = rows.join(u.stakeholders.where(F.col("code") == f.stakeholder), "id", "left_semi")
    if f.scope:
        rows = rows.join(u.departments.where(F.col("code") != GENERAL), "id", "left_anti" if f.scope == "general" else "left_semi")
    return rows


@modelled("p01_public_projection", "SELECT id, title, day, period, coalesce(department_display, 'General') AS department, coalesce(stakeholder_display, 'Students') AS stakeholder, (SELECT string_agg(code, ';' ORDER BY code) FROM cat WHERE cat.id = act.id) AS categories FROM act")
def public_projection(u: Universe, spark: SparkSession) -> DataFrame:
    codes = u.categories.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("code")), ";").alias("categories"))
    shown = u.activities.join(codes, "id", "left")
    return shown.select("id", "title", "day", "period", F.coalesce("department_display", F.lit(GENERAL)).alias("department"), F.coalesce("stakeholder_display", F.lit(DEFAULT_STAKEHOLDER)).alias("stakeholder"), "categories")


@modelled("p02_hydrate", "SELECT id, list(code ORDER BY code) AS codes, max(CASE WHEN is_primary THEN code END) AS primary_code FROM cat GROUP BY id")
def hydrate(u: Universe, spark: SparkSession) -> DataFrame:
    return u.categories.groupBy("id").agg(F.sort_array(F.collect_set("code")).alias("codes"), F.max(F.when(F.col("is_primary"), F.col("code"))).alias("primary_code"))


_NAMES = ", ".join(f"('{c}', '{PUBLIC_NAMES[c]}', {i})" for i, c in enumerate(CATEGORIES))


@modelled(
    "p03_dimension_fields",
    f""", names AS (SELECT * FROM (VALUES {_NAMES}) AS t(code, name, place)) SELECT a.id, string_agg(CASE WHEN department_display = 'General' OR n.code IN {DEPARTMENTAL} THEN name END, '; ' ORDER BY place) AS shown
FROM act a LEFT JOIN cat ON cat.id = a.id LEFT JOIN names n ON n.code = cat.code GROUP BY a.id""",
)
def dimension_fields(u: Universe, spark: SparkSession) -> DataFrame:
    """Public names in master order: all for General, the departmental ones otherwise; null if none."""
    codes = u.categories.groupBy("id").agg(F.collect_set("code").alias("codes"))
    rows = u.activities.select("id", (F.col("department_display") == GENERAL).alias("general")).join(codes, "id", "left")
    names = [F.when(F.array_contains("codes", c) & (F.col("general") | F.lit(c in DEPARTMENTAL)), F.lit(PUBLIC_NAMES[c])) for c in CATEGORIES]
    listed = F.array_join(F.array_compact(F.array(*names)), "; ")
    return rows.select("id", F.when(listed != "", listed).alias("shown"))


@modelled("p05_point_lookup", "SELECT id, title, day, period FROM act WHERE id = 4242")
def point_lookup(u: Universe, spark: SparkSession, id_: int = 4242) -> DataFrame:
    return u.activities.where(F.col("id") == id_).select("id", "title", "day", "period")


@modelled(
    "p06_composite_filter",
    """SELECT id, day FROM act WHERE period = '1998-99' AND list_contains(string_split(department_display, '; '), 'NATION_7') AND id IN (SELECT id FROM cat WHERE code = 'LARGE')
AND id IN (SELECT id FROM stk WHERE code = 'BUILDING') AND day BETWEEN DATE '1998-09-01' AND DATE '1999-04-30'""",
)
def composite_filter(u: Universe, spark: SparkSession) -> DataFrame:
    f = Filter(period="1998-99", department="NATION_7", category="Large Events", stakeholder="BUILDING", from_day=date(1998, 9, 1), to_day=date(1999, 4, 30))
    return narrowed(u, f).select("id", "day")


@modelled("p07_reportable_filter", "SELECT id, score FROM act WHERE status = 'REPORTABLE' AND score BETWEEN 4 AND 7 AND review_status = 'APPROVED' AND id NOT IN (SELECT id FROM dep WHERE code <> 'General')")
def reportable_filter(u: Universe, spark: SparkSession) -> DataFrame:
    return narrowed(u, Filter(status="REPORTABLE", confidence="medium", scope="general")).where("review_status = 'APPROVED'").select("id", "score")


@modelled("p08_confidence_bands", "SELECT 'low' AS band, count(*) AS n FROM act WHERE score <= 4 UNION ALL SELECT 'medium', count(*) FROM act WHERE score BETWEEN 4 AND 7 UNION ALL SELECT 'high', count(*) FROM act WHERE score >= 8")
def confidence_bands(u: Universe, spark: SparkSession) -> DataFrame:
    counts = u.activities.agg(*(F.count_if(confidence_band(b)).alias(b) for b in ("low", "medium", "high")))
    return counts.unpivot([], ["low", "medium", "high"], "band", "n")


@modelled("p09_year_range", "SELECT academic_year, count(*) AS n FROM act WHERE substr(academic_year, 1, 4)::INT BETWEEN 1997 AND 1999 GROUP BY 1")
def year_range(u: Universe, spark: SparkSession) -> DataFrame:
    return narrowed(u, Filter(from_year=1997, to_year=1999)).groupBy("academic_year").agg(F.count("*").alias("n"))


@modelled("p10_category_resolution", "SELECT count(DISTINCT id) FILTER (code = 'PROMO') AS by_name, 0::BIGINT AS unknown FROM cat")
def category_resolution(u: Universe, spark: SparkSession) -> DataFrame:
    known = narrowed(u, Filter(category="promotions")).agg(F.count("*").alias("by_name"))
    return known.crossJoin(narrowed(u, Filter(category="no such")).agg(F.count("*").alias("unknown")))  # one row by one row


@modelled("p11_default_stakeholder", "SELECT id FROM act WHERE coalesce(stakeholder_display, 'Students') = 'Students'")
def default_stakeholder(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.where(F.coalesce("stakeholder_display", F.lit(DEFAULT_STAKEHOLDER)) == DEFAULT_STAKEHOLDER).select("id")


@modelled("p12_search", "SELECT id FROM act WHERE concat_ws(chr(1), title, description, department_display, stakeholder_display, period, status, url) ILIKE '%high order for b%'")
def search(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.where(matches_search("HIGH order for b")).select("id")


@modelled("p13_search_page", "SELECT id, title FROM act WHERE title ILIKE '%low%' AND period = '1999-00' ORDER BY day DESC, id LIMIT 50")
def search_page(u: Universe, spark: SparkSession) -> DataFrame:
    return narrowed(u, Filter(period="1999-00")).where(matches_search("low", ("title",))).orderBy(F.desc("day"), "id").limit(50).select("id", "title")


@modelled("p14_department_part", "SELECT id FROM act WHERE list_contains(string_split(department_display, '; '), 'NATION_12')")
def department_part(u: Universe, spark: SparkSession) -> DataFrame:
    return narrowed(u, Filter(department="NATION_12")).select("id")


@modelled("p15_scope", "SELECT 'general' AS scope, count(*) AS n FROM act WHERE id NOT IN (SELECT id FROM dep WHERE code <> 'General') UNION ALL SELECT 'departmental', count(*) FROM act WHERE id IN (SELECT id FROM dep WHERE code <> 'General')")
def scope(u: Universe, spark: SparkSession) -> DataFrame:
    each = [narrowed(u, Filter(scope=s)).agg(F.lit(s).alias("scope"), F.count("*").alias("n")) for s in ("general", "departmental")]
    return each[0].unionByName(each[1])


@modelled("p16_not_approved", "SELECT id FROM act WHERE review_status IS DISTINCT FROM 'APPROVED'")
def not_approved(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.where(~F.col("review_status").eqNullSafe("APPROVED")).select("id")


@modelled("p17_review_queue", "SELECT id, status, review_status FROM act WHERE status = 'REVIEW_REQUIRED' AND (review_status = 'REJECTED' OR score = 0 OR title LIKE '%URGENT%')")
def review_queue(u: Universe, spark: SparkSession) -> DataFrame:
    why = (F.col("review_status") == "REJECTED") | (F.col("score") == 0) | F.col("title").contains("URGENT")
    return u.activities.where((F.col("status") == "REVIEW_REQUIRED") & why).select("id", "status", "review_status")


@modelled(
    "p18_satisfies",
    """SELECT act.id FROM act JOIN (SELECT id, list(code) AS codes FROM cat GROUP BY id) c USING (id) WHERE period IN ('1996-97', '1997-98') AND list_contains(string_split(department_display, '; '), 'NATION_5')
AND list_contains(codes, 'SMALL') AND lower(coalesce(stakeholder_display, 'Students')) LIKE '%build%'""",
)
def satisfies(u: Universe, spark: SparkSession) -> DataFrame:
    codes = u.categories.groupBy("id").agg(F.collect_set("code").alias("codes"))
    rows = narrowed(u, Filter(department="NATION_5")).where(F.col("period").isin("1996-97", "1997-98")).join(codes, "id")
    shown = F.lower(F.coalesce("stakeholder_display", F.lit(DEFAULT_STAKEHOLDER)))
    return rows.where(F.array_contains("codes", "SMALL") & shown.contains("build")).select("id")


@modelled(
    "p21_completeness",
    "SELECT * FROM (SELECT 'url' AS field, round(count(url) / count(*), 4) AS share FROM act UNION ALL SELECT 'academic_year', round(count(academic_year) / count(*), 4) FROM act UNION ALL SELECT 'stakeholder_display', round(count(stakeholder_display) / count(*), 4) FROM act UNION ALL SELECT 'review_status', round(count(review_status) / count(*), 4) FROM act)",
)
def completeness(u: Universe, spark: SparkSession) -> DataFrame:
    fields = ["url", "academic_year", "stakeholder_display", "review_status"]
    shares = u.activities.agg(*(F.coalesce(F.round(F.try_divide(F.count(c), F.count("*")), 4), F.lit(0.0)).alias(c) for c in fields))
    return shares.unpivot([], fields, "field", "share")


@modelled("p22_allow_list", "SELECT id, title, period FROM act")
def allow_list(u: Universe, spark: SparkSession, keys: tuple[str, ...] = ("id", "title", "period", "secret")) -> DataFrame:
    return u.activities.select(*(k for k in keys if k in u.activities.columns))
