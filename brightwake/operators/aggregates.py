"""Aggregates over the fact and its bridges; each states what it counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import CATEGORIES, DEPARTMENTAL, GENERAL, GENERAL_MEMBER, PERIODS, PUBLIC_NAMES, PUBLIC_YEARS, Universe, master, modelled

n_distinct = F.countDistinct


def _zero_filled(dimension: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    filled = dimension.join(counted, key, "left")
    return filled.select(*dimension.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in counted.columns if c != key))


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, PUBLIC_NAMES[c], i) for i, c in enumerate(CATEGORIES)], "code string, name string, place int")


def parts(display: Column) -> Column:
    """Members of a display string: split, trimmed, without blanks."""
    return F.filter(F.transform(F.split(display, ";"), lambda p: F.trim(p)), lambda p: p != "")


@modelled("a01_yearly_counts", "SELECT year, place::INT AS place, count(id) AS n FROM years LEFT JOIN act ON academic_year = year GROUP BY ALL")
def yearly_counts(u: Universe, spark: SparkSession) -> DataFrame:
    """Activities of each public year by the stored year, zeros kept."""
    counted = u.activities.groupBy(F.col("academic_year").alias("year")).agg(F.count("*").alias("n"))
    return _zero_filled(master(spark, PUBLIC_YEARS, "year"), counted, "year")


@modelled("a02_period_breakdown", "SELECT p.period, place::INT AS place, count(id) AS n FROM periods p LEFT JOIN act a ON a.period = p.period GROUP BY ALL")
def period_breakdown(u: Universe, spark: SparkSession) -> DataFrame:
    """Activities of each resolved period; sums to all."""
    return _zero_filled(master(spark, PERIODS, "period"), u.activities.groupBy("period").agg(F.count("*").alias("n")), "period")


@modelled("a03_yearly_counts_admin", "SELECT year, count(id) AS n, count(CASE WHEN review_status = 'APPROVED' THEN 1 END) AS n_verified FROM years LEFT JOIN act ON academic_year = year GROUP BY year")
def yearly_counts_admin(u: Universe, spark: SparkSession) -> DataFrame:
    counted = u.activities.groupBy(F.col("academic_year").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("review_status") == "APPROVED").alias("n_verified"))
    return _zero_filled(master(spark, PUBLIC_YEARS, "year").drop("place"), counted, "year")


@modelled(
    "a04_overview_admin",
    """SELECT count(*) AS total, count(CASE WHEN review_status = 'APPROVED' THEN 1 END) AS verified, count(url) AS with_url, count(DISTINCT url) AS sources,
  min(day) AS first_day, max(day) AS last_day, count(DISTINCT period) AS periods, (SELECT count(*) FROM cat) AS category_links,
  (SELECT count(*) FROM dep) AS department_links, (SELECT count(*) FROM stk) AS stakeholder_links FROM act""",
)
def overview_admin(u: Universe, spark: SparkSession) -> DataFrame:
    a = u.activities.agg(F.count("*").alias("total"), F.count_if(F.col("review_status") == "APPROVED").alias("verified"), F.count("url").alias("with_url"), n_distinct("url").alias("sources"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), n_distinct("period").alias("periods"))
    for name, bridge in (("category", u.categories), ("department", u.departments), ("stakeholder", u.stakeholders)):
        a = a.crossJoin(bridge.agg(F.count("*").alias(f"{name}_links")))  # one row by one row
    return a


@modelled("a05_category_summary", "SELECT c.code, c.name, count(DISTINCT cat.id) AS n FROM categories c LEFT JOIN cat ON cat.code = c.code GROUP BY c.code, c.name")
def category_summary(u: Universe, spark: SparkSession) -> DataFrame:
    """Distinct activities of each public category, zeros kept."""
    return _zero_filled(_names(spark).drop("place"), u.categories.groupBy("code").agg(n_distinct("id").alias("n")), "code")


@modelled(
    "a06_department_counts",
    """SELECT m.department, count(p.part) AS n FROM masters m LEFT JOIN (SELECT trim(unnest(string_split(department_display, ';'))) AS part FROM act) p ON p.part = m.department GROUP BY m.department""",
)
def department_counts(u: Universe, spark: SparkSession) -> DataFrame:
    """Display parts equal to a master department; General and unknown parts are not counted."""
    listed = u.members.where(F.col("code") != GENERAL_MEMBER).select(F.col("code").alias("department"))
    counted = u.activities.select(F.explode(parts(F.col("department_display"))).alias("department")).groupBy("department").agg(F.count("*").alias("n"))
    return _zero_filled(listed, counted, "department")


@modelled(
    "a07_general_category_summary",
    """SELECT c.code, count(DISTINCT CASE WHEN department_display = 'General' THEN a.id END) AS n FROM categories c LEFT JOIN cat ON cat.code = c.code LEFT JOIN act a ON a.id = cat.id GROUP BY c.code""",
)
def general_category_summary(u: Universe, spark: SparkSession) -> DataFrame:
    only = u.activities.select("id", F.col("department_display") == GENERAL)
    joined = u.categories.join(only.toDF("id", "general"), "id", "left")
    return _zero_filled(_names(spark).select("code"), joined.groupBy("code").agg(n_distinct(F.when(F.col("general"), F.col("id"))).alias("n")), "code")


@modelled(
    "a08_departmental_category_summary",
    f"""SELECT department, code, n, (sum(n) OVER (PARTITION BY department))::BIGINT AS total FROM (
  SELECT p.department, cat.code, count(*) AS n FROM (SELECT id, trim(unnest(string_split(department_display, ';'))) AS department FROM act) p JOIN cat ON cat.id = p.id
  WHERE p.department <> 'General' AND cat.code IN {DEPARTMENTAL} GROUP BY ALL)""",
)
def departmental_category_summary(u: Universe, spark: SparkSession) -> DataFrame:
    """Department by departmental category, without zeros, with each department's total."""
    each = u.activities.select("id", F.explode(parts(F.col("department_display"))).alias("department")).where(F.col("department") != GENERAL)
    counted = each.join(u.categories.where(F.col("code").isin(*DEPARTMENTAL)), "id").groupBy("department", "code").agg(F.count("*").alias("n"))
    totals = counted.groupBy("department").agg(F.sum("n").alias("total"))
    return counted.join(totals, "department").select("department", "code", "n", "total")


@modelled("a09_year_category_breakdown", "SELECT academic_year AS year, code, count(DISTINCT act.id) AS n FROM act JOIN cat USING (id) WHERE academic_year IS NOT NULL GROUP BY ALL")
def year_category_breakdown(u: Universe, spark: SparkSession) -> DataFrame:
    joined = u.activities.where("academic_year is not null").join(u.categories, "id")
    return joined.groupBy(F.col("academic_year").alias("year"), "code").agg(n_distinct("id").alias("n"))


@modelled(
    "a10_general_analytics",
    """, g AS (SELECT * FROM act WHERE department_display = 'General')
SELECT 'total' AS series, '' AS key, count(*) AS n FROM g UNION ALL SELECT 'periods_covered', '', count(DISTINCT period) FROM g
UNION ALL SELECT 'period', period, count(*) FROM g GROUP BY period UNION ALL SELECT 'category', code, count(DISTINCT g.id) FROM g JOIN cat USING (id) GROUP BY code
UNION ALL SELECT 'year_category', academic_year || ' ' || code, count(DISTINCT g.id) FROM g JOIN cat USING (id) WHERE academic_year IS NOT NULL GROUP BY 2""",
)
def general_analytics(u: Universe, spark: SparkSession) -> DataFrame:
    """All series of the General page, as long rows."""
    return _series(u.activities.where(F.col("department_display") == GENERAL), u.categories)


def _series(g: DataFrame, categories: DataFrame) -> DataFrame:
    joined = g.join(categories, "id")
    rows = [
        g.agg(F.lit("total").alias("series"), F.lit("").alias("key"), F.count("*").alias("n")),
        g.agg(F.lit("periods_covered").alias("series"), F.lit("").alias("key"), n_distinct("period").alias("n")),
        g.groupBy(F.lit("period").alias("series"), F.col("period").alias("key")).agg(F.count("*").alias("n")),
        joined.groupBy(F.lit("category").alias("series"), F.col("code").alias("key")).agg(n_distinct("id").alias("n")),
        joined.where("academic_year is not null").groupBy(F.lit("year_category").alias("series"), F.concat_ws(" ", "academic_year", "code").alias("key")).agg(n_distinct("id").alias("n")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@modelled(
    "a11_department_analytics",
    """, g AS (SELECT * FROM act WHERE list_contains(string_split(department_display, '; '), 'NATION_3'))
SELECT 'total' AS series, '' AS key, count(*) AS n FROM g UNION ALL SELECT 'periods_covered', '', count(DISTINCT period) FROM g
UNION ALL SELECT 'period', period, count(*) FROM g GROUP BY period UNION ALL SELECT 'category', code, count(DISTINCT g.id) FROM g JOIN cat USING (id) GROUP BY code
UNION ALL SELECT 'year_category', academic_year || ' ' || code, count(DISTINCT g.id) FROM g JOIN cat USING (id) WHERE academic_year IS NOT NULL GROUP BY 2""",
)
def department_analytics(u: Universe, spark: SparkSession, department: str = "NATION_3") -> DataFrame:
    """All series of one department's page."""
    return _series(u.activities.where(F.array_contains(parts(F.col("department_display")), department)), u.categories)


@modelled("a12_category_buckets", "SELECT code, count(DISTINCT cat.id) AS n FROM cat JOIN act USING (id) WHERE period = '1997-98' GROUP BY code")
def category_buckets(u: Universe, spark: SparkSession, period: str = "1997-98") -> DataFrame:
    return u.categories.join(u.activities.where(F.col("period") == period), "id", "left_semi").groupBy("code").agg(n_distinct("id").alias("n"))


@modelled("a13_overview_public", "SELECT count(*) AS total, min(day) AS first_day, max(day) AS last_day, count(DISTINCT url) AS sources, count(DISTINCT period) AS periods, count(DISTINCT department_display) AS displays FROM act")
def overview_public(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.agg(F.count("*").alias("total"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), n_distinct("url").alias("sources"), n_distinct("period").alias("periods"), n_distinct("department_display").alias("displays"))


@modelled("a14_department_summary", "SELECT code, count(*) AS n, count(CASE WHEN is_primary THEN 1 END) AS n_primary FROM dep GROUP BY code")
def department_summary(u: Universe, spark: SparkSession) -> DataFrame:
    return u.departments.groupBy("code").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("n_primary"))


@modelled("a15_category_department_matrix", "SELECT cat.code AS category, dep.code AS department, count(DISTINCT cat.id) AS n FROM cat JOIN dep USING (id) GROUP BY ALL")
def category_department_matrix(u: Universe, spark: SparkSession) -> DataFrame:
    # Sets of one activity are distinct already, so no task holds the ids of all pairs.
    held = lambda df, name: df.groupBy("id").agg(F.collect_set(F.struct("code")).alias(name))
    pairs = held(u.categories, "a").join(held(u.departments, "b"), "id").select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    return pairs.groupBy(F.col("a.code").alias("category"), F.col("b.code").alias("department")).agg(F.count("*").alias("n"))


@modelled("a16_category_summary_bridge", "SELECT code, count(*) AS n, count(CASE WHEN is_primary THEN 1 END) AS n_primary, round(avg(confidence), 3) AS mean_confidence FROM cat GROUP BY code")
def category_summary_bridge(u: Universe, spark: SparkSession) -> DataFrame:
    return u.categories.groupBy("code").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("n_primary"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


@modelled("a17_category_trend", "SELECT academic_year AS year, code, count(*) AS n FROM act JOIN cat USING (id) WHERE code = 'PROMO' GROUP BY ALL")
def category_trend(u: Universe, spark: SparkSession, code: str = "PROMO") -> DataFrame:
    return u.activities.join(u.categories.where(F.col("code") == code), "id").groupBy(F.col("academic_year").alias("year"), "code").agg(F.count("*").alias("n"))


@modelled("a18_stakeholder_summary", "SELECT code, count(*) AS n, count(DISTINCT id) AS n_activities FROM stk GROUP BY code")
def stakeholder_summary(u: Universe, spark: SparkSession) -> DataFrame:
    return u.stakeholders.groupBy("code").agg(F.count("*").alias("n"), n_distinct("id").alias("n_activities"))


@modelled("a19_stakeholder_list", "SELECT coalesce(stakeholder_display, 'Students') AS stakeholder, count(*) AS n FROM act WHERE period <> 'Before 1996' GROUP BY 1")
def stakeholder_list(u: Universe, spark: SparkSession) -> DataFrame:
    shown = F.coalesce("stakeholder_display", F.lit("Students")).alias("stakeholder")
    return u.activities.where(F.col("period") != PERIODS[5]).groupBy(shown).agg(F.count("*").alias("n"))


@modelled("a20_category_list", "SELECT code, count(DISTINCT CASE WHEN period = '1998-99' THEN id END) AS n_period, count(DISTINCT CASE WHEN department_display = 'General' THEN id END) AS n_general, count(DISTINCT id) AS n FROM cat JOIN act USING (id) GROUP BY code")
def category_list(u: Universe, spark: SparkSession) -> DataFrame:
    joined = u.categories.join(u.activities, "id")
    return joined.groupBy("code").agg(n_distinct(F.when(F.col("period") == "1998-99", F.col("id"))).alias("n_period"), n_distinct(F.when(F.col("department_display") == GENERAL, F.col("id"))).alias("n_general"), n_distinct("id").alias("n"))


@modelled("a21_status_coverage", "SELECT status, count(*) AS n, round(count(url) / count(*), 4) AS matched FROM act GROUP BY status")
def status_coverage(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.groupBy("status").agg(F.count("*").alias("n"), F.round(F.count("url") / F.count("*"), 4).alias("matched"))


@modelled("a22_count_reportable", "SELECT count(*) AS n FROM act WHERE status = 'REPORTABLE'")
def count_reportable(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.where("status = 'REPORTABLE'").agg(F.count("*").alias("n"))


def display_count(u: Universe, category: str | None = None, stakeholder: str | None = None) -> DataFrame:
    """The dashboard's total: category pairs; stakeholder pairs under one filter; activities under both."""
    held = u.activities.where("status = 'REPORTABLE'").select("id")
    if category:
        held = held.join(u.categories.where(F.col("code") == category), "id", "left_semi")
    if stakeholder:
        held = held.join(u.stakeholders.where(F.col("code") == stakeholder), "id", "left_semi")
    if category and stakeholder:
        return held.agg(n_distinct("id").alias("n"))
    fan = u.stakeholders if category or stakeholder else u.categories
    return held.join(fan.select("id"), "id").agg(F.count("*").alias("n"))


@modelled(
    "a23_display_count",
    """, r AS (SELECT id FROM act WHERE status = 'REPORTABLE'), k AS (SELECT id FROM cat WHERE code = 'SMALL'), s AS (SELECT id FROM stk WHERE code = 'STAFF')
SELECT 'none' AS filter, count(*) AS n FROM r JOIN cat USING (id) UNION ALL SELECT 'category', count(*) FROM r JOIN stk USING (id) WHERE r.id IN (FROM k)
UNION ALL SELECT 'stakeholder', count(*) FROM r JOIN stk USING (id) WHERE r.id IN (FROM s) UNION ALL SELECT 'both', count(*) FROM r WHERE id IN (FROM k) AND id IN (FROM s)""",
)
def display_counts(u: Universe, spark: SparkSession) -> DataFrame:
    cases = {"none": (None, None), "category": ("SMALL", None), "stakeholder": (None, "STAFF"), "both": ("SMALL", "STAFF")}
    out = None
    for name, (c, s) in cases.items():
        row = display_count(u, c, s).select(F.lit(name).alias("filter"), "n")
        out = row if out is None else out.unionByName(row)
    return out


_R = "FROM act JOIN cat USING (id) WHERE status = 'REPORTABLE'"


def _reportable(u: Universe) -> DataFrame:
    return u.activities.where("status = 'REPORTABLE'")


@modelled("a24_reportable_yearly", f"SELECT academic_year AS year, count(*) AS n {_R} AND academic_year IS NOT NULL GROUP BY 1")
def reportable_yearly(u: Universe, spark: SparkSession) -> DataFrame:
    return _reportable(u).where("academic_year is not null").join(u.categories, "id").groupBy(F.col("academic_year").alias("year")).agg(F.count("*").alias("n"))


@modelled("a25_reportable_categories", "SELECT cat.code, count(*) AS n FROM act JOIN cat USING (id) JOIN stk USING (id) WHERE status = 'REPORTABLE' GROUP BY 1")
def reportable_categories(u: Universe, spark: SparkSession) -> DataFrame:
    """Category by stakeholder pairs; the fan-out is the intended count."""
    return _reportable(u).join(u.categories, "id").join(u.stakeholders.select("id"), "id").groupBy("code").agg(F.count("*").alias("n"))


@modelled(
    "a26_reportable_departments",
    """SELECT 'pairs' AS basis, dep.code, count(*) AS n FROM act JOIN dep USING (id) WHERE status = 'REPORTABLE' GROUP BY ALL
UNION ALL SELECT 'stakeholder_pairs', dep.code, count(*) FROM act JOIN dep USING (id) JOIN stk USING (id) WHERE status = 'REPORTABLE' AND act.id IN (SELECT id FROM cat WHERE code = 'LARGE') GROUP BY ALL""",
)
def reportable_departments(u: Universe, spark: SparkSession) -> DataFrame:
    joined = _reportable(u).join(u.departments, "id")
    plain = joined.groupBy(F.lit("pairs").alias("basis"), "code").agg(F.count("*").alias("n"))
    held = joined.join(u.categories.where("code = 'LARGE'"), "id", "left_semi").join(u.stakeholders.select("id"), "id")
    return plain.unionByName(held.groupBy(F.lit("stakeholder_pairs").alias("basis"), "code").agg(F.count("*").alias("n")))


@modelled("a27_reportable_stakeholders", "SELECT stk.code, count(*) AS n FROM act JOIN stk USING (id) WHERE status = 'REPORTABLE' GROUP BY 1")
def reportable_stakeholders(u: Universe, spark: SparkSession) -> DataFrame:
    return _reportable(u).join(u.stakeholders, "id").groupBy("code").agg(F.count("*").alias("n"))


@modelled("a28_reportable_months", f"SELECT strftime(day, '%Y-%m') AS month, count(*) AS n {_R} GROUP BY 1")
def reportable_months(u: Universe, spark: SparkSession) -> DataFrame:
    return _reportable(u).join(u.categories, "id").groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@modelled("a29_review_states", "SELECT coalesce(review_status, 'unknown') AS review_status, count(DISTINCT id) AS n FROM act GROUP BY 1")
def review_states(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.groupBy(F.coalesce("review_status", F.lit("unknown")).alias("review_status")).agg(n_distinct("id").alias("n"))


@modelled("a30_url_coverage", "SELECT count(DISTINCT CASE WHEN url IS NOT NULL THEN id END) AS with_url, count(DISTINCT CASE WHEN url IS NULL THEN id END) AS without_url FROM act WHERE status = 'REPORTABLE'")
def url_coverage(u: Universe, spark: SparkSession) -> DataFrame:
    """Both counts on one basis: activities."""
    has = F.col("url").isNotNull()
    return _reportable(u).agg(n_distinct(F.when(has, F.col("id"))).alias("with_url"), n_distinct(F.when(~has, F.col("id"))).alias("without_url"))


@modelled(
    "a31_scope_split",
    """, own AS (SELECT DISTINCT id FROM dep WHERE code <> 'General') SELECT CASE WHEN own.id IS NULL THEN 'general' ELSE 'departmental' END AS scope, count(*) AS n
FROM act JOIN cat ON cat.id = act.id LEFT JOIN own ON own.id = act.id WHERE status = 'REPORTABLE' GROUP BY 1""",
)
def scope_split(u: Universe, spark: SparkSession) -> DataFrame:
    own = u.departments.where(F.col("code") != GENERAL)
    joined = _reportable(u).join(u.categories.select("id", "code"), "id")
    general = joined.join(own, "id", "left_anti").agg(F.lit("general").alias("scope"), F.count("*").alias("n"))
    departmental = joined.join(own, "id", "left_semi").agg(F.lit("departmental").alias("scope"), F.count("*").alias("n"))
    return general.unionByName(departmental).where("n > 0")


@modelled(
    "a32_availability",
    """, r AS (SELECT * FROM act WHERE status = 'REPORTABLE') SELECT 'year' AS dimension, academic_year AS value FROM r WHERE academic_year IS NOT NULL GROUP BY 2
UNION ALL SELECT 'category', code FROM cat JOIN r USING (id) GROUP BY 2 UNION ALL SELECT 'department', code FROM dep JOIN r USING (id) GROUP BY 2
UNION ALL SELECT 'stakeholder', code FROM stk JOIN r USING (id) GROUP BY 2 UNION ALL SELECT 'first_day', min(day)::VARCHAR FROM r UNION ALL SELECT 'last_day', max(day)::VARCHAR FROM r""",
)
def availability(u: Universe, spark: SparkSession) -> DataFrame:
    r = _reportable(u)
    out = r.where("academic_year is not null").select(F.lit("year").alias("dimension"), F.col("academic_year").alias("value")).distinct()
    for name, bridge in (("category", u.categories), ("department", u.departments), ("stakeholder", u.stakeholders)):
        out = out.unionByName(bridge.join(r, "id", "left_semi").select(F.lit(name).alias("dimension"), F.col("code").alias("value")).distinct())
    ends = r.agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))
    return out.unionByName(ends.unpivot([], ["first_day", "last_day"], "dimension", "value"))


@modelled(
    "a33_admin_summary",
    """SELECT 'status' AS grouping_name, status AS value, count(*) AS n, sum(score)::BIGINT AS score FROM act GROUP BY 2
UNION ALL SELECT 'review_status', coalesce(review_status, '-'), count(*), sum(score)::BIGINT FROM act GROUP BY 2
UNION ALL SELECT 'period', period, count(*), sum(score)::BIGINT FROM act GROUP BY 2 UNION ALL SELECT 'state', state, count(*), sum(score)::BIGINT FROM act GROUP BY 2""",
)
def admin_summary(u: Universe, spark: SparkSession) -> DataFrame:
    """Several group-bys in one pass over the facts, by grouping sets."""
    names = ["status", "review_status", "period", "state"]
    rows = u.activities.withColumn("review_status", F.coalesce("review_status", F.lit("-")))
    sets = rows.groupingSets([[F.col(n)] for n in names], *names).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("score").alias("score"))
    # One bit a column, the first column's the highest, set where a set leaves the column out.
    places = {(1 << len(names)) - 1 - (1 << len(names) - 1 - i): n for i, n in enumerate(names)}
    pick = lambda value: F.coalesce(*(F.when(F.col("g") == g, value(n)) for g, n in places.items()))
    return sets.select(pick(F.lit).alias("grouping_name"), pick(F.col).alias("value"), "n", "score")


@modelled("a35_multi_label", "SELECT count(*) AS n FROM (SELECT id FROM cat GROUP BY id HAVING count(*) > 1)")
def multi_label(u: Universe, spark: SparkSession) -> DataFrame:
    return u.categories.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n"))


@modelled("a36_label_lists", "SELECT id, string_agg(code, ',' ORDER BY code) AS labels FROM cat GROUP BY id")
def label_lists(u: Universe, spark: SparkSession) -> DataFrame:
    return u.categories.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("code")), ",").alias("labels"))


@modelled(
    "a37_hint_validation",
    """, hint AS (SELECT id, CASE WHEN score % 3 = 0 THEN NULL WHEN score % 3 = 1 THEN 'PROMO' ELSE 'LARGE' END AS hint FROM act), own AS (SELECT id, max(CASE WHEN is_primary THEN code END) AS first, list(code) AS codes FROM cat GROUP BY id)
SELECT CASE WHEN hint IS NULL THEN 'NO_HINT' WHEN hint = first THEN 'CONSISTENT' WHEN list_contains(codes, hint) THEN 'SUPPORTING' ELSE 'DIFFERENT' END AS verdict, count(*) AS n FROM hint JOIN own USING (id) GROUP BY 1""",
)
def hint_validation(u: Universe, spark: SparkSession) -> DataFrame:
    own = u.categories.groupBy("id").agg(F.max(F.when(F.col("is_primary"), F.col("code"))).alias("first"), F.collect_set("code").alias("codes"))
    rest = F.col("score") % 3
    hinted = u.activities.select("id", F.when(rest == 1, "PROMO").when(rest == 2, "LARGE").alias("hint")).join(own, "id")
    verdict = F.when(F.col("hint").isNull(), "NO_HINT").when(F.col("hint") == F.col("first"), "CONSISTENT").when(F.array_contains("codes", F.col("hint")), "SUPPORTING").otherwise("DIFFERENT")
    return hinted.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@modelled("a38_promotion_funnel", "SELECT k AS sources, count(*) AS n FROM (SELECT id, count(*) AS k FROM dep GROUP BY id) GROUP BY k")
def promotion_funnel(u: Universe, spark: SparkSession) -> DataFrame:
    """How many activities have how many supporting links."""
    return u.departments.groupBy("id").agg(F.count("*").alias("sources")).groupBy("sources").agg(F.count("*").alias("n"))


@modelled("a39_distributions", "SELECT 'status' AS field, status AS value, count(*) AS n FROM act GROUP BY 2 UNION ALL SELECT 'department', trim(unnest(string_split(department_display, ';'))), count(*) FROM act GROUP BY 2")
def distributions(u: Universe, spark: SparkSession) -> DataFrame:
    plain = u.activities.groupBy(F.lit("status").alias("field"), F.col("status").alias("value")).agg(F.count("*").alias("n"))
    listed = u.activities.select(F.explode(parts(F.col("department_display"))).alias("value")).groupBy(F.lit("department").alias("field"), "value").agg(F.count("*").alias("n"))
    return plain.unionByName(listed)


@modelled("a40_evidence_bands", "SELECT CASE WHEN score >= 8 THEN 'strong' WHEN score >= 4 THEN 'medium' WHEN score >= 1 THEN 'weak' ELSE 'none' END AS band, count(*) AS n FROM act GROUP BY 1")
def evidence_bands(u: Universe, spark: SparkSession) -> DataFrame:
    band = F.when(F.col("score") >= 8, "strong").when(F.col("score") >= 4, "medium").when(F.col("score") >= 1, "weak").otherwise("none")
    return u.activities.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@modelled(
    "a44_coverage_matrix",
    """SELECT period, count(DISTINCT act.id) AS activities, count(DISTINCT cat.code) AS categories, count(DISTINCT dep.code) AS departments, count(DISTINCT stk.code) AS stakeholders
FROM act LEFT JOIN cat ON cat.id = act.id LEFT JOIN dep ON dep.id = act.id LEFT JOIN stk ON stk.id = act.id GROUP BY period""",
)
def coverage_matrix(u: Universe, spark: SparkSession) -> DataFrame:
    """Distinct members of each dimension in each period; each bridge is reduced before it is joined."""
    out = u.activities.groupBy("period").agg(F.count("*").alias("activities"))
    when = u.activities.select("id", "period")
    for name, bridge in (("categories", u.categories), ("departments", u.departments), ("stakeholders", u.stakeholders)):
        out = out.join(when.join(bridge, "id").groupBy("period").agg(n_distinct("code").alias(name)), "period", "left").fillna(0, [name])
    return out


@modelled(
    "a47_reconciliation",
    """SELECT 'orphan_categories' AS name, count(*) AS n FROM cat WHERE id NOT IN (SELECT id FROM act) UNION ALL SELECT 'repeated_pairs', count(*) FROM (SELECT id, code FROM cat GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'repeated_ids', count(*) FROM (SELECT id FROM act GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'no_category', count(*) FROM act WHERE id NOT IN (SELECT id FROM cat)""",
)
def reconciliation(u: Universe, spark: SparkSession) -> DataFrame:
    """Integrity checks: how many rows break each."""
    checks = {
        "orphan_categories": u.categories.join(u.activities, "id", "left_anti"),
        "repeated_pairs": u.categories.groupBy("id", "code").count().where("count > 1"),
        "repeated_ids": u.activities.groupBy("id").count().where("count > 1"),
        "no_category": u.activities.join(u.categories, "id", "left_anti"),
    }
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@modelled("a48_workbook_counts", "SELECT state, status, period, count(*) AS n FROM act GROUP BY ALL")
def workbook_counts(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.groupBy("state", "status", "period").agg(F.count("*").alias("n"))


@modelled(
    "a49_scope_year_reconciliation",
    """, own AS (SELECT DISTINCT id FROM dep WHERE code <> 'General') SELECT CASE WHEN own.id IS NULL THEN 'general' ELSE 'departmental' END AS scope, period, count(DISTINCT act.id) AS activities,
count(cat.code) AS pairs, count(cat.code) - count(DISTINCT act.id) AS difference FROM act LEFT JOIN cat ON cat.id = act.id LEFT JOIN own ON own.id = act.id GROUP BY ALL""",
)
def scope_year_reconciliation(u: Universe, spark: SparkSession) -> DataFrame:
    own = u.departments.where(F.col("code") != GENERAL).select("id").distinct().withColumn("departmental", F.lit(True))
    pairs = u.categories.groupBy("id").agg(F.count("*").alias("k"))
    rows = u.activities.join(pairs, "id", "left").join(own, "id", "left")
    scope = F.when(F.col("departmental"), "departmental").otherwise("general").alias("scope")
    out = rows.groupBy(scope, "period").agg(F.count("*").alias("activities"), F.coalesce(F.sum("k"), F.lit(0)).alias("pairs"))
    return out.withColumn("difference", F.col("pairs") - F.col("activities"))
