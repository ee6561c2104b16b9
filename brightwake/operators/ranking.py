"""Joins, rankings, sorts, pages and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.model import CATEGORIES, PERIODS, Universe, master, modelled
from ..sources.store import stored_table
from .aggregates import n_distinct


@modelled("j03_dimension_left_join", "SELECT n_name AS code, count(dep.id) AS n FROM nation LEFT JOIN dep ON dep.code = n_name GROUP BY n_name")
def dimension_left_join(u: Universe, spark: SparkSession) -> DataFrame:
    return u.members.join(u.departments, "code", "left").groupBy("code").agg(F.count("id").alias("n"))


@modelled("j07_conditional_left_join", "SELECT act.id, dep.code AS primary_department FROM act LEFT JOIN dep ON dep.id = act.id AND dep.is_primary")
def conditional_left_join(u: Universe, spark: SparkSession) -> DataFrame:
    first = u.departments.where("is_primary").select("id", F.col("code").alias("primary_department"))
    return u.activities.select("id").join(first, "id", "left")


@modelled("j08_bridge_fan_out", "SELECT cat.code AS category, stk.code AS stakeholder, count(*) AS n FROM cat JOIN stk USING (id) GROUP BY ALL")
def bridge_fan_out(u: Universe, spark: SparkSession) -> DataFrame:
    pairs = u.categories.select("id", F.col("code").alias("category")).join(u.stakeholders.select("id", F.col("code").alias("stakeholder")), "id")
    return pairs.groupBy("category", "stakeholder").agg(F.count("*").alias("n"))


@modelled(
    "j11_blocked_self_join",
    """, b AS (SELECT id, customer, day, price FROM act) SELECT a.id AS left_id, b.id AS right_id FROM b a JOIN b ON a.customer = b.customer AND a.id < b.id AND abs(date_diff('day', a.day, b.day)) <= 30""",
)
def blocked_self_join(u: Universe, spark: SparkSession) -> DataFrame:
    """Pairs of one customer's activities within 30 days; days are bucketed, so that the join is an equi-join.

    Each left row looks into its own bucket and the next one, which reaches every
    later day within 30; earlier days are found from the other side.
    """
    rows = u.activities.select("id", "customer", "day").withColumn("bucket", F.floor(F.datediff("day", F.lit("1990-01-01")) / 31))
    early = rows.select("customer", F.col("id").alias("a"), F.col("day").alias("da"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    late = rows.select("customer", "bucket", F.col("id").alias("b"), F.col("day").alias("db"))
    near = early.join(late, ["customer", "bucket"]).where((F.col("db") > F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("a") < F.col("b"))))
    return near.where(F.datediff("db", "da") <= 30).select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


@modelled(
    "j14_priority_cascade",
    """, known AS (SELECT id, url, title, row_number() OVER (ORDER BY id) AS r FROM act WHERE id % 7 = 0), u AS (SELECT url, min(id) AS by_url FROM known WHERE url IS NOT NULL GROUP BY url), t AS (SELECT title, min(id) AS by_title FROM known GROUP BY title)
SELECT act.id, coalesce(k.id, by_url, by_title) AS found, CASE WHEN k.id IS NOT NULL THEN 'id' WHEN by_url IS NOT NULL THEN 'url' WHEN by_title IS NOT NULL THEN 'title' ELSE 'new' END AS how
FROM act LEFT JOIN known k ON k.id = act.id LEFT JOIN u ON u.url = act.url LEFT JOIN t ON t.title = act.title""",
)
def priority_cascade(u: Universe, spark: SparkSession) -> DataFrame:
    """First of id, url and title that a known row shares."""
    known = u.activities.where("id % 7 = 0")
    by_id = known.select("id", F.col("id").alias("by_id"))
    by_url = known.where("url is not null").groupBy("url").agg(F.min("id").alias("by_url"))
    by_title = known.groupBy("title").agg(F.min("id").alias("by_title"))
    rows = u.activities.select("id", "url", "title").join(by_id, "id", "left").join(by_url, "url", "left").join(by_title, "title", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_url").isNotNull(), "url").when(F.col("by_title").isNotNull(), "title").otherwise("new")
    return rows.select("id", F.coalesce("by_id", "by_url", "by_title").alias("found"), how.alias("how"))


@modelled("j15_nearest_match", "SELECT customer, max_by(id, price) AS id, max(price) AS price FROM (SELECT customer, id, price FROM act QUALIFY row_number() OVER (PARTITION BY customer ORDER BY price DESC, id DESC) = 1) GROUP BY customer")
def nearest_match(u: Universe, spark: SparkSession) -> DataFrame:
    best = u.activities.groupBy("customer").agg(F.max(F.struct("price", "id")).alias("m"))
    return best.select("customer", F.col("m.id").alias("id"), F.col("m.price").alias("price"))


@modelled("j17_least_code_sort_key", "SELECT act.id, min(code) AS first_code FROM act LEFT JOIN cat USING (id) GROUP BY act.id")
def least_code_sort_key(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id").join(u.categories.groupBy("id").agg(F.min("code").alias("first_code")), "id", "left")


def _counts(u: Universe) -> DataFrame:
    return u.departments.groupBy("code").agg(n_distinct("id").alias("n"))


@modelled("w01_extremes", "SELECT 'highest' AS kind, code, n FROM (SELECT code, count(*) AS n FROM dep GROUP BY code ORDER BY n DESC, code DESC LIMIT 1) UNION ALL SELECT 'lowest', code, n FROM (SELECT code, count(*) AS n FROM dep GROUP BY code ORDER BY n, code LIMIT 1)")
def extremes(u: Universe, spark: SparkSession) -> DataFrame:
    """Largest and smallest group; ties go to the largest, or smallest, key."""
    m = _counts(u).agg(F.max(F.struct("n", "code")).alias("highest"), F.min(F.struct("n", "code")).alias("lowest"))
    return m.unpivot([], ["highest", "lowest"], "kind", "m").select("kind", "m.code", "m.n")


@modelled("w02_full_ranking", "SELECT c.code, count(cat.id) AS n, row_number() OVER (ORDER BY count(cat.id) DESC, c.code DESC) AS place FROM categories c LEFT JOIN cat ON cat.code = c.code GROUP BY c.code")
def full_ranking(u: Universe, spark: SparkSession) -> DataFrame:
    listed = master(spark, CATEGORIES, "code").select("code").join(u.categories.groupBy("code").agg(F.count("*").alias("k")), "code", "left").select("code", F.coalesce("k", F.lit(0)).alias("n"))
    # One row a category.
    return listed.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("code"))).cast("long"))


@modelled("w03_top_n", "SELECT code, count(*) AS n FROM dep GROUP BY code ORDER BY n DESC, code DESC LIMIT 5")
def top_n(u: Universe, spark: SparkSession, n: int = 5) -> DataFrame:
    """Non-empty groups only; n is held between 1 and 50."""
    return _counts(u).where("n > 0").orderBy(F.desc("n"), F.desc("code")).limit(max(1, min(50, n)))


@modelled("w04_canonical_record", "SELECT customer, id, title FROM act QUALIFY row_number() OVER (PARTITION BY customer ORDER BY length(title) DESC, day, id) = 1")
def canonical_record(u: Universe, spark: SparkSession) -> DataFrame:
    """Longest title, else earliest; a struct minimum aggregates before the shuffle, a window could not."""
    best = u.activities.groupBy("customer").agg(F.min(F.struct((-F.length("title")).alias("l"), "day", "id", "title")).alias("m"))
    return best.select("customer", "m.id", "m.title")


@modelled("w05_first_seen", "SELECT title, min(id) AS first_id, count(*) AS n FROM act GROUP BY title")
def first_seen(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.groupBy("title").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


@modelled(
    "w06_survivor",
    """, k AS (SELECT id, count(*) AS dims FROM cat GROUP BY id) SELECT customer, act.id FROM act LEFT JOIN k USING (id)
QUALIFY row_number() OVER (PARTITION BY customer ORDER BY url IS NULL, coalesce(dims, 0) DESC, length(description) DESC, act.id) = 1""",
)
def survivor(u: Universe, spark: SparkSession) -> DataFrame:
    dims = u.categories.groupBy("id").agg(F.count("*").alias("dims"))
    rows = u.activities.join(dims, "id", "left").select("customer", F.struct(F.col("url").isNull().alias("u"), (-F.coalesce("dims", F.lit(0))).alias("d"), (-F.length("description")).alias("l"), "id").alias("m"))
    return rows.groupBy("customer").agg(F.min("m").alias("m")).select("customer", "m.id")


@modelled("w08_primary_label", "SELECT id, code FROM cat QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, code) = 1")
def primary_label(u: Universe, spark: SparkSession) -> DataFrame:
    best = u.categories.groupBy("id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "code")).alias("m"))
    return best.select("id", "m.code")


def numbered(rows: DataFrame, order: list[str], name: str, group: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their place from 1 by ``order`` (without ties), in each group (not null) if there are groups.

    Range parts are numbered on their own and shifted by the sizes of the group's
    parts before, so a group of many rows is not one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = stored_table(rows.repartitionByRange(n, *group, *order).withColumn("part", F.spark_partition_id()), "numbered")
    sizes = parted.groupBy(*group, "part").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part and group
    before = sizes.select(*group, "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*group, "part").orderBy(*order)) + F.col("before")
    return parted.join(before, [*group, "part"]).withColumn(name, place.cast("long")).drop("part", "before")


@modelled("w09_serial_number", "SELECT period, id, row_number() OVER (PARTITION BY period ORDER BY day, id) AS serial FROM act")
def serial_number(u: Universe, spark: SparkSession) -> DataFrame:
    """Serial numbers of each report (one period)."""
    return numbered(u.activities.select("period", "day", "id"), ["day", "id"], "serial", ("period",)).select("period", "id", "serial")


@modelled("o01_sorted_page", "SELECT id, academic_year, price FROM act ORDER BY academic_year DESC NULLS LAST, id DESC LIMIT 20 OFFSET 40")
def sorted_page(u: Universe, spark: SparkSession, page: int = 3, size: int = 20) -> DataFrame:
    return u.activities.select("id", "academic_year", "price").orderBy(F.desc_nulls_last("academic_year"), F.desc("id")).offset((max(1, page) - 1) * size).limit(max(1, min(100, size)))


@modelled("o03_admin_sort", "SELECT id, review_status FROM act ORDER BY review_status ASC NULLS FIRST, id LIMIT 25")
def admin_sort(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id", "review_status").orderBy(F.asc_nulls_first("review_status"), "id").limit(25)


@modelled("o04_title_order", "SELECT id, title FROM act ORDER BY lower(title), id LIMIT 30")
def title_order(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id", "title").orderBy(F.lower("title"), "id").limit(30)


@modelled("o05_page_count", "SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS pages FROM act")
def page_count(u: Universe, spark: SparkSession, size: int = 20) -> DataFrame:
    return u.activities.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("pages"))


@modelled("o06_latest", "SELECT id, day FROM act ORDER BY day DESC, id DESC LIMIT 8")
def latest(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id", "day").orderBy(F.desc("day"), F.desc("id")).limit(8)


@modelled("o07_master_order", "SELECT p.place::INT AS place, p.period, count(act.id) AS n FROM periods p LEFT JOIN act USING (period) GROUP BY ALL")
def master_order(u: Universe, spark: SparkSession) -> DataFrame:
    counted = u.activities.groupBy("period").agg(F.count("*").alias("k"))
    return master(spark, PERIODS, "period").join(counted, "period", "left").select("place", "period", F.coalesce("k", F.lit(0)).alias("n")).orderBy("place")


@modelled("u01_set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT id FROM cat WHERE code = 'PROMO' INTERSECT SELECT id FROM cat WHERE code = 'LARGE') UNION ALL SELECT 'either', count(*) FROM (SELECT id FROM cat WHERE code = 'PROMO' UNION SELECT id FROM cat WHERE code = 'LARGE') UNION ALL SELECT 'only_first', count(*) FROM (SELECT id FROM cat WHERE code = 'PROMO' EXCEPT SELECT id FROM cat WHERE code = 'LARGE')")
def set_operations(u: Universe, spark: SparkSession) -> DataFrame:
    """Intersection, union and difference of two categories' activities, from one pass over the bridge."""
    has = u.categories.where("code in ('PROMO', 'LARGE')").groupBy("id").agg(F.bool_or(F.col("code") == "PROMO").alias("p"), F.bool_or(F.col("code") == "LARGE").alias("l"))
    counts = has.agg(F.count_if(F.col("p") & F.col("l")).alias("both"), F.count("*").alias("either"), F.count_if(F.col("p") & ~F.col("l")).alias("only_first"))
    return counts.unpivot([], ["both", "either", "only_first"], "kind", "n")


@modelled("u04_distinct_values", "SELECT DISTINCT department_display FROM act WHERE department_display IS NOT NULL")
def distinct_values(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("department_display").where("department_display is not null").distinct()
