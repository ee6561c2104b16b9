"""The semantic model: an activity fact with three multi-valued dimensions, bound to the driver's tables.

Activities are orders; categories are the types of the parts in an order;
departments are the nations of its suppliers, one of which plays "General";
stakeholders are the customer's segment, and the staff for urgent orders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register

#: Dimension members in master order.
PERIODS = ("1996-97", "1997-98", "1998-99", "1999-00", "2000-01", "Before 1996")
PUBLIC_YEARS = PERIODS[:5]
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
#: Categories that a department can have of its own.
DEPARTMENTAL = ("LARGE", "PROMO", "SMALL")
PUBLIC_NAMES = {"ECONOMY": "Economy Programmes", "LARGE": "Large Events", "MEDIUM": "Medium Events", "PROMO": "Promotions", "SMALL": "Small Events", "STANDARD": "Standard Events"}
GENERAL = "General"
GENERAL_MEMBER = "NATION_0"
DEFAULT_STAKEHOLDER = "Students"
FIRST_YEAR, LAST_YEAR = 1996, 2000


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span(year: Column) -> Column:
    """Label of the year that begins in ``year``: 1999 -> 1999-00."""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def august_year(day: Column) -> Column:
    """Academic year that begins in August, within the master years, else null."""
    y = F.year(F.add_months(day, -7))
    return F.when(y.between(FIRST_YEAR, LAST_YEAR), span(y))


def june_year(day: Column) -> Column:
    """Academic year that begins in June, unbounded."""
    return span(F.year(F.add_months(day, -5)))


def clamped_period(year: Column) -> Column:
    """Period of a calendar year; earlier and later years go to the first and last one."""
    return F.when(year < FIRST_YEAR, PERIODS[5]).when(year >= LAST_YEAR, PERIODS[4]).when(year.isNotNull(), span(year))


def resolved_period(stored: Column, day: Column) -> Column:
    return F.coalesce(F.when(stored.isin(*PUBLIC_YEARS), stored), clamped_period(F.year(day)), F.lit(PERIODS[5]))


@dataclass(frozen=True)
class Universe:
    """The fact and its bridges; every member is lazy."""

    activities: DataFrame
    categories: DataFrame
    departments: DataFrame
    stakeholders: DataFrame
    #: All members of the department dimension, used or not.
    members: DataFrame


def universe(spark: SparkSession, sf_dir: str) -> Universe:
    orders, customer = tables(spark, sf_dir, "orders"), tables(spark, sf_dir, "customer")
    line = tables(spark, sf_dir, "lineitem")
    suppliers = tables(spark, sf_dir, "supplier").join(tables(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    # Every line has a part and a supplier, so each bridge joins only its own dimension.
    by_category = line.join(tables(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("p_type").alias("code"))
    by_department = line.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("id"), F.col("n_name").alias("code"))

    def bridge(lines: DataFrame) -> DataFrame:
        # Dealt by id once: the counts, the window and what joins the bridge by id need no further shuffle.
        counted = lines.repartition("id").groupBy("id", "code").agg(F.count("*").alias("n"))
        first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "code")) == 1
        confidence = F.least(F.lit(0.95), F.lit(0.45) + F.lit(0.1) * F.col("n"))
        return counted.select("id", "code", F.round(confidence, 4).alias("confidence"), first.alias("is_primary"))

    departments = bridge(by_department).withColumn("code", F.when(F.col("code") == GENERAL_MEMBER, GENERAL).otherwise(F.col("code")))
    shown = departments.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("code")), "; ").alias("department_display"))
    with_customer = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    day = F.to_date("o_orderdate")
    facts = with_customer.select(
        F.col("o_orderkey").alias("id"),
        day.alias("day"),
        F.concat(F.substring("o_orderpriority", 3, 20), F.lit(" order for "), F.coalesce("c_mktsegment", F.lit("nobody"))).alias("title"),
        F.concat(F.lit("Placed by "), F.coalesce("c_name", F.lit("?")), F.lit(" with status "), F.col("o_orderstatus")).alias("description"),
        august_year(day).alias("academic_year"),
        resolved_period(august_year(day), day).alias("period"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("stakeholder_display"),
        F.col("o_orderstatus").alias("state"),
        F.when(F.col("o_orderstatus") == "F", "REPORTABLE").when(F.col("o_orderstatus") == "O", "REVIEW_REQUIRED").otherwise("NON_ACTIVITY").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "APPROVED").when(F.col("o_orderpriority") == "2-HIGH", "REJECTED").alias("review_status"),
        (F.col("o_orderkey") % 11).alias("score"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("customer"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("https://Example.org/a/"), (F.col("o_orderkey") % 1000).cast("string"))).alias("url"),
    )
    activities = facts.join(shown, "id", "left")
    segment = with_customer.where("c_mktsegment is not null").select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("code"))
    staff = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.lit("STAFF").alias("code"))
    members = tables(spark, sf_dir, "nation").select(F.col("n_name").alias("code"))
    return Universe(activities, bridge(by_category), departments, segment.unionByName(staff), members)


def master(spark: SparkSession, names: tuple[str, ...], column: str) -> DataFrame:
    """A dimension's members with their place."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{column} string, place int")


#: The same model in DuckDB SQL, as the head of every oracle query.
BASE = f"""
WITH line AS (
  SELECT l_orderkey AS id, p_type AS category, n_name AS department FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), cat AS (
  SELECT id, category AS code, round(least(0.95, 0.45 + 0.1 * count(*)), 4)::DOUBLE AS confidence,
    row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, category) = 1 AS is_primary FROM line GROUP BY id, category
), dep AS (
  SELECT id, CASE WHEN department = '{GENERAL_MEMBER}' THEN '{GENERAL}' ELSE department END AS code, round(least(0.95, 0.45 + 0.1 * count(*)), 4)::DOUBLE AS confidence,
    row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, department) = 1 AS is_primary FROM line GROUP BY id, department
), stk AS (
  SELECT o_orderkey AS id, c_mktsegment AS code FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL
  UNION ALL SELECT o_orderkey, 'STAFF' FROM orders WHERE o_orderpriority = '1-URGENT'
), fact AS (
  SELECT o_orderkey AS id, o_orderdate::DATE AS day, substr(o_orderpriority, 3) || ' order for ' || coalesce(c_mktsegment, 'nobody') AS title,
    'Placed by ' || coalesce(c_name, '?') || ' with status ' || o_orderstatus AS description,
    year(o_orderdate::DATE - INTERVAL 7 MONTH) AS y, year(o_orderdate) AS cy,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS stakeholder_display, o_orderstatus AS state,
    CASE o_orderstatus WHEN 'F' THEN 'REPORTABLE' WHEN 'O' THEN 'REVIEW_REQUIRED' ELSE 'NON_ACTIVITY' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'APPROVED' WHEN '2-HIGH' THEN 'REJECTED' END AS review_status,
    o_orderkey % 11 AS score, o_totalprice AS price, o_custkey AS customer,
    CASE WHEN o_orderkey % 5 = 0 THEN 'https://Example.org/a/' || (o_orderkey % 1000) END AS url
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), act AS (
  SELECT f.*, CASE WHEN y BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN y || '-' || right('0' || ((y + 1) % 100), 2) END AS academic_year,
    CASE WHEN y BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN y || '-' || right('0' || ((y + 1) % 100), 2) WHEN cy < {FIRST_YEAR} THEN '{PERIODS[5]}'
      WHEN cy >= {LAST_YEAR} THEN '{PERIODS[4]}' ELSE cy || '-' || right('0' || ((cy + 1) % 100), 2) END AS period, department_display
  FROM fact f LEFT JOIN (SELECT id, string_agg(code, '; ' ORDER BY code) AS department_display FROM dep GROUP BY id) USING (id)
), periods AS (SELECT unnest({list(PERIODS)}) AS period, unnest(range({len(PERIODS)})) AS place
), years AS (SELECT unnest({list(PUBLIC_YEARS)}) AS year, unnest(range(5)) AS place
), categories AS (SELECT unnest({list(CATEGORIES)}) AS code, unnest({[PUBLIC_NAMES[c] for c in CATEGORIES]}) AS name, unnest(range({len(CATEGORIES)})) AS place
), masters AS (SELECT n_name AS department FROM nation WHERE n_name <> '{GENERAL_MEMBER}')
"""


def query(name: str, sql: str | None = None, base: bool = True) -> Callable[[Callable], Callable]:
    """Register a function of (spark, sf_dir), with the DuckDB query that follows ``BASE``."""

    def add(f: Callable) -> Callable:
        register(name, f, None if sql is None else BASE + sql if base else sql)
        return f

    return add


def modelled(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of (universe, spark)."""

    def add(f: Callable) -> Callable:
        register(name, lambda spark, sf_dir: f(universe(spark, sf_dir), spark), None if sql is None else BASE + sql)
        return f

    return add
