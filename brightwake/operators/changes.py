"""Mutations as append-only change logs that are folded into a current state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Universe, modelled, query, tables

IMMUTABLE = ("id", "staging_id")


def folded(changes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Latest value of each key, by a struct maximum that aggregates before the shuffle."""
    last = F.max(F.struct(*order, value)).alias("m")
    return changes.groupBy(*keys).agg(last, F.count("*").alias("n_changes")).select(*keys, F.col(f"m.{value}").alias(value), "n_changes")


def upserted(old: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new``; columns in ``kept`` keep their old value where there is one."""
    renamed = new.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in new.columns if c != key))
    joined = old.withColumn("__had", F.lit(True)).join(renamed.withColumn("__has", F.lit(True)), key, "full")
    columns = [F.coalesce(c, f"__{c}").alias(c) if c in kept else F.when(F.col("__has"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in old.columns if c != key]
    return joined.select(key, *columns)


def checked_change(field: str, fields: list[str]) -> str:
    """The field, if it may be changed."""
    if field in IMMUTABLE:
        raise ValueError(f"{field} can't be changed")
    if field not in fields:
        raise ValueError(f"{field} is no field")
    return field


@query(
    "m01_upsert",
    """WITH old AS (SELECT c_custkey AS id, c_mktsegment AS segment, round(c_acctbal, 2) AS balance FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT c_custkey AS id, 'NEW' AS segment, round(c_acctbal * 2, 2) AS balance FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(old.id, new.id) AS id, coalesce(old.segment, new.segment) AS segment, CASE WHEN new.id IS NOT NULL THEN new.balance ELSE old.balance END AS balance FROM old FULL JOIN new ON old.id = new.id""",
    base=False,
)
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows are replaced or added, and the segment, an admin's column, is kept."""
    c = tables(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    old = c.where("id % 3 <> 0").withColumn("balance", F.round("balance", 2))
    new = c.where("id % 2 = 0").select("id", F.lit("NEW").alias("segment"), F.round(F.col("balance") * 2, 2).alias("balance"))
    return upserted(old, new, "id", kept=("segment",))


@query("m05_change_log_fold", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n_changes FROM events GROUP BY ALL", base=False)
def change_log_fold(spark: SparkSession, d: str) -> DataFrame:
    return folded(tables(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@modelled("m07_delete_cascade", "SELECT 'fact' AS kind, count(*) AS n FROM act WHERE status <> 'NON_ACTIVITY' UNION ALL SELECT 'categories', count(*) FROM cat WHERE id IN (SELECT id FROM act WHERE status <> 'NON_ACTIVITY') UNION ALL SELECT 'departments', count(*) FROM dep WHERE id IN (SELECT id FROM act WHERE status <> 'NON_ACTIVITY')")
def delete_cascade(u: Universe, spark: SparkSession) -> DataFrame:
    """What remains of the fact and its bridges when non-activities are deleted."""
    gone = u.activities.where("status = 'NON_ACTIVITY'").select("id")
    out = None
    for kind, rows in (("fact", u.activities), ("categories", u.categories), ("departments", u.departments)):
        left = rows.join(gone, "id", "left_anti").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = left if out is None else out.unionByName(left)
    return out


@modelled("m10_merge_into", "SELECT CASE WHEN id % 10 = 1 THEN id - 1 ELSE id END AS id, code FROM cat GROUP BY ALL")
def merge_into(u: Universe, spark: SparkSession) -> DataFrame:
    """Links of merged activities point to the survivor; repeated pairs go."""
    target = F.when(F.col("id") % 10 == 1, F.col("id") - 1).otherwise(F.col("id"))
    return u.categories.select(target.alias("id"), "code").distinct()


@modelled("m11_low_confidence_queue", "SELECT id, code, confidence FROM cat WHERE confidence < 0.60 AND id NOT IN (SELECT id FROM act WHERE review_status = 'APPROVED')")
def low_confidence_queue(u: Universe, spark: SparkSession) -> DataFrame:
    queued = u.activities.where("review_status = 'APPROVED'")
    return u.categories.where("confidence < 0.60").join(queued, "id", "left_anti").select("id", "code", "confidence")


@modelled("m14_merge_plan", "SELECT title, min(id) AS survivor, count(*) - 1 AS merged, count(DISTINCT customer) AS customers FROM act GROUP BY title HAVING count(*) > 1")
def merge_plan(u: Universe, spark: SparkSession) -> DataFrame:
    grouped = u.activities.groupBy("title").agg(F.min("id").alias("survivor"), (F.count("*") - 1).alias("merged"), F.countDistinct("customer").alias("customers"))
    return grouped.where("merged > 0")


@modelled("m15_default_stakeholder", "SELECT coalesce(stakeholder_display, 'Students') AS stakeholder, count(*) AS n, count(*) FILTER (stakeholder_display IS NULL) AS filled FROM act GROUP BY 1")
def default_stakeholder_migration(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.groupBy(F.coalesce("stakeholder_display", F.lit("Students")).alias("stakeholder")).agg(F.count("*").alias("n"), F.count_if(F.col("stakeholder_display").isNull()).alias("filled"))


@query(
    "m15b_lookup_diff",
    """WITH seed AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN n_name || '_X' ELSE n_name END AS name FROM nation WHERE n_nationkey > 2), cur AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 20)
SELECT coalesce(s.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'insert' WHEN s.id IS NULL THEN 'extra' WHEN s.name <> c.name THEN 'update' ELSE 'same' END AS action FROM seed s FULL JOIN cur c ON s.id = c.id""",
    base=False,
)
def lookup_diff(spark: SparkSession, d: str) -> DataFrame:
    nation = tables(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    seed = nation.where("id > 2").select("id", F.when(F.col("id") % 4 == 0, F.concat("name", F.lit("_X"))).otherwise(F.col("name")).alias("new"))
    joined = nation.where("id < 20").join(seed, "id", "full")
    action = F.when(F.col("name").isNull(), "insert").when(F.col("new").isNull(), "extra").when(F.col("new") != F.col("name"), "update").otherwise("same")
    return joined.select("id", action.alias("action"))
