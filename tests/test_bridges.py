"""Plans over the model's bridges: what a task holds follows its groups, not all pairs of ids and codes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brightwake import catalog
from brightwake.operators import aggregates, audit
from brightwake.plans.model import Universe, universe


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_bridge_is_dealt_once(spark, data):
    joined = universe(spark, data).categories.groupBy("id").agg(F.count("*").alias("n"))
    assert plan(joined).count("Exchange hashpartitioning(id") == 1


@pytest.mark.parametrize("name", ["a15_category_department_matrix", "m10_merge_all"])
def test_no_distinct_over_all_ids(name, spark, data):
    assert "distinct" not in plan(catalog.queries()[name](spark, data))


def test_repeated_links_and_null_codes_count_once(spark):
    links = spark.createDataFrame([(10, "A"), (11, "A"), (11, None), (10, None), (20, "B"), (20, "B")], "id long, code string")
    u = Universe(links, links, links, links, links)
    assert {tuple(r) for r in audit.merge_all(u, spark).collect()} == {(k, 3, 2) for k in ("categories", "departments", "stakeholders")}
    told = {tuple(r) for r in aggregates.category_department_matrix(u, spark).collect()}
    assert told == {("A", "A", 2), ("A", None, 2), (None, "A", 2), (None, None, 2), ("B", "B", 1)}
