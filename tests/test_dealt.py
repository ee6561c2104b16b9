"""Texts that take long to match are dealt over all tasks, however few row groups their files have."""

from __future__ import annotations

import pytest

from brightwake import catalog
from brightwake import queries as _all  # noqa: F401


@pytest.mark.parametrize("name", ["c03_category_scores", "c04_classify_posts", "c11_primary_category", "c14_row_decision", "c15_final_rows"])
def test_documents_are_dealt_before_they_are_matched(name, spark, data):
    """One task matched all texts of a file with one row group."""
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert dealt and all("REPARTITION_BY_COL" in line for line in dealt)
    # The join of two results by id needs no further shuffle.
    assert plan.count("Exchange hashpartitioning") == len(dealt)
