"""Merging of clusters against a plain model; versions, lock and notice."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from brightwake.operators.merging import CHILD_KEYS, HISTORY, SCALARS, duplicates_of, entered_twice, merge_once, merge_plan, merged_facts, repointed
from brightwake.sources.versions import Conflict, Versions, create_once, notify_once, single_flight

FACT = "id long, title string, description string, period string, " + ", ".join(f"{s} string" for s in SCALARS) + ", evidence string, target string, at int"


def made(seed, n=160):
    rng = random.Random(seed)
    some = lambda *v: rng.choice(v)
    facts = [
        (i, some("Open Day", "open day!", "Talk", "", None), some(None, "", "a", "bb", "bb ", "c" * 50), some("1996-97", "1997-98", None), *(some(None, "", "  ", "x", f"{s}{i}") for s in SCALARS[:3]), some(None, "NATION_1"), some(None, "AUTO", " AUTO"), some(None, f"o{i % 5}"), some(None, "", "seen", "told", f"e{i % 4}"), some("t", None), i % 3)
        for i in range(n)
    ]
    categories = [(i, c, rng.random()) for i in range(n) for c in ("LARGE", "PROMO", "OTHER") if rng.random() < 0.4]
    links = [(i, rng.choice(["u1", "u2", None]), i % 7) for i in range(n) for _ in range(rng.randrange(3))]
    return facts, categories, links


def plain_plan(facts, categories):
    groups = {}
    for f in facts:
        key = " ".join(re.sub(r"[^\w\s]", " ", (f[1] or "").lower()).split())
        codes = tuple(sorted({c for i, c, _ in categories if i == f[0] and c != "OTHER"}))
        if key and codes:
            groups.setdefault((key, f[3], codes), []).append(f)
    out = {}
    for group in groups.values():
        if len(group) > 1:
            best = max(group, key=lambda f: (len((f[2] or "").strip()), -f[0]))
            who = {((f[7] or "").strip() or "General", (f[8] or "").strip()) for f in group}
            out.update({f[0]: (best[0], len(group), "merge" if len(who) == 1 else "mixed") for f in group})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_model(spark, seed):
    facts, categories, links = made(seed)
    df, cats = spark.createDataFrame(facts, FACT), spark.createDataFrame(categories, "id long, code string, confidence double")
    plan = plain_plan(facts, categories)
    moved = {i: c for i, (c, _, verdict) in plan.items() if verdict == "merge" and c != i}
    assert moved and any(v == "mixed" for _, _, v in plan.values())
    found = merge_plan(df, cats)
    assert {r["id"]: (r["canonical"], r["members"], r["verdict"]) for r in found.collect()} == plan
    gone = duplicates_of(found)

    by_id, want = {f[0]: list(f) for f in facts}, {}
    for i in sorted(by_id):
        if i not in moved:
            row = list(by_id[i])
            dups = [by_id[d] for d in sorted(d for d, c in moved.items() if c == i)]
            for at in range(4, 10):
                row[at] = next((v for v in [row[at], *(d[at] for d in dups)] if v and v.strip()), row[at])
            texts = list(dict.fromkeys(t for t in [(row[10] or "").strip(), *((d[10] or "").strip() for d in dups)] if t))
            if len(texts) > 1 or (texts and texts[0] != (row[10] or "").strip()):
                row[10] = "\n".join(texts)
            want[i] = tuple(row)
    rows = merged_facts(df, gone).collect()
    assert len(rows) == len(want) and {r[0]: tuple(r) for r in rows} == want

    held = {}
    for i, url, n in sorted(links, key=lambda r: (r[0] in moved, r[0], r[2])):
        held.setdefault((moved.get(i, i), url), n)
    kept = repointed(spark.createDataFrame(links, "id long, url string, row int"), ("url",), gone).collect()
    assert len(kept) == len(held) and {(r["id"], r["url"]): r["row"] for r in kept} == held


def version_of(spark, folder, facts, categories, links):
    tables = {name: spark.createDataFrame([(i, (u or "?")) for i, u, _ in links], f"id long, {key} string") for name, (key,) in CHILD_KEYS.items()}
    tables["categories"] = spark.createDataFrame(categories, "id long, code string, confidence double")
    versions = Versions(spark, folder)
    versions.commit({"facts": spark.createDataFrame(facts, FACT), "history": spark.createDataFrame([], HISTORY), **tables}, versions.latest())
    return versions


def test_second_run_changes_nothing(spark, tmp_path):
    versions = version_of(spark, str(tmp_path), *made(1))
    before = versions.read()["facts"].count()
    assert merge_once(versions) == 1
    after = versions.read()
    told = after["history"].collect()
    assert told and before - after["facts"].count() == len(told) == len({r["duplicate"] for r in told})
    for name in CHILD_KEYS:
        assert after[name].join(after["history"].select(F.col("duplicate").alias("id")), "id").isEmpty()
    assert merge_once(versions) is None and versions.latest() == 1


def test_a_killed_commit_shows_nothing(spark, tmp_path):
    versions = version_of(spark, str(tmp_path), *made(4, 40))
    good = spark.range(3)
    broken = good.select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        versions.commit({"facts": good, "history": broken}, 0)
    assert versions.latest() == 0 and set(versions.read()) == {"facts", "history", *CHILD_KEYS}
    versions.commit({"facts": good}, 0)
    with pytest.raises(Conflict):
        versions.commit({"facts": spark.range(5)}, 0)
    assert versions.read()["facts"].count() == 3


def test_empty_tables(spark, tmp_path):
    assert Versions(spark, str(tmp_path / "none")).read() == {}
    versions = version_of(spark, str(tmp_path), [], [], [])
    assert merge_once(versions) is None


def test_one_large_cluster(spark):
    n = 20_000
    facts = spark.range(n).select("id", F.lit("Same").alias("title"), F.lit("d").alias("description"), F.lit("1996-97").alias("period"), *(F.lit(None).cast("string").alias(s) for s in SCALARS), F.lit("seen").alias("evidence"))
    plan = merge_plan(facts, facts.select("id", F.lit("LARGE").alias("code")))
    assert plan.agg(F.count("*"), F.countDistinct("canonical"), F.max("members")).first() == (n, 1, n)
    assert [tuple(r)[-1] for r in merged_facts(facts, duplicates_of(plan)).collect()] == ["seen"]


def test_single_flight(spark, tmp_path):
    lock = str(tmp_path / "locks" / "weekly")
    with single_flight(spark, lock) as first:
        with single_flight(spark, lock) as second:
            assert first and not second
        with single_flight(spark, lock) as third:
            assert not third
    with single_flight(spark, lock) as again:
        assert again
    assert create_once(spark, lock, json.dumps({"run": "dead", "since": time.time() - 100}))
    with single_flight(spark, lock, stale_after=1000) as held:
        assert not held
    with single_flight(spark, lock, stale_after=10) as held:
        assert held


def test_notice_is_given_once(spark, tmp_path):
    runs = lambda *rows: spark.createDataFrame(list(rows), "run string, state string, finished string, new long")
    one = ("a", "completed", "2024-01-01", 3)
    assert notify_once(spark, str(tmp_path), runs()) is None
    assert notify_once(spark, str(tmp_path), runs(one, ("b", "failed", "2024-01-02", 5), ("c", "completed", "2024-01-03", 0))) == "a"
    assert notify_once(spark, str(tmp_path), runs(one)) is None
    assert notify_once(spark, str(tmp_path), runs(one, ("d", "completed", "2024-01-04", 1))) == "d"


def test_entries_and_bare_child_tables_are_computed_once(spark, data):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    held = entered_twice(spark, data)
    assert not any("Union" in plan(df) for df in (held.facts, *(df for name, df in held.children.items() if name != "stakeholders")))
    moved = spark.createDataFrame([(2, 1), (3, 1)], "id long, canonical long")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (2, None), (4, "a"), (4, "a")], "id long, word string")
    found = repointed(rows, ("word",), moved)
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "a"), (1, None), (4, "a")]
    assert "SortAggregate" not in plan(found)
