"""Runs over posts with five keys against one post after the other."""

from __future__ import annotations

import random
import re

import pytest

from brightwake.streaming import sync


def model(runs, staged):
    """post -> reason, by the definition."""
    ids, urls, refs, staged_urls, texts = set(), set(), set(), set(), set()

    def keys(post, url, text):
        found = re.search("/([0-9]+)", url or "")
        return str(post), url, found and found.group(1), " ".join(re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split())

    for p in staged:
        _, url, ref, text = keys(*p)
        refs.add(ref), staged_urls.add(url), texts.add(text)
    for known in (refs, staged_urls, texts):
        known -= {None, ""}
    out = {}
    for run in runs:
        for p in sorted(run):
            i, url, ref, text = keys(*p)
            out[p[0]] = "ingested_id" if i in ids else "ingested_url" if url and url in urls else "staged_id" if ref in refs else "staged_url" if url and url in staged_urls else "text" if text and text in texts else None
            if out[p[0]] is None and (url or text):
                ids.add(i)
                for held, value in ((urls, url), (staged_urls, url), (refs, ref), (texts, text)):
                    if value:
                        held.add(value)
    return out


def made(n, seed=2):
    rng = random.Random(seed)
    posts = [(i, rng.choice([None, f"https://x.org/a{rng.randrange(n // 3)}", f"https://x.org/{rng.randrange(n // 2)}", f"https://x.org/b/{rng.randrange(9 * n)}"]), rng.choice(["", f"title {rng.randrange(n // 2)}", f"a meeting of {i}"])) for i in range(n)]
    posts += [(n + 6 - n % 7 + 1, "https://x.org/only-staged", ""), (n + 6 - n % 7 + 2, "https://x.org/only-staged", "some words")]
    staged = [(i, u, t) for i, u, t in posts if i % 7 == 0]
    return [[p for p in posts if p[0] % 7 and p[0] % 2 == k] for k in range(2)], staged


def arrive(spark, folder, posts, k):
    spark.createDataFrame(posts, sync.POST).coalesce(2).write.parquet(f"{folder}/arrived/{k}")
    return spark.readStream.schema(sync.POST).option("recursiveFileLookup", True).parquet(f"{folder}/arrived")


def test_reasons_of_two_runs(spark, tmp_path):
    runs, staged = made(120)
    folder = f"file://{tmp_path}"
    for k, posts in enumerate(runs):
        sync.sync(arrive(spark, folder, posts, k), folder, spark.createDataFrame(staged, sync.POST))
    got = sync.decisions(spark, folder).collect()
    want = model(runs, staged)
    assert {r.post: r.reason for r in got} == want
    assert {"ingested_url", "staged_id", "staged_url", "text", None} <= set(want.values())
    bad = {p[0] for run in runs for p in run if not p[1] and not p[2]}
    assert {r.post for r in got if r.status == "ERROR"} == bad
    table = {r.run: r for r in sync.runs(spark, folder).collect()}
    assert [table[k + 1].fetched for k in range(2)] == list(map(len, runs))
    assert [table[k + 1].new_posts for k in range(2)] == [sum(want[p[0]] is None and p[0] not in bad for p in run) for run in runs]
    assert [table[k + 1].errors for k in range(2)] == [sum(p[0] in bad for p in run) for run in runs]
    assert all(t.status == "partial" and t.fetched == t.new_posts + t.duplicates + t.errors for t in table.values())
    assert sync.cursor(spark, folder) == max(p[0] for run in runs for p in run)


@pytest.mark.parametrize("step", ["decided", "written", "kept"])
def test_a_killed_run_is_run_again(spark, tmp_path, step):
    runs, staged = made(40, 5)
    folder = f"file://{tmp_path}"

    def fail(at):
        if at == step:
            raise RuntimeError("killed")

    staged = spark.createDataFrame(staged, sync.POST)
    sync.sync(arrive(spark, folder, runs[0], 0), folder, staged)
    posts = arrive(spark, folder, runs[1], 1)
    with pytest.raises(Exception, match="killed"):
        sync.sync(posts, folder, staged, fail)
    sync.sync(posts, folder, staged)
    assert {r.post: r.reason for r in sync.decisions(spark, folder).collect()} == model(runs, made(40, 5)[1])
    assert [(r.run, r.status != "failed") for r in sync.runs(spark, folder).orderBy("run").collect()] == [(1, True), (2, False), (3, True)]
    # Nothing new: nothing changes.
    sync.sync(posts, folder, staged)
    assert sync.decisions(spark, folder).count() == sum(map(len, runs))


def test_state_is_asked_once_a_key_and_rows_need_no_frames():
    from pyspark.sql import Row

    class Store:
        def __init__(self, held):
            self.held, self.calls = held, []

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

    row = lambda post, bits: Row(kind="id", key="7", post=post, place=1, url=None, text=None, bits=bits)
    for held, rows, after, calls, told in ((None, [row(7, 0)], None, ["get"], [7]), ((1,), [row(7, 0)], (1,), ["get"], [7, -1]), (None, [row(-1, 1), row(-1, 2)], (3,), ["get", "update"], [])):
        keys = sync.KnownKeys()
        keys._known = store = Store(held)
        found = list(keys.handleInputRows(("id", "7"), iter(rows), None))
        assert (store.held, store.calls, [r["post"] for r in found]) == (after, calls, told)
