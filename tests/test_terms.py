"""Terms of any script, without a least frequency."""

from __future__ import annotations

import math
from collections import Counter

from brightwake.operators import more


def test_tfidf_of_words_and_pairs(spark):
    texts = {1: "Über den Fluss, den Fluss", 2: "den rare2 x", 3: None}
    words = {1: "über den fluss den fluss".split(), 2: ["den", "rare2"], 3: []}
    tf = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]) for i, w in words.items()}
    df = Counter(t for c in tf.values() for t in c)
    raw = {(i, t): n * (math.log(4 / (1 + df[t])) + 1) for i, c in tf.items() for t, n in c.items()}
    norm = {i: math.sqrt(sum(v * v for (j, _), v in raw.items() if j == i)) for i in tf}
    found = {(r.id, r.term): r for r in more.tfidf(spark.createDataFrame(list(texts.items()), "id long, text string")).collect()}
    assert found.keys() == raw.keys()
    for (i, t), r in found.items():
        assert (r.tf, r.df) == (tf[i][t], df[t])
        assert abs(r.weight - raw[i, t] / norm[i]) < 1e-12


def test_terms_are_counted_before_they_are_shuffled(spark):
    rows = [(1, "a1 b1 a1 b1"), (1, "b1 a1"), (2, None), (3, "!"), (4, "zz")]
    counts = more.counted_terms(spark.createDataFrame(rows, "id long, text string"))
    assert sorted(map(tuple, counts.collect())) == [(1, "a1", 3), (1, "a1 b1", 2), (1, "b1", 3), (1, "b1 a1", 2), (4, "zz", 1)]
    plan = more.tfidf(spark.createDataFrame(rows, "id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan
