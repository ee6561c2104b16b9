"""Why texts can't be judged, on odd texts, against the query's own DuckDB SQL."""

from __future__ import annotations

import duckdb

from brightwake import catalog
from brightwake import queries as _all  # noqa: F401

FILL = " and more of the same" * 6
TEXTS = [
    None, "", " ", "\u00a0", "\u3000 \u2003", "\n", "\t ", "\u200b", "\u2028", "\x1c",
    "http://a", " http://a", "http://a ", "http://a\n", "http://a\x0bb", "http://a\u2028b", "http://a b", "x\nhttp://a", "https://\u00a0",
    "1999 2000", "1999  2000", "1999\n2000\n", "1999 2000 2001", "1999-2000", "19990 2001", "1999\u00e92000x2001", "\u0661999 2001  2002", "1999 1999  1999",
    "\u0ba4\u0bae\u0bbf\u0bb4\u0bcd \u0bae\u0bca\u0bb4\u0bbf \u0ba8\u0ba9\u0bcd\u0bb1\u0bc1", "\u0928\u092e\u0938\u094d\u0924\u0947" + FILL,
    "THE end", "x" * 99 + "\u00a0\u00a0", "x" * 100, "\u00e9" * 99 + "\n", "short", FILL,
]


def test_odd_texts_equal_duckdb(spark, tmp_path):
    rows = [(3 * i + k, t) for i, t in enumerate(TEXTS) for k in (0, 1)] + [(None, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["c10_unclear_reason"]).fetchall(), key=repr)
    found = sorted(map(tuple, catalog.queries()["c10_unclear_reason"](spark, str(tmp_path)).collect()), key=repr)
    assert [(a, b) for a, b in zip(found, want, strict=True) if a != b] == []
    assert {r for _, r in want} == {"url_only", "text_is_url", "multi_year", "link_less_weak", "title_only", "low_evidence_event_like"}
