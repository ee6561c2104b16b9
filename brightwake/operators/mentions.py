"""Members of a dimension that texts mention, for any number of members.

Names go in blocks to automata, one pass over a text for all names of a block, and a member's
names lie in one block. Texts that name nobody are compared with the names as strings: a
pair of lengths more than eight times apart cannot reach the score, and the rest meet in
chunks of like length with an upper bound first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored_table
from .pairing import chunked, near_pairs

#: Names in a block; an automaton of so many takes about 100 MB.
BLOCK = 100_000
#: Least score of a name that is only similar.
SIMILAR = 80.0
SPANS = "row long, id long, spans array<struct<start:int,`end`:int,code:string,term:string>>, rest string"


def named(members: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(code, rank, term): the names of members (code) in lower case, the code itself first, then its aliases (code, rank, term)."""
    own = members.select("code").distinct().select("code", F.lit(0).alias("rank"), F.lower("code").alias("term"))
    return (own if aliases is None else own.union(aliases.select("code", F.col("rank") + 1, F.lower("term")))).where("term <> ''")


def _blocks(names: DataFrame) -> Iterator[dict[str, list[tuple[str, int]]]]:
    """Term -> (code, rank) of the members of one block; blocks come one at a time and end with a member."""
    block: dict[str, list[tuple[str, int]]] = {}
    n, last = 0, None
    for r in names.orderBy("code", "rank", "term").toLocalIterator():
        if n >= BLOCK and r["code"] != last:
            yield block
            block, n = {}, 0
        block.setdefault(r["term"], []).append((r["code"], r["rank"]))
        n, last = n + 1, r["code"]
    if block:
        yield block


def outer(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The spans (start, end, code, term) that lie in no longer one. Sorted by start, the longest first, a span is within one before it if that one reaches as far."""
    kept, first, last = [], 0, 0  # of the span that ends last so far
    for s in sorted(spans, key=lambda s: (s[0], -s[1], *s[2:])):
        if s[1] > last or s[1] - s[0] >= last - first:
            kept.append(s)
        if s[1] > last:
            first, last = s[:2]
    return kept


def _spans_array(spans: list[tuple[int, int, str, str]], ends: list[int]) -> pa.ListArray:
    """The spans of all rows of a batch; a row's spans begin and end where ``ends`` says."""
    kinds = {"start": pa.int32(), "end": pa.int32(), "code": pa.string(), "term": pa.string()}
    columns = zip(*spans, strict=True) if spans else [()] * len(kinds)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds)))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, spans) with the outer ones of their spans."""
    for batch in batches:
        kept, ends = [], [0]
        for spans in batch.column(2):
            kept.extend(outer([(s["start"], s["end"], s["code"], s["term"]) for s in spans.as_py()]))
            ends.append(len(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _spans_array(kept, ends), pa.nulls(batch.num_rows, pa.string())], names=["row", "id", "spans", "rest"])


def _spans_of(records: DataFrame, block: dict[str, list[tuple[str, int]]], most: int) -> DataFrame:
    """(row, id, spans, rest) of records (row, id, text): the members of the block that a text names, by the first of its names that occurs.

    Texts of at most ``most`` characters that name nobody have no spans but ``rest``, the
    text in lower case; longer ones are left out.
    """
    sent = records.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, automaton = sent.value, ahocorasick.Automaton()
        for term in held:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for batch in batches:
            rows, ids, ends, found, rest = [], [], [0], [], []
            for row, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                body = text.as_py() or ""
                places: dict[str, list[int]] = {}
                for last, term in automaton.iter(body):
                    places.setdefault(term, []).append(last + 1)
                best: dict[str, tuple[int, str]] = {}
                for term in places:
                    for code, rank in held[term]:
                        best[code] = min(best.get(code, (rank, term)), (rank, term))
                found.extend(outer([(end - len(term), end, code, term) for code, (_, term) in best.items() for end in places[term]]))
                if best or len(body) <= most:
                    rows.append(row)
                    ids.append(i)
                    ends.append(len(found))
                    rest.append(None if best else body)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), _spans_array(found, ends), pa.array(rest, pa.string())], names=["row", "id", "spans", "rest"])

    return records.select("row", "id", F.lower("text")).mapInArrow(run, SPANS)


def mentions(records: DataFrame, names: DataFrame) -> DataFrame:
    """(id, code, start, term, score) of records (id, text) by ``names`` (code, rank, term).

    Each member is named by the first of its names that occurs, at all its places; a place
    within a longer one is none. A text that names nobody has the member whose first name
    scores most, if that is ``SIMILAR`` (without a start; of equal ones the first code).
    Null and blank texts mention nobody; repeated ids count as one text each.
    """
    own = records.select(F.monotonically_increasing_id().alias("row"), "id", "text").where("trim(text) <> ''")
    names = stored_table(names.select("code", "rank", "term"), "names")
    first = names.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("rank", "term"))).where("place = 1")
    titles = first.groupBy(F.col("term").alias("title")).agg(F.min("code").alias("code")).select(F.xxhash64("title").alias("id"), "title", "code")
    n, most = names.count(), 8 * (titles.agg(F.max(F.length("title"))).first()[0] or 0)
    if not n:
        return own.select("id", F.lit("").alias("code"), F.lit(None).cast("int").alias("start"), F.lit("").alias("term"), F.lit(0.0).alias("score")).limit(0)
    if n <= BLOCK:
        # One block: a text that it finds nobody in is unnamed, and goes on from here without a join.
        (block,) = _blocks(names)
        found = stored_table(_spans_of(own, block, most), "spans")
        rest = found.select("id", F.col("rest").alias("title"))
    else:
        own = stored_table(own, "mention-texts")
        every = reduce(DataFrame.union, (_spans_of(own, block, -1) for block in _blocks(names)))
        # A block's own outer spans may lie in longer ones of other blocks.
        found = stored_table(every.groupBy("row", "id").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(_merged, SPANS), "spans")
        rest = own.join(found.select("row"), "row", "left_anti").select("id", F.lower("text").alias("title")).where(F.length("title") <= most)
    exact = found.select("id", F.explode("spans").alias("m")).select("id", "m.code", "m.start", "m.term", F.lit(100.0).alias("score"))
    open_ = stored_table(rest.where("title is not null").withColumn("key", F.xxhash64("title")), "unnamed")
    if open_.isEmpty():
        return exact
    pairs = near_pairs(chunked(open_.select(F.col("key").alias("id"), "title").distinct(), "unnamed"), chunked(titles.select("id", "title"), "names"), SIMILAR)
    scored = pairs.join(titles.select(F.col("id").alias("b"), "code", F.col("title").alias("term")), "b")
    best = scored.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("minus"), "code", "term")).alias("m"))
    similar = open_.join(best, F.col("key") == F.col("a")).select("id", "m.code", F.lit(None).cast("int").alias("start"), "m.term", (-F.col("m.minus")).alias("score"))
    return exact.union(similar)
