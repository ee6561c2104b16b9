"""The training-data operators against brute force, with odd rows of every kind."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brightwake.llm import bitplanes, langid, media, mixing, packing, pii, quality, separators, simhash, toxicity
from brightwake.llm.tokens import TextEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size int, `a b` int, fp string"
LONG = "lorem ipsum dolor. " * 8000
ROWS = [
    (1, "The first text, with a name@mail.org and words.", "en", "a", 1, "x", 1, 1, "q"),
    (1, "The first text, with a name@mail.org and words.", "en", "a", 1, "x", 1, 1, "q"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "b", 0, "x", 1, 1, "q"),
    (4, " \n\t ", "de", "b", 4, "x", 1, 1, "q"),
    (None, "no id here", "en", None, 9, "x", 1, 1, "q"),
    (5, LONG, "es", "a", len(LONG), "x", 1, 1, "q"),
    (6, "ß É <|endoftext|> \x0b x² 日本語 'S don't", "de", "c", 1, "x", 1, 1, "q"),
    (7, "one two", "fr", "c", 1, "x", 1, 1, "q"),
    (8, "one two", "fr", "c", 1, "x", 1, 1, "q"),
]
NONE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], NONE)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (media.media_query, separators.token_counts, pii.pii_query, mixing.mixing_query, packing.pack, bitplanes.bitplane_query, quality.quality_query, langid.language_query, simhash.simhash_query):
        assert f(empty).count() == 0
    assert toxicity.toxicity_query(empty, labels).count() == 0


# toxicity


def test_toxicity_learns_unseen_endings():
    rng = random.Random(3)
    plain = ["".join(rng.choice(("an", "er", "th", "on", "ta", "li")) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    bad = lambda: "grobz" + "".join(rng.choice(("an", "er", "on", "li")) for _ in range(2))

    def text(toxic):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), bad())
        return " ".join(words)

    y = [i % 4 == 0 for i in range(800)]
    model = toxicity.fit([text(t) for t in y[:600]], [int(t) for t in y[:600]])
    scores = np.array(toxicity.Scorer(model).score([text(t) for t in y[600:]]))
    truth = np.array(y[600:])
    assert (scores[truth] >= 0.7).mean() > 0.8 and (scores[~truth] >= 0.7).mean() < 0.05


def test_facts_are_the_greatest_distinct_words():
    values = np.random.default_rng(1).normal(size=100)
    assert toxicity.facts(values, 300).tolist() == pytest.approx([*sorted(values)[: -toxicity.TOP - 1 : -1], np.log(300)])
    usual = np.arange(toxicity.TOP, dtype=float)
    assert toxicity.facts(values[:2], 2, usual).tolist() == pytest.approx([*sorted(values[:2])[::-1], *usual[2:], np.log(2)])


def test_held_out_recall_on_a_real_table(spark):
    """Labels that no word explains are beyond reach: about a tenth of the toxic ones here."""
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    found = toxicity.toxicity_query(spark.read.parquet(f"{data}/documents.parquet"), labels).where("held_out").join(labels, "doc_id")
    share = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.avg("predicted").alias("n")).collect()}
    assert share[1] >= 0.88 and share[0] <= 0.01


def test_repeated_rows_do_not_grow_the_sample(spark, monkeypatch):
    docs = spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("the same text").alias("text")).unionByName(spark.createDataFrame([(4, "another text"), (5, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, 0), (None, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    toxicity.train(docs, labels)
    toxicity.train(docs, labels, characters=15)
    (every, marks), (some, _) = seen
    known = [d for d in (3, 4, 5) if zlib.crc32(str(d).encode()) % 3 != 1]
    assert every == [{3: "the same text", 4: "another text", 5: ""}[d] for d in known] and marks == [int(d == 3) for d in known]
    assert sum(map(len, some)) <= 15


def test_toxicity_rows(spark, odd, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    found = toxicity.toxicity_query(documents.unionByName(odd.select(documents.columns)), labels).collect()
    assert len(found) == documents.count() + len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    kept = toxicity.clean(odd, labels)
    assert kept.columns == odd.columns
    alone = toxicity.toxicity_query(odd, labels.limit(0)).collect()
    assert {r.predicted for r in alone} == {0}


# media


@pytest.mark.parametrize("kind", media.FORMATS)
def test_media_round_trip_and_damage(kind):
    samples = media.padded("text é".encode() * 300)
    stored = media.encoded(samples, kind)
    assert media.sniff(stored)[:2] == (kind, samples)
    assert media.sniff(stored[:-1])[0] == "unknown"
    assert media.sniff(b"junk" + stored + b"tail")[2] == [(kind, 4, len(stored))]


def test_media_query(odd, documents):
    rows = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = collections.Counter()
    for doc, text in texts(rows):
        raw = (text or "").encode()
        pay = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[doc, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:])] += 1
    found = media.media_query(rows).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == want
    assert all(r.media_type in media.FORMATS for r in found)


# token ids


def test_encoder_equals_library(library, documents):
    rng = random.Random(2)
    odd_texts = ["".join(rng.choice("abcDEF'’sStT mlr019 _-.,!?\n\tÀéßĳŁñ×²³½\x0b\x1cİ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for kept in (50, 100_000):
        encoder = TextEncoder(kept=kept)
        for text in [t for _, t in texts(documents)] + odd_texts + ["<|endoftext|>", ""]:
            assert encoder.encode(text) == library(text).tobytes()


@pytest.mark.parametrize("block", [7, 1000, 1 << 20])
def test_separator_scan(odd, library, block):
    found = collections.Counter((r.doc_id, r.n_tokens) for r in separators.token_counts(odd, block).collect())
    assert found == collections.Counter((d, len(library(t))) for d, t in texts(odd))


def test_other_tokenizer_files(odd, tmp_path):
    """Files with other rules go to the library whole, and ids above 65,535 take 32 bits."""
    byte_file = public_tokenizers.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(byte_file)
    own = TextEncoder(byte_file)
    for text in ("Two Words  and\tmore é", "", "don't"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == known.encode(text, add_special_tokens=False).ids
    small = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    small.add_tokens([f"zz{i}" for i in range(17_000)])
    wide = f"{tmp_path}/wide.json"
    small.save(wide)
    rows = odd.select("doc_id", F.concat_ws(" ", "text", F.lit("zz16999 x")).alias("text"))
    found = collections.Counter((r.doc_id, r.n_tokens) for r in separators.token_counts(rows, 1000, wide).collect())
    assert found == collections.Counter((d, len(small.encode(t, add_special_tokens=False).ids)) for d, t in texts(rows))
    assert max(small.encode("zz16999", add_special_tokens=False).ids) >= 1 << 16


def test_unterminated_document(spark):
    blocks = spark.createDataFrame([("f", 0, 4, [1]), ("f", 1, 3, []), ("g", 0, 2, [0, 1])], separators._SCAN)
    found = sorted((r.path, r.ordinal, r.start, r.n_tokens, r.terminated) for r in separators.stitched(blocks).collect())
    assert found == [("f", 0, 0, 1, True), ("f", 1, 2, 5, False), ("g", 0, 0, 0, True), ("g", 1, 1, 0, True)]


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_planes_round_trip(mode, tmp_path):
    rng = np.random.default_rng(4)
    docs = [(i if i % 5 else None, rng.integers(0, 49408, n).astype("<u4")) for i, n in enumerate([0, 1, 5000, 3, 0, 129, 64])]
    uri = f"file://{tmp_path}/x.planes"
    writer = bitplanes.PlaneWriter(uri, mode, block=128)
    for d, ids in docs:
        writer.add(d, ids.tobytes())
    writer.close()
    reader = bitplanes.PlaneReader(uri)
    assert [(d, ids) for d, _, ids in reader.documents()] == [(d, ids.tobytes()) for d, ids in docs]
    flat = np.concatenate([ids for _, ids in docs])
    for start, n in ((0, 5), (127, 2), (4000, 1100), (len(flat) - 1, 1), (3, 0)):
        assert (reader.ids(start, n) == flat[start : start + n]).all()


def test_bitplane_query(odd, library):
    found = bitplanes.bitplane_query(odd).collect()
    rows = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in texts(odd)), key=lambda d: (d is not None, d))
    want = collections.Counter((d, zlib.crc32(np.append(library(t), np.uint32(2)).astype("<u4").tobytes())) for d, t in texts(odd))
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in found) == want
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0


# packing


def brute_cost(places, penalties, length):
    cost = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        options = []
        for i in range(j):
            n = int(places[j] - places[i])
            if n <= length and cost[i] is not None:
                pad = 0 if n == length or n >= 64 and n & (n - 1) == 0 else length - n
                options.append(cost[i] + pad)
        cost[j] = min(options) + packing.WINDOW + int(penalties[j])
    return cost


def test_plan_is_optimal():
    rng = np.random.default_rng(5)
    for length in (256, 4096):
        places = np.concatenate([[0], np.cumsum(rng.integers(1, length // 3, 120))])
        penalties = rng.choice([0, 12, 48], len(places))
        assert packing.plan(places, penalties, length)[0] == brute_cost(places, penalties, length)


def test_planning_horizon_costs_little(monkeypatch):
    """Cuts are final at a horizon; planning everything at once saves less than 0.1 % of the cost."""
    rng, costs = np.random.default_rng(7), []
    docs = [np.append(rng.integers(3, 40_000, n), 2).astype("<u4") for n in np.minimum(rng.lognormal(6, 1, 3000), 30_000).astype(int)]
    ends = np.array([7, 8, 9, *range(100, 1200)], "<u4")
    for horizon in (1 << 19, 1 << 40):
        monkeypatch.setattr(packing, "PLANNED", horizon)
        packer = packing.Packer(0, ends)
        pieces = [p for i, d in enumerate(docs) for p in packer.add(i, d.tobytes())] + list(packer.finish())
        used = collections.Counter()
        for p in pieces:
            used[p[5]] += p[2]
        padding = sum(0 if n & (n - 1) == 0 else packing.LENGTH - n for n in used.values())
        cuts = sum(p[1] + p[2] < p[4] for p in pieces)
        costs.append(padding + packing.WINDOW * len(used) + packing.SENTENCE_CUT * cuts)
    assert sum(map(len, docs)) > 3 * (1 << 19) and costs[0] <= 1.001 * costs[1]


def test_packing(odd, documents, library):
    rows = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    pieces = packing.pack(rows.coalesce(2)).collect()
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    padded = total = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        total += at
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded < 0.02 * total
    whole = {d: np.append(library(t), np.uint32(2)).astype("<u4") for d, t in texts(documents)}
    for doc, ids in whole.items():
        own = sorted((p for p in pieces if p.doc_id == doc and p.doc_tokens == len(ids)), key=lambda p: p.start)
        if len({(p.doc_id, p.start) for p in own}) == len(own) and doc not in {1, 2, 3, 4, 5, 6, 7, 8}:
            assert [p.start for p in own] == list(np.cumsum([0, *(p.length for p in own)])[:-1]) and sum(p.length for p in own) == len(ids)
            assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    assert total == sum(len(library(t)) + 1 for _, t in texts(rows))


# personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_plain_patterns(spark, odd):
    rng = random.Random(6)
    hard = ["".join(rng.choice("ab1290.+-() @%é😀:4") for _ in range(rng.randrange(100))) for _ in range(600)]
    hard += ["1 " * 20000, "a@b.c%x@y.z a" * 500, "1.2.3.4." * 1000, "x" * 50000 + "@", "a.b@" + "c." * 5000 + "d", "4572801887383181", "+1 (414) 555-1791 4572-8018-8738-3181"]
    rows = spark.createDataFrame([(100 + i, t) for i, t in enumerate(hard)], "doc_id long, text string").union(odd.select("doc_id", "text"))
    source = collections.Counter()
    for d, t in texts(rows):
        spans = plain_spans(t or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        source[d, hashlib.sha256(listed.encode()).hexdigest(), *(sum(k == x[3] for x in spans) for k in PLAIN)] += 1
    found = pii.pii_query(rows).collect()
    assert collections.Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in found) == source
    for r in found:  # base spans are among all spans
        listed = [x for x in r.spans.split(",") if x.split(":")[0] in PLAIN]
        assert hashlib.sha256(",".join(listed).encode()).hexdigest() == r.base_sha256


def test_labelers_and_redaction(spark, odd):
    text = 'x token = "bc0d31ba76f17e56642e8bc0d31ba76f" call 234-555-1234 me@x.org end'
    rows = odd.limit(1).select(*(F.lit(text).alias("text") if c == "text" else f"`{c}`" for c in odd.columns))
    clean = pii.redact(rows).first()
    assert clean.text == 'x token = "[SECRET]" call [LOCAL_PHONE] [EMAIL] end' and clean["a b"] == 1
    model = pii.fit_labelers({(0, (1, 1, 1)): 50, (0, (-1, -1, -1)): 50, (0, (1, -1, 1)): 5, (0, (0, 0, 0)): 10})
    assert model.probability(0, (1, 1, 1)) > 0.9 > 0.1 > model.probability(0, (-1, -1, -1))
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == len(ROWS)


# mixing


def plain_targets(sizes):
    order = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    out, free, left = dict.fromkeys(order, 0.0), {k for k in order if sizes[k]}, float(sum(sizes.values()))
    while free:
        share = sum(weight[k] for k in free)
        over = [k for k in free if weight[k] * left / share > 3 * sizes[k]]
        if not over:
            out |= {k: weight[k] * left / share for k in free}
            break
        for k in over:
            out[k] = 3.0 * sizes[k]
            left -= out[k]
            free.discard(k)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", None, "Z"]
    shares = [rng.choice((1, 5, 60)) for _ in names]
    rows = [(1000 * at + i, " ".join(["w"] * rng.randrange(0, 80)), s) for at, (s, k) in enumerate(zip(names, shares, strict=True)) for i in range(k * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixing_query(df).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets({s: sizes[s] for s in names})
    taken = collections.Counter()
    for r in found:
        source = names[r.doc_id // 1000]
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(40, 0.01 * want[s]) for s in names)
    again = mixing.mixing_query(df.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


@pytest.mark.parametrize("seed", [4, 5])
def test_rates_solve_the_dual(spark, seed):
    """The rates meet the targets and have the form min(3, exp(x size / mean)), which makes them the closest to 1 in relative entropy."""
    rng = random.Random(seed)
    rows = [(s, rng.randrange(1, 400), rng.randrange(1, 30)) for s in ("a", "b", None) for _ in range(60)]
    histogram = spark.createDataFrame(rows, "source string, size long, n long").groupBy("source", "size").agg(F.sum("n").alias("n"))
    per_source = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    share = F.when(F.col("source") == "a", 0.4).when(F.col("source") == "b", 2.6).otherwise(3.0)
    aims = per_source.withColumn("target", share * F.col("source_size"))
    found = {r.source: r for r in mixing.solve(histogram, aims).collect()}
    assert found[None].x is None
    for a in aims.where("source is not null").collect():
        x, mean = found[a.source].x, found[a.source].mean
        got = sum(r.n * r["size"] * min(3.0, np.exp(x * r["size"] / mean)) for r in histogram.where(F.col("source") == a.source).collect())
        assert got == pytest.approx(a.target, rel=1e-6)


def test_a_source_at_its_cap_takes_all_three_times(spark):
    rows = [(i, " ".join(["w"] * (1 if i % 2 else 90)), "a") for i in range(40)] + [(100 + i, "w " * 4000, "b") for i in range(40)]
    found = mixing.mixing_query(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.taken == 3 * r["size"] for r in found if r.doc_id < 100)


def test_many_equal_rows_are_split(spark):
    rows = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.when(F.col("id") < 4990, "a").otherwise("b").alias("source"))
    plan = mixing.planned(rows, F.xxhash64("text"))
    assert plan.count() == 5000
    runs = [sorted(map(str, mixing.mixing_query(rows.repartition(n)).collect())) for n in (3, 7)]
    assert runs[0] == runs[1]
    taken = sum(r.copies * r["size"] for r in plan.where("source = 'a'").collect())
    assert taken == pytest.approx(plan.where("source = 'a'").first().target, rel=0.01)
    assert mixing.mixed(rows).count() == plan.agg(F.sum("copies")).first()[0]


def test_mixed_rows(odd):
    out = mixing.mixed(odd)
    plan = mixing.mixing_query(odd).agg(F.sum("taken")).first()[0]
    assert out.columns == odd.columns and out.select(F.sum(mixing.sizes())).first()[0] == plan


# quality


def test_quality_equals_sql(spark, odd, documents, tmp_path):
    extra = [(900, "a b c " * 60), (901, "a b c a b c x"), (902, "same\nsame\n\n \nsame\nother"), (903, "#*$%&|<> " * 9), (904, "the of and to in " * 20 + "end")]
    rows = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(extra, "doc_id long, text string"))
    path = f"{tmp_path}/d.parquet"
    rows.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select doc_id::BIGINT AS doc_id, text from '{path}'")
    asked = con.execute(quality.oracle_sql())
    names = [c[0] for c in asked.description]
    found = quality.quality_query(rows)
    assert sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, asked.fetchall()))


def test_repeated_words_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for i in range(200)]
    for r in quality.counts(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = r.text.split()
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert r.n_repeat_words == len({i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)})


# languages


def test_languages(odd, documents):
    rows = documents.unionByName(odd.select(documents.columns))
    found = {(r.doc_id, r.lang_pred): r for r in langid.language_query(rows).collect()}
    assert (2, "und") in found and (3, "und") in found and (4, "und") in found
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [(d, p) for (d, p), r in found.items() if r.held_out and d in truth and d > 10]
    assert np.mean([truth[d] == p for d, p in held]) > 0.9
    assert {r.lang_pred for r in langid.language_query(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_presence_is_a_set_kernel():
    matrix, there = langid.presence(["abab", "ABAB!!", "", "12 3", "xyz"])
    assert there == [True, True, False, False, True] and float(matrix[0] @ matrix[1]) == pytest.approx(1) and float(matrix[0] @ matrix[4]) < 0.2


# near duplicates


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_masks_cover_every_pair():
    masks, rng = simhash.covering_masks(), random.Random(9)
    for _ in range(5000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
        assert any(not bits & m for m in masks)


def test_simhash_query(odd, documents):
    rows = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    source = texts(rows)
    fps = {(d, t): plain_fingerprint(t) for d, t in source}
    root = plain_components(set(fps.values()))
    least = {}
    for (d, _), f in fps.items():
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = collections.Counter((d, f"{fps[d, t]:016x}", least.get(root[fps[d, t]])) for d, t in source)
    assert collections.Counter(tuple(r) for r in simhash.simhash_query(rows).collect()) == want


@pytest.mark.parametrize(("block", "dense"), [(1024, 16384), (4, 16384), (4, 6)])
def test_components_in_every_tier(spark, monkeypatch, block, dense):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(10)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for _ in range(3):
        seed = rng.getrandbits(64)
        cluster = [seed]
        for _ in range(25):
            cluster.append(rng.choice(cluster) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
        fps.update(cluster)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = {r.fp: r.root for r in simhash.components(simhash.radius_links(df)[0]).collect()}
    want = plain_components(fps)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    whole = {simhash._signed(f): found.get(simhash._signed(f), simhash._signed(f)) for f in fps}
    assert groups(whole) == groups({simhash._signed(f): simhash._signed(r) for f, r in want.items()})


def test_a_fingerprint_of_many_documents_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 8)
    docs = spark.range(300).select("id", F.when(F.col("id") % 3 < 2, "the same few words here").otherwise(F.concat_ws(" ", "id", F.col("id") * 7, F.col("id") * 13, F.col("id") * 31)).alias("text")).withColumnRenamed("id", "doc_id")
    found = {r.doc_id: r.component_id for r in simhash.simhash_query(docs).collect()}
    assert len(found) == 300 and all(found[d] == 0 for d in range(300) if d % 3 < 2)
    classes = spark.createDataFrame([(5, 20), (6, 1)], "fp long, n long")
    rows = spark.createDataFrame([(i, 5) for i in range(20)] + [(99, 6)], "doc_id long, fp long")
    assert sorted(r.doc_id for r in simhash.split_join(rows, classes, 21).collect()) == [*range(20), 99]


def test_one_document_of_each_group_stays(odd):
    kept = simhash.keep_one_per_component(odd)
    assert kept.columns == odd.columns
    found = sorted(((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()), key=str)
    assert [d for d, t in found if not (t or "").split()] == [2]
    assert [d for d, t in found if t == "one two"] == [7] and len(found) == len({plain_fingerprint(t) for _, t in texts(odd)})
