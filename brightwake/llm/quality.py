"""Quality rules: one threshold table compiled into one Spark projection.

Counts are taken from the whole text with built-in functions only. Words are
runs of ``[^\\x20\\x09-\\x0D]``. A document fails the base rule if it has fewer
than 50 words, or if more than half of its words lie in 3-word windows that
occur twice or more in it. The method's rules are ratios of two counts held
between bounds given in per cent, so that verdicts are exact integer
comparisons.

Defined results: null text counts as no words (all counts 0, base rule failed,
not kept); empty text likewise; null ``doc_id`` rows and repeated rows are kept
as rows; an empty table gives an empty result; other columns are ignored by the
query. Texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages that the rules expect.
STOP_WORDS = {
    "en": "a an and are as at be by for from has in is it of on or that the this to was with",
    "de": "auf das dem den der des die ein eine für im in ist mit nicht sich sie und von zu",
    "fr": "au aux ce dans de des du en est et il la le les pas pour que qui sur un une",
    "es": "al con de del el en es la las lo los no para por que se su un una y",
}


@dataclass(frozen=True)
class Rule:
    """100 * ``part`` must lie between ``low`` and ``high`` times ``whole``."""

    name: str
    part: str
    whole: str
    low: int
    high: int


#: Bounds in per cent. Mean word length, symbols a word, function words a word, repeated lines a line.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", 0, 30),
    Rule("stop_words", "n_stop_words", "n_words", 2, 100),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0, 50),
)
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_window_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more among ``words``."""

    def window(w: Column, i: Column) -> Column:
        return F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("k"), i.alias("i"))

    def twice(s: Column) -> Column:
        last = F.size(s) - 1
        at = F.filter(F.sequence(F.lit(0), last), lambda k: F.coalesce(s[k]["k"] == F.get(s, k - 1)["k"], F.lit(False)) | F.coalesce(s[k]["k"] == F.get(s, k + 1)["k"], F.lit(False)))
        return F.sort_array(F.transform(at, lambda k: s[k]["i"]))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).cast("long").alias("n"), x.alias("last"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: window(w, i))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_let(F.sort_array(windows), lambda s: covered(twice(s))))

    return _let(words, counted)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that rules compare."""
    body = F.coalesce(F.col(text), F.lit(""))
    stops = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.withColumn("__words", F.filter(F.split(body, GAP), lambda w: w != ""))
    long = lambda c: c.cast("long")
    return split.withColumns(
        {
            "n_words": long(F.size("__words")),
            "word_chars": long(F.length(F.regexp_replace(body, GAP, ""))),
            "n_symbols": long(F.length(body) - F.length(F.translate(body, SYMBOLS, ""))),
            "n_lines": long(F.size(lines)),
            "n_dup_lines": long(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))),
            "n_stop_words": long(F.size(F.filter("__words", lambda w: F.lower(w).isin(stops)))),
            "n_repeat_words": repeated_window_words(F.col("__words")),
        }
    ).drop("__words")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean column: true where every rule holds."""
    verdict = F.lit(True)
    for r in rules:
        verdict &= (100 * F.col(r.part)).between(r.low * F.col(r.whole), r.high * F.col(r.whole))
    return verdict


def quality_query(docs: DataFrame) -> DataFrame:
    found = counts(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & compiled()).alias("kept"), "n_lines", "n_stop_words")


def oracle_sql() -> str:
    """The same in DuckDB SQL."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    rules = " AND ".join(f"100 * {r.part} BETWEEN {r.low} * {r.whole} AND {r.high} * {r.whole}" for r in RULES)
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM base)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + d)::BIGINT AS n FROM twice, (VALUES (0), (1), (2)) AS t(d) GROUP BY r
), lines AS (
  SELECT r, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
  FROM (SELECT r, unnest(string_split(body, chr(10))) AS line FROM base) WHERE regexp_matches(line, '{word}') GROUP BY r
), counted AS (
  SELECT b.doc_id, len(b.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(b.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(b.body) - length(translate(b.body, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n_lines, 0)::BIGINT AS n_lines,
    len(list_filter(b.w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words
  FROM base b LEFT JOIN covered c USING (r) LEFT JOIN lines l USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AS base_failed,
  (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND {rules}) AS kept, n_lines, n_stop_words
FROM counted"""
