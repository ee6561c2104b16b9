"""Blocks of text that may report an activity, and titles for them.

Sentences and entries of numbered lists are split on the JVM; whole texts are read. A block
that occurs again in its text, but for case and punctuation, counts once, at its first
place; that is a grouping by text and key, so no list of a text's blocks is compared with
itself. Null and empty texts have no blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import query, tables

#: Nouns that name an activity.
ACTIVITY_TERMS = (
    "workshop", "seminar", "training", "fdp", "conference", "competition", "tournament", "sports", "ncc", "nss", "camp", "marathon", "hackathon", "webinar", "activity",
    "event", "award", "prize", "achievement", "mou", "collaboration", "outreach",
)
#: Verbs that report one.
ACTION_TERMS = ("organized", "organised", "conducted", "held", "celebrated", "participated", "attended", "achieved", "won", "secured", "awarded", "received", "signed", "completed", "launched")
#: Verbs before which a title ends, and titles that say nothing.
TITLE_ENDS = ("was", "were", "is", "are", "has", "have", "organized", "organised", "conducted", "held", "celebrated", "participated", "won", "secured", "awarded")
GENERIC_TITLES = ("home", "about", "contact", "department", "activities", "quick links", "major activities")
#: Lengths of sentences, of list entries and of titles.
SENTENCE, ENTRY, TITLE = 24, (12, 400), 220

_YEAR = r"(?U)^\s*20\d{2}\."
_SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"
_LIST_MARK = r"(?U)\b[1-9][0-9]?[.)]\s+"


def _single_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _names(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text has one of the terms as whole words."""
    return F.lower(text).rlike(r"(?U)\b(?:" + "|".join(terms) + r")\b") if terms else F.lit(False)


def sentences(text: Column) -> Column:
    """Sentences: a stop, white space, then a capital or digit. A year with a stop that leads the text belongs to what follows."""
    lead = F.regexp_extract(text, _YEAR, 0)
    rest = F.split(F.substring(text, F.length(lead) + 1, F.length(text)), _SENTENCE_END)
    return F.transform(rest, lambda s, i: _single_spaces(F.when(i == 0, F.concat(lead, s)).otherwise(s)))


def entries(text: Column) -> Column:
    """What stands between the marks (1 to 99 with stop or bracket) of numbered lists, and before the first; nothing without a mark."""
    return F.when(text.rlike(_LIST_MARK), F.transform(F.split(text, _LIST_MARK), _single_spaces)).otherwise(F.array().cast("array<string>"))


def activity_blocks(texts: DataFrame, activity: Sequence[str] = ACTIVITY_TERMS, action: Sequence[str] = ACTION_TERMS) -> DataFrame:
    """(id, place, block) from (id, text): sentences of 24 characters with a term, then list entries of 12 to 400 with a noun, each once.

    ``place`` counts blocks before repeated ones go. Rows of one id are one text, and their blocks count once.
    """
    text = F.coalesce("text", F.lit(""))
    said = F.filter(sentences(text), lambda s: (F.length(s) >= SENTENCE) & (_names(s, action) | _names(s, activity)))
    listed = F.filter(entries(text), lambda s: F.length(s).between(*ENTRY) & _names(s, activity))
    rows = texts.select("id", F.posexplode(F.concat(said, listed)).alias("place", "block"))
    key = F.sha2(F.regexp_replace(F.lower("block"), r"(?U)\W+", ""), 256).alias("key")
    first = rows.groupBy("id", key).agg(F.min(F.struct("place", "block")).alias("first"))
    return first.select("id", "first.place", "first.block")


def block_title(block: Column) -> Column:
    """What comes before the first verb, without leading article and a tail that gives a date or place by number.

    Where that says nothing or is longer than 220 characters, the block's first 220 without their last word.
    """
    head = F.split(block, r"(?iU)\b(?:" + "|".join(TITLE_ENDS) + r")\b", 2)[0]
    bare = F.regexp_replace(F.trim(head), r"(?i)^(?:the|a|an|as part of)\s+", "")
    short = F.regexp_replace(F.regexp_replace(bare, r"(?iU)\s+(?:on|at|from)\s+\d.*$", ""), r"^[ \-:;,]+|[ \-:;,]+$", "")
    useless = (short == "") | F.lower(short).isin(*GENERIC_TITLES) | (F.length(short) > TITLE)
    return F.when(useless, F.regexp_replace(F.left(block, F.lit(TITLE)), " [^ ]*$", "")).otherwise(short)


#: The documents' words are made up, so the query takes these for its terms.
_NOUNS, _VERBS = ("the", "tion"), ("is", "are")
_NAMED = r"regexp_matches(lower(s), '(^|[^\pL\pN_])({})($|[^\pL\pN_])')"


@query(
    "f26_activity_blocks",
    rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '2024. ' || replace(text, chr(10), chr(10) || '7) ') ELSE text END AS text FROM documents WHERE text IS NOT NULL
), l AS (SELECT doc_id, text, regexp_extract(text, '^\s*20\d\d\.') AS lead FROM t
), b AS (SELECT doc_id, list_concat(
    list_filter(list_transform(string_split(lead || regexp_replace(substr(text, length(lead) + 1), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))),
      lambda s: length(s) >= {SENTENCE} AND {_NAMED.format("|".join(_NOUNS + _VERBS))}),
    list_filter(CASE WHEN regexp_matches(text, '\b[1-9][0-9]?[.)]\s+') THEN list_transform(string_split_regex(text, '\b[1-9][0-9]?[.)]\s+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))) ELSE [] END,
      lambda s: length(s) BETWEEN {ENTRY[0]} AND {ENTRY[1]} AND {_NAMED.format("|".join(_NOUNS))})) AS blocks FROM l
), e AS (SELECT doc_id, unnest(blocks) AS block, generate_subscripts(blocks, 1) - 1 AS place FROM b)
SELECT doc_id, min(place) AS place, arg_min(block, place) AS block FROM e GROUP BY doc_id, regexp_replace(lower(block), '[^\pL\pN_]+', '', 'g')""",
    base=False,
)
def activity_blocks_query(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all documents; every tenth is led by a year and has its lines numbered."""
    numbered = F.concat(F.lit("2024. "), F.replace("text", F.lit("\n"), F.lit("\n7) ")))
    texts = tables(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, numbered).otherwise(F.col("text")).alias("text"))
    return activity_blocks(texts, _NOUNS, _VERBS).withColumnRenamed("id", "doc_id")


@query("f27_block_titles")
def block_titles_query(spark: SparkSession, d: str) -> DataFrame:
    """A title for each block of all documents."""
    return activity_blocks_query(spark, d).select("doc_id", "place", block_title(F.col("block")).alias("title"))
