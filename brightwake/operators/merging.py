"""Merging of duplicate records with all that refers to them.

Records with one normalised title, one period and the same public categories are a
cluster. It is merged if its members also share department and stakeholder, into the
member with the longest description, of equally long ones the smallest id. What refers to
a duplicate then refers to that record, in every child table, and blank fields of it are
filled. All tables change in one version; a second run finds nothing to merge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalized_title
from ..plans.model import CATEGORIES, GENERAL, query, tables, universe
from ..sources.store import stored_table, work_folder
from ..sources.versions import Versions

#: Fields that a merged record takes from its duplicates where its own are blank.
SCALARS = ("url", "day_text", "academic_year", "department_display", "stakeholder_display", "outcome")
#: What a record holds once in each child table; further columns come from the row that stays.
CHILD_KEYS = {"categories": ("code",), "departments": ("code",), "stakeholders": ("code",), "entities": ("supplier",), "keywords": ("word",), "sources": ("url",), "matches": ("post",)}
#: A cluster is hot with more than this part of all rows, so there are at most a thousand hot ones.
HOT = 1000


@dataclass(frozen=True)
class Records:
    facts: DataFrame
    children: dict[str, DataFrame]


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def filled(field: Column, is_text: bool = True) -> Column:
    """Whether a field has a value: text that is more than white space, or anything else that is not null."""
    return stripped(field) != "" if is_text else field.isNotNull()


def merge_plan(facts: DataFrame, categories: DataFrame, public: Sequence[str] = CATEGORIES) -> DataFrame:
    """(id, canonical, members, verdict) of every member of a cluster of two or more; ``verdict`` is ``merge`` or ``mixed``.

    Records without a title or without a public category are in no cluster. A blank
    department is the general one; blank stakeholders are alike, and so are missing periods.
    """
    codes = categories.where(F.col("code").isin(*public)).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    title, period = normalized_title(F.coalesce("title", F.lit(""))), F.coalesce("period", F.lit(""))
    department = F.when(filled(F.col("department_display")), stripped(F.col("department_display"))).otherwise(GENERAL)
    told = facts.select("id", title.alias("key"), period.alias("period"), F.length(stripped(F.col("description"))).alias("chars"), F.struct(department, stripped(F.col("stakeholder_display"))).alias("who"))
    cluster = F.sha2(F.concat_ws("\n", "key", "period", "codes"), 256).alias("cluster")
    rows = stored_table(told.where("key <> ''").join(codes, "id").select("id", cluster, "chars", "who"), "cluster-rows")
    best = F.max(F.struct("chars", (-F.col("id")).alias("minus")))
    verdict = F.when(F.min("who") == F.max("who"), "merge").otherwise("mixed")
    found = rows.groupBy("cluster").agg((-best["minus"]).alias("canonical"), F.count("*").alias("members"), verdict.alias("verdict")).where("members > 1")
    found = stored_table(found, "clusters")
    # Members of hot clusters stay where they are; there are few such clusters, whatever their size.
    limit = max(rows.count() // HOT, 1)
    hot, cold = found.where(F.col("members") > limit), found.where(F.col("members") <= limit)
    ids = rows.select("id", "cluster")
    here = ids.join(F.broadcast(hot), "cluster")
    there = ids.join(F.broadcast(hot.select("cluster")), "cluster", "left_anti").join(cold, "cluster")
    return here.unionByName(there).select("id", "canonical", "members", "verdict")


def duplicates_of(plan: DataFrame) -> DataFrame:
    """(id, canonical) of the records that a plan merges into another."""
    return plan.where((F.col("verdict") == "merge") & (F.col("id") != F.col("canonical"))).select("id", "canonical")


def repointed(rows: DataFrame, key: Sequence[str], moved: DataFrame) -> DataFrame:
    """A child table after records moved: each record holds a key once.

    The record's own row stays, else that of the duplicate with the smallest id; of rows
    that are alike in that, the smallest. Null keys are alike.
    """
    others = [c for c in rows.columns if c != "id" and c not in key]
    if not others:
        map_ = moved.select("id", "canonical")
        return rows.join(map_, "id", "left").select(F.coalesce("canonical", "id").alias("id"), *key).distinct().select(*rows.columns)
    packed = rows.select(F.col("id").alias("at"), F.struct(*key).alias("key"), F.struct(F.lit(0).alias("none"), *others).alias("rest"))
    map_ = moved.select(F.col("id").alias("at"), F.col("canonical").alias("target"))
    joined = packed.join(map_, "at", "left").select(F.coalesce("target", "at").alias("target"), "key", F.struct(F.col("target").isNotNull().alias("moved"), "at", "rest").alias("row"))
    kept = joined.groupBy("target", "key").agg(F.min("row").alias("row"))
    shown = {"id": F.col("target"), **{c: F.col("key")[c] for c in key}, **{c: F.col("row")["rest"][c] for c in others}}
    return kept.select(*(shown[c].alias(c) for c in rows.columns))


def merged_facts(facts: DataFrame, moved: DataFrame, scalars: Sequence[str] = SCALARS, evidence: str = "evidence") -> DataFrame:
    """The records that stay, with blank fields filled from the duplicate of the smallest id that has a value.

    Evidence that differs is added on lines of its own, in the order of ids, each text once.
    """
    gone = moved.select(F.col("id").alias("at"), F.col("canonical").alias("target"))
    # A record is one column here, so its fields may have any names.
    rows, fact = facts.select(F.col("id").alias("at"), F.struct("*").alias("fact")), F.col("fact")
    has = lambda s: filled(fact[s], isinstance(facts.schema[s].dataType, T.StringType))
    values = F.struct(*(F.when(has(s), fact[s]).alias(f"v{i}") for i, s in enumerate(scalars))).alias("values")
    dups = rows.join(gone, "at").select("target", "at", values, stripped(fact[evidence]).alias("said"))
    first = lambda i: F.min(F.when(F.col(f"values.v{i}").isNotNull(), F.struct("at", f"values.v{i}")))[f"v{i}"]
    gains = dups.groupBy("target").agg(F.struct(*(first(i).alias(f"v{i}") for i in range(len(scalars)))).alias("gain"))
    texts = dups.where("said <> ''").groupBy("target", "said").agg(F.min("at").alias("at"))
    told = texts.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("at", "said")))["said"].alias("told"))
    gains = gains.join(told, "target", "left").withColumnRenamed("target", "at")
    own, gain, none = stripped(fact[evidence]), F.col("gain"), F.array().cast("array<string>")
    more = F.filter(F.coalesce("told", none), lambda t: t != own)
    together = F.array_join(F.concat(F.when(own != "", F.array(own)).otherwise(none), more), "\n")
    new = {s: F.when(has(s), fact[s]).otherwise(F.coalesce(gain[f"v{i}"], fact[s])) for i, s in enumerate(scalars)}
    new[evidence] = F.when(F.size(more) > 0, together).otherwise(fact[evidence])
    joined = rows.join(gone.select("at"), "at", "left_anti").join(gains, "at", "left")
    return joined.select(*(new.get(c, fact[c]).alias(c) for c in facts.columns))


HISTORY = "canonical long, duplicate long, action string, version long"


def merge_once(versions: Versions) -> int | None:
    """Merge the newest version's clusters and commit the next; none if there is nothing to merge.

    A version has the tables ``facts`` and ``history`` and the child tables of ``CHILD_KEYS``.
    """
    number = versions.latest()
    held = versions.read(number)
    moved = stored_table(duplicates_of(merge_plan(held["facts"], held["categories"])), "merges")
    if moved.isEmpty():
        return None
    new = {name: repointed(held[name], key, moved) for name, key in CHILD_KEYS.items()}
    done = moved.select("canonical", F.col("id").alias("duplicate"), F.lit("merge").alias("action"), F.lit(number + 1).cast("long").alias("version"))
    return versions.commit({"facts": merged_facts(held["facts"], moved), "history": held["history"].unionByName(done), **new}, number)


def entered_twice(spark: SparkSession, d: str) -> Records:
    """Activities with all that refers to them; every fourth was entered again, every eighth twice, under negative ids.

    Entries differ in spelling, in what is filled in and in what refers to them.
    """
    u = universe(spark, d)
    line = tables(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_suppkey", "l_partkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("word"))
    number = F.col("id").cast("string")
    facts = u.activities.select(
        "id", F.concat_ws(" ", "title", F.col("customer").cast("string")).alias("title"), "description", "period", "url", F.when(F.col("id") % 8 != 0, F.date_format("day", "yyyy-MM-dd")).alias("day_text"),
        F.when(F.col("id") % 12 != 0, F.col("academic_year")).alias("academic_year"), "department_display", "stakeholder_display", F.when(F.col("id") % 3 == 0, " ").otherwise("done").alias("outcome"), F.concat(F.lit("seen "), number).alias("evidence"),
    )
    # Own rows are entry 0, so that what they come from is computed once.
    entries = F.explode(F.when(F.col("id") % 8 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).when(F.col("id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    entered = lambda df: df.select("*", entries.alias("k")).withColumn("of", F.col("id")).withColumn("id", F.when(F.col("k") == 0, F.col("id")).otherwise(-(F.col("id") * 2 + F.col("k"))))
    changes = {
        "title": F.concat(F.upper("title"), F.lit("!")), "description": F.when(F.col("of") % 16 == 0, F.concat("description", F.lit(" again"))).otherwise("short"), "url": F.concat(F.lit("https://example.org/b/"), F.col("k").cast("string")),
        "day_text": F.concat(F.lit("day "), F.col("k").cast("string")), "academic_year": F.coalesce("academic_year", F.lit("1999-00")), "outcome": F.lit("won"), "evidence": F.when(F.col("k") == 1, F.col("evidence")).otherwise("told later"),
    }

    def both(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
        return entered(df).select(*(F.when(F.col("k") == 0, F.col(c)).otherwise(changed[c]).alias(c) if c in changed else F.col(c) for c in df.columns))

    k = F.col("k")
    less = F.round(F.col("confidence") - k * 0.01, 4)
    children = {
        "categories": both(u.categories.select("id", "code", "confidence"), {"confidence": less}),
        "departments": both(u.departments.select("id", "code", "confidence"), {"confidence": less}),
        "stakeholders": both(u.stakeholders.select("id", "code").distinct(), {"code": F.when(k == 2, "GUESTS").otherwise(F.col("code"))}),
        "entities": both(line.select("id", F.col("l_suppkey").alias("supplier")).distinct(), {"supplier": F.col("supplier") + k % 2}),
        "keywords": both(line.select("id", "word").distinct(), {"word": F.col("word")}),
        "sources": both(line.select("id", F.concat(F.lit("https://example.org/p/"), F.col("l_partkey").cast("string")).alias("url")).distinct(), {"url": F.when(k == 2, F.concat("url", F.lit("?v=2"))).otherwise(F.col("url"))}),
        "matches": both(line.select("id", F.col("l_linenumber").cast("long").alias("post")).distinct(), {"post": F.col("post") + k}),
    }
    return Records(both(facts, changes), children)


_ENTERED = r"""
, ln AS (SELECT l_orderkey AS id, l_suppkey, l_partkey, l_linenumber, l_returnflag || l_linestatus AS word FROM lineitem
), own AS (SELECT id, title || ' ' || customer AS title, description, period, url, CASE WHEN id % 8 <> 0 THEN strftime(day, '%Y-%m-%d') END AS day_text, CASE WHEN id % 12 <> 0 THEN academic_year END AS academic_year,
    department_display, stakeholder_display, CASE WHEN id % 3 = 0 THEN ' ' ELSE 'done' END AS outcome, 'seen ' || id AS evidence FROM act
), ks AS (SELECT id AS was, k, -(2 * id + k) AS id FROM act CROSS JOIN (SELECT unnest([1, 2]) AS k) WHERE id % 4 = 0 AND (k = 1 OR id % 8 = 0)
), recs AS (SELECT * FROM own UNION ALL
  SELECT ks.id, upper(title) || '!', CASE WHEN was % 16 = 0 THEN description || ' again' ELSE 'short' END, period, 'https://example.org/b/' || k, 'day ' || k, coalesce(academic_year, '1999-00'),
    department_display, stakeholder_display, 'won', CASE WHEN k = 1 THEN evidence ELSE 'told later' END FROM own JOIN ks ON own.id = was
), cats AS (SELECT id, code, confidence FROM cat UNION ALL SELECT ks.id, code, round(confidence - k * 0.01, 4) FROM cat JOIN ks ON cat.id = was
), codes AS (SELECT id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM cats GROUP BY id
), keyed AS (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key, period, codes, length(description) AS chars, coalesce(department_display, '') || '|' || coalesce(stakeholder_display, '') AS who FROM recs JOIN codes USING (id)
), plan AS (SELECT id, first_value(id) OVER (w ORDER BY chars DESC, id) AS canonical, count(*) OVER (w) AS members,
    CASE WHEN min(who) OVER (w) = max(who) OVER (w) THEN 'merge' ELSE 'mixed' END AS verdict FROM keyed WINDOW w AS (PARTITION BY key, period, codes)
), moved AS (SELECT id, canonical FROM plan WHERE members > 1 AND verdict = 'merge' AND id <> canonical)
"""


@query("m14_cluster_plan", _ENTERED + "SELECT * FROM plan WHERE members > 1")
def cluster_plan(spark: SparkSession, d: str) -> DataFrame:
    """Members of all clusters of two or more, the record of each with the longest description, and whether they merge."""
    held = entered_twice(spark, d)
    return merge_plan(held.facts, held.children["categories"])


def merged(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables after merging, read from the version that was committed."""
    held = entered_twice(spark, d)
    versions = Versions(spark, work_folder(spark, "merge"))
    versions.commit({"facts": held.facts, "history": spark.createDataFrame([], HISTORY), **held.children}, None)
    merge_once(versions)
    return versions.read()


_FIRST = ", ".join(f"coalesce(CASE WHEN trim(r.{s}) <> '' THEN r.{s} END, g.{s}, r.{s}) AS {s}" for s in SCALARS)
_GAINS = ", ".join(f"arg_min(r.{s}, r.id) FILTER (trim(r.{s}) <> '') AS {s}" for s in SCALARS)


@query(
    "m14_merged_facts",
    _ENTERED
    + f""", gains AS (SELECT canonical, {_GAINS} FROM recs r JOIN moved USING (id) GROUP BY canonical
), said AS (SELECT canonical, r.evidence, min(r.id) AS first_at FROM recs r JOIN moved USING (id) JOIN recs c ON c.id = canonical WHERE r.evidence <> c.evidence GROUP BY ALL
), told AS (SELECT canonical, string_agg(evidence, chr(10) ORDER BY first_at) AS more FROM said GROUP BY canonical)
SELECT r.id, r.title, r.description, r.period, {_FIRST}, CASE WHEN more IS NULL THEN r.evidence ELSE r.evidence || chr(10) || more END AS evidence
FROM recs r LEFT JOIN gains g ON r.id = g.canonical LEFT JOIN told t ON r.id = t.canonical WHERE r.id NOT IN (SELECT id FROM moved)""",
)
def merged_facts_query(spark: SparkSession, d: str) -> DataFrame:
    """The records that stay, with fields and evidence of their duplicates."""
    return merged(spark, d)["facts"]


_CHILDREN = """
SELECT 'categories' AS kind, id, code AS key, confidence FROM cats
UNION ALL SELECT 'departments', id, code, confidence FROM dep UNION ALL SELECT 'departments', ks.id, code, round(confidence - k * 0.01, 4) FROM dep JOIN ks ON dep.id = was
UNION ALL SELECT 'stakeholders', id, code, NULL FROM stk UNION ALL SELECT 'stakeholders', ks.id, CASE WHEN k = 2 THEN 'GUESTS' ELSE code END, NULL FROM stk JOIN ks ON stk.id = was
UNION ALL SELECT 'entities', id, l_suppkey::VARCHAR, NULL FROM ln UNION ALL SELECT 'entities', ks.id, (l_suppkey + k % 2)::VARCHAR, NULL FROM ln JOIN ks ON ln.id = was
UNION ALL SELECT 'keywords', id, word, NULL FROM ln UNION ALL SELECT 'keywords', ks.id, word, NULL FROM ln JOIN ks ON ln.id = was
UNION ALL SELECT 'sources', id, 'https://example.org/p/' || l_partkey, NULL FROM ln UNION ALL SELECT 'sources', ks.id, 'https://example.org/p/' || l_partkey || CASE WHEN k = 2 THEN '?v=2' ELSE '' END, NULL FROM ln JOIN ks ON ln.id = was
UNION ALL SELECT 'matches', id, l_linenumber::VARCHAR, NULL FROM ln UNION ALL SELECT 'matches', ks.id, (l_linenumber + k)::VARCHAR, NULL FROM ln JOIN ks ON ln.id = was
"""


@query(
    "m14_merged_children",
    _ENTERED
    + f""", every AS ({_CHILDREN})
SELECT kind, coalesce(m.canonical, e.id) AS id, key, arg_min(confidence, (m.canonical IS NOT NULL, e.id)) AS confidence FROM every e LEFT JOIN moved m ON e.id = m.id GROUP BY kind, coalesce(m.canonical, e.id), key""",
)
def merged_children(spark: SparkSession, d: str) -> DataFrame:
    """All seven child tables after the merge, as (kind, id, key, confidence)."""
    held, out = merged(spark, d), None
    for kind, (key,) in CHILD_KEYS.items():
        confidence = F.col("confidence") if "confidence" in held[kind].columns else F.lit(None).cast("double")
        rows = held[kind].select(F.lit(kind).alias("kind"), "id", F.col(key).cast("string").alias("key"), confidence.alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    return out
