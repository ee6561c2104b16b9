"""Entities and mentions, extraction runs with their telemetry, listings, review proposals and learned baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import _FIELD_SQL, FIELDS, report_text, stated
from ..functions.text import EVIDENCE_SQL, evidence, normalize_whitespace, strip_html
from ..plans.model import FIRST_YEAR, GENERAL, LAST_YEAR, Universe, modelled, query, tables
from ..sources.store import stored_table
from .evaluate import per_label
from .mentions import mentions, named


def _held_by() -> Column:
    return F.concat(F.lit("Held by "), "department_display", F.lit("; in the main hall"))


_MENTION_SQL = f"FROM dep JOIN (SELECT id, lower('Held by ' || department_display || '; in the main hall') AS body FROM act) b USING (id) WHERE code <> '{GENERAL}'"


@modelled("c18_department_mentions", f"SELECT id, code, (strpos(body, lower(code) || ';') - 1)::INT AS start, 100.0::DOUBLE AS score {_MENTION_SQL}")
def department_mentions(u: Universe, spark: SparkSession) -> DataFrame:
    return mentions(u.activities.select("id", _held_by().alias("text")), named(u.members)).select("id", "code", "start", "score")


#: Kinds of entity, the field that states them and how sure that is.
ENTITIES = (("VENUE", "venue", 0.85), ("PERSON", "speaker", 0.85), ("ORG", "organizer", 0.8))


def entities(records: DataFrame, names: DataFrame) -> DataFrame:
    """(id, type, text, confidence) of records (id, text): each entity of a record once, with its highest confidence; ``names`` as ``mentions`` has them."""
    # Both ways read one stored table. A pattern is a column of its own there: within a generator Spark would match it once for each use.
    kept = stored_table(records.select("id", "text", *(stated(F.col("text"), FIELDS[field]).alias(field) for _, field, _ in ENTITIES)), "entity-texts")
    fields = F.array_compact(F.array(*(F.when(F.col(field).isNotNull(), F.struct(F.lit(kind).alias("type"), F.col(field).alias("text"), F.lit(sure).alias("confidence"))) for kind, field, sure in ENTITIES)))
    stated_ = kept.select("id", F.explode(fields).alias("e")).select("id", "e.*")
    each = stated_.union(mentions(kept.select("id", "text"), names).select("id", F.lit("ORG"), "code", F.col("score") / 100))
    return each.groupBy("id", "type", "text").agg(F.max("confidence").alias("confidence"))


@modelled(
    "c21_entities",
    "SELECT id, kind AS type, text, confidence FROM ("
    + " UNION ALL ".join(f"SELECT id, '{kind}' AS kind, {_FIELD_SQL[field]} AS text, {sure}::DOUBLE AS confidence FROM act" for kind, field, sure in ENTITIES)
    + f" UNION ALL SELECT id, 'ORG', code, 1.0::DOUBLE {_MENTION_SQL}) WHERE text IS NOT NULL",
)
def enriched(u: Universe, spark: SparkSession) -> DataFrame:
    """Entities of each activity: venue, person and organizer that its sentences state, departments that it mentions."""
    told = u.activities.select("id", F.concat_ws(" ", report_text(), _held_by()).alias("text"))
    return entities(told, named(u.members))


def listed_items(html: Column, block: str, title: str, date: str) -> Column:
    """Array of (title, url, date_text) of the blocks of class ``block``: the link in class ``title`` and the text in class ``date``; blocks without a link are none."""
    of_class = lambda name: rf"""(?is)<\w+\b[^>]*\bclass=["'][^"']*(?<![\w-]){name}(?![\w-])[^"']*["'][^>]*>"""
    blocks = F.split(html, of_class(block))
    clean = lambda c: normalize_whitespace(strip_html(c))
    link = of_class(title) + r"""(?:(?!</div>).)*?<a\b[^>]*\bhref=["']([^"']*)["'][^>]*>(.*?)</a>"""

    def item(b: Column) -> Column:
        return F.struct(clean(F.regexp_extract(b, link, 2)).alias("title"), F.regexp_extract(b, link, 1).alias("url"), clean(F.regexp_extract(b, of_class(date) + r"(.*?)</\w+>", 1)).alias("date_text"))

    return F.filter(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), item), lambda i: i["title"] != "")


@modelled("s10_event_listing", "SELECT id, title, 'https://example.org/e/' || id AS url, strftime(day, '%d.%m.%Y') AS date_text FROM act UNION ALL SELECT id, 'Second', 'https://other.example/x', '' FROM act")
def event_listing(u: Universe, spark: SparkSession, site: str = "https://example.org") -> DataFrame:
    """Events of listing pages; links that begin with a slash are within the site."""
    entry = F.concat(F.lit("<div class='row event'><div class=\"event-title\"><b><a href='/e/"), F.col("id").cast("string"), F.lit("'> "), "title", F.lit(" </a></b></div><span class='event-date'>"), F.date_format("day", "dd.MM.yyyy"), F.lit("</span></div>"))
    rest = F.lit("<div class=event-list>no</div><div class='event'><p class='event-title'><a href='https://other.example/x'>Second</a></p></div><div class='event'><i class='event-title'>No link</i></div>")
    pages = u.activities.select("id", F.concat(F.lit("<html><body>"), entry, rest).alias("html"))
    each = pages.select("id", F.explode(listed_items(F.col("html"), "event", "event-title", "event-date")).alias("e"))
    url = F.when(F.col("e.url").startswith("/"), F.concat(F.lit(site), "e.url")).otherwise(F.col("e.url"))
    return each.select("id", "e.title", url.alias("url"), "e.date_text")


#: Least evidence of a source that is read, and least length of a block.
EVIDENCE, BLOCK = 0.3, 24
_FIRST_YEAR_OF = r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)"


def run_log(sources: DataFrame) -> DataFrame:
    """Sources (id, kind, text) with what a run does to each: status, reason, score and candidates.

    A source is skipped if it is no activity or has too little evidence; the blocks
    of the others are candidates unless the first year that they name is out of scope.
    A source without a text has failed.
    """
    text, score = F.col("text"), F.coalesce(evidence(F.col("text")), F.lit(0.0))
    year = lambda b: F.regexp_extract(b, _FIRST_YEAR_OF, 1).try_cast("int")
    wanted = lambda b: (F.length(b) >= BLOCK) & F.coalesce(year(b).between(FIRST_YEAR, LAST_YEAR), F.lit(True))
    blocks = F.filter(F.transform(F.split(text, r"[.!?]\s+"), lambda b: F.trim(b)), wanted)
    reason = F.when(text.isNull(), "no text").when(F.lower(text).contains("licensed under"), "no activity").when(score < EVIDENCE, "little evidence").otherwise("evidence")
    status = F.when(F.col("reason") == "no text", "FAILED").when(F.col("reason") == "evidence", "SUCCESS").otherwise("SKIPPED")
    told = sources.select("id", "kind", "text", score.alias("score"), reason.alias("reason")).withColumn("status", status)
    candidates = F.when(F.col("status") == "SUCCESS", F.size(blocks)).otherwise(0).cast("long")
    return told.select("id", "kind", "status", "reason", "score", candidates.alias("candidates"))


_RUN_SQL = rf"""WITH s AS (SELECT doc_id AS id, source AS kind, text, coalesce({EVIDENCE_SQL}, 0.0) AS score, CASE WHEN text IS NULL THEN 'no text' WHEN contains(lower(text), 'licensed under') THEN 'no activity' WHEN coalesce({EVIDENCE_SQL}, 0.0) < {EVIDENCE} THEN 'little evidence' ELSE 'evidence' END AS reason FROM documents),
log AS (SELECT id, kind, CASE reason WHEN 'no text' THEN 'FAILED' WHEN 'evidence' THEN 'SUCCESS' ELSE 'SKIPPED' END AS status, reason, score, CASE WHEN reason = 'evidence' THEN len(list_filter(list_transform(string_split_regex(text, '[.!?]\s+'), lambda b: trim(b)),
  lambda b: length(b) >= {BLOCK} AND coalesce(try_cast(regexp_extract(b, '{_FIRST_YEAR_OF}', 1) AS INT) BETWEEN {FIRST_YEAR} AND {LAST_YEAR}, true))) ELSE 0 END AS candidates FROM s)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("kind"), "text")


@query("c24_run_log", f"{_RUN_SQL} SELECT * FROM log", base=False)
def extraction_run(spark: SparkSession, d: str) -> DataFrame:
    """One telemetry row a source."""
    return run_log(_sources(spark, d))


@query(
    "c24_run_metrics",
    f"{_RUN_SQL} SELECT kind, count(*) AS considered, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'SUCCESS') AS processed, count(*) FILTER (status = 'SUCCESS' AND candidates = 0) AS without_candidates, sum(candidates)::BIGINT AS candidates, count(*) FILTER (status = 'FAILED') AS failures FROM log GROUP BY kind",
    base=False,
)
def extraction_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The run's counters for each kind of source."""
    is_ = lambda s: F.col("status") == s
    return run_log(_sources(spark, d)).groupBy("kind").agg(
        F.count("*").alias("considered"),
        F.count_if(is_("SKIPPED")).alias("skipped"),
        F.count_if(is_("SUCCESS")).alias("processed"),
        F.count_if(is_("SUCCESS") & (F.col("candidates") == 0)).alias("without_candidates"),
        F.sum("candidates").alias("candidates"),
        F.count_if(is_("FAILED")).alias("failures"),
    )


#: Review groups of activities, in order of precedence: the field that a correction proposes to change.
GROUPS = (("category", "B"), ("department", "C"), ("stakeholder", "D"))


def review_group(status: Column, proposals: Column) -> Column:
    """The group of a record from its status and proposals (field, rule, is_correction): undecided, wrongly or rightly no activity, what is to be corrected first, date, right."""
    corrects = lambda field: F.exists(proposals, lambda p: p["is_correction"] & (p["field"] == field))
    dated = F.exists(proposals, lambda p: p["field"] == "date")
    group = F.when(status == "REVIEW_REQUIRED", "G").when((status == "NON_ACTIVITY") & corrects("status"), "F").when(status == "NON_ACTIVITY", "E")
    for field, letter in GROUPS:
        group = group.when(corrects(field), letter)
    return group.when(dated, "H").otherwise("A")


def proposals(rules: list[tuple[str, str, bool, Column]]) -> Column:
    """Array of (field, rule, is_correction) of the rules (field, name, is_correction, condition) that hold."""
    each = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), F.lit(correction).alias("is_correction"))) for field, rule, correction, when in rules]
    return F.array_compact(F.array(*each))


@modelled(
    "c28_review_groups",
    f"""SELECT id, CASE WHEN status = 'REVIEW_REQUIRED' THEN 'G' WHEN status = 'NON_ACTIVITY' THEN CASE WHEN score >= 8 THEN 'F' ELSE 'E' END WHEN n > 4 THEN 'B' WHEN generic THEN 'C' WHEN stakeholder_display IS NULL THEN 'D' WHEN academic_year IS NULL THEN 'H' ELSE 'A' END AS review_group,
CASE WHEN status = 'NON_ACTIVITY' THEN (score >= 8)::INT + 1 ELSE (n > 4)::INT + (n BETWEEN 3 AND 4)::INT + generic::INT + (stakeholder_display IS NULL)::INT + (academic_year IS NULL)::INT END AS proposals
FROM (SELECT act.*, coalesce(n, 0) AS n, coalesce(department_display LIKE '%{GENERAL}%' AND department_display LIKE '%;%', false) AS generic FROM act LEFT JOIN (SELECT id, count(*) AS n FROM cat GROUP BY id) USING (id))""",
)
def review_groups(u: Universe, spark: SparkSession) -> DataFrame:
    """Each activity's review group and number of proposals."""
    counted = u.categories.groupBy("id").agg(F.count("*").alias("labels"))
    rows = u.activities.join(counted, "id", "left").withColumn("labels", F.coalesce("labels", F.lit(0)))
    none, shown = F.col("status") == "NON_ACTIVITY", F.col("department_display")
    rules = [
        ("category", "category_over_tag", True, ~none & (F.col("labels") > 4)),
        ("category", "multi_label_overlap", False, ~none & F.col("labels").between(3, 4)),
        ("department", "department_generic", True, ~none & shown.contains(GENERAL) & shown.contains(";")),
        ("stakeholder", "stakeholder_isolated", True, ~none & F.col("stakeholder_display").isNull()),
        ("status", "embedded_event", True, none & (F.col("score") >= 8)),
        ("date", "date_year", False, ~none & F.col("academic_year").isNull()),
        ("status", "communication_separation", False, none),
    ]
    told = rows.select("id", "status", proposals(rules).alias("p"))
    return told.select("id", review_group(F.col("status"), F.col("p")).alias("review_group"), F.size("p").alias("proposals"))


def baselines(records: DataFrame, labels: tuple[str, ...], features: int = 1 << 16, rounds: int = 15) -> DataFrame:
    """(model, label, counts and rates) of one-versus-rest models on TF-IDF of words and word pairs, on the records (id, text, labels) held out.

    Terms are hashed into ``features`` columns, so no vocabulary is gathered; three
    records in ten are held out, by a hash of the id with seed 42. Weights of terms
    are learned from the others only. Texts are read and hashed once; all models judge
    the held-out records in one pass.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
    from pyspark.ml.feature import IDF, HashingTF

    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w{2,}"), F.lit(0))
    others = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), others), F.slice("w", F.lit(2), others), lambda a, b: F.concat(a, F.lit(" "), b))
    held = F.pmod(F.xxhash64("id", F.lit(42)), F.lit(10)) >= 7
    terms = records.select("id", words.alias("w"), *labels, held.alias("held")).withColumn("terms", F.concat("w", pairs)).drop("w")
    hashed = HashingTF(inputCol="terms", outputCol="tf", numFeatures=features).transform(terms)
    counts = stored_table(hashed.select("held", "tf", *labels), "term-counts")
    weighted = IDF(inputCol="tf", outputCol="features").fit(counts.where("not held")).transform(counts).drop("tf")
    learned, told = stored_table(weighted.where("not held").drop("held"), "vectors"), weighted.where("held")
    models = {"logistic": LogisticRegression(maxIter=rounds, regParam=0.001), "svc": LinearSVC(maxIter=rounds, regParam=0.001), "bayes": NaiveBayes()}
    out = []
    for label in labels:
        own = learned.select("features", F.col(label).cast("double").alias("label"))
        for name, model in models.items():
            told = model.fit(own).setPredictionCol(f"{name}:{label}").transform(told).drop("rawPrediction", "probability")
            out.append(F.struct(F.lit(f"{name}:{label}").alias("label"), (F.col(label) == 1).alias("gold"), (F.col(f"`{name}:{label}`") == 1).alias("predicted")))
    rated = per_label(told.select(F.explode(F.array(*out)).alias("r")).select("r.*"))
    of = F.split("label", ":")
    return rated.select(of[0].alias("model"), of[1].alias("label"), "tp", "fp", "fn", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")))


@query("c29_baselines")
def baselines_query(spark: SparkSession, d: str) -> DataFrame:
    """Three models of both labels over all labelled documents."""
    rows = tables(spark, d, "documents").select("doc_id", "text").join(tables(spark, d, "labels").select("doc_id", "toxic", "quality"), "doc_id")
    return baselines(rows.withColumnRenamed("doc_id", "id"), ("toxic", "quality"))
