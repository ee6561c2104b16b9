"""Further joins, audits, reports and mutations of the activity model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import keywords
from ..plans.model import CATEGORIES, GENERAL, PERIODS, PUBLIC_NAMES, Universe, modelled, query, tables
from .aggregates import n_distinct, parts
from .filters import Filter, narrowed
from .ranking import numbered


@modelled("p04_source_urls", "SELECT customer, min(url) AS primary_url, array_to_string(list_sort(list_distinct(list(url))), ' ') AS urls FROM act WHERE url IS NOT NULL GROUP BY customer")
def source_urls(u: Universe, spark: SparkSession) -> DataFrame:
    """Distinct sources of a customer's activities; the primary one comes first as it is the least."""
    rows = u.activities.where("url is not null").groupBy("customer").agg(F.min("url").alias("primary_url"), F.sort_array(F.collect_set("url")).alias("urls"))
    return rows.select("customer", "primary_url", F.array_join("urls", " ").alias("urls"))


@modelled("p20_admin_list", "SELECT id, title, status FROM act WHERE period = '1999-00' AND title ILIKE '%medium%' AND coalesce(stakeholder_display, 'Students') = 'Students' ORDER BY id LIMIT 100")
def admin_list(u: Universe, spark: SparkSession) -> DataFrame:
    rows = narrowed(u, Filter(period="1999-00")).where(F.col("title").ilike("%medium%") & F.col("stakeholder_display").isNull())
    return rows.select("id", "title", "status").orderBy("id").limit(100)


@modelled("j01_left_equi", "SELECT o_orderkey AS id, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_equi(u: Universe, spark: SparkSession) -> DataFrame:
    name = F.regexp_extract("description", "^Placed by (.*) with status", 1)
    return u.activities.select("id", F.when(name != "?", name).alias("name"))


@modelled("j02_inner_chain", "SELECT act.id, cat.code AS category, dep.code AS department FROM act JOIN cat USING (id) JOIN dep USING (id) WHERE cat.is_primary AND dep.is_primary")
def inner_chain(u: Universe, spark: SparkSession) -> DataFrame:
    first = u.categories.where("is_primary").select("id", F.col("code").alias("category"))
    return u.activities.select("id").join(first, "id").join(u.departments.where("is_primary").select("id", F.col("code").alias("department")), "id")


@modelled("j04_semi_anti", "SELECT 'with' AS kind, count(*) AS n FROM act WHERE EXISTS (SELECT 1 FROM cat WHERE cat.id = act.id AND code = 'LARGE') UNION ALL SELECT 'without', count(*) FROM act WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.id = act.id AND code = 'LARGE')")
def semi_anti(u: Universe, spark: SparkSession) -> DataFrame:
    large = u.categories.where("code = 'LARGE'")
    found = [u.activities.join(large, "id", how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, how in (("with", "left_semi"), ("without", "left_anti"))]
    return found[0].unionByName(found[1])


@modelled("j09_missing_candidates", "SELECT act.id FROM act LEFT JOIN cat ON cat.id = act.id WHERE cat.id IS NULL")
def missing_candidates(u: Universe, spark: SparkSession) -> DataFrame:
    """Facts without a candidate row; must be reviewed before a build."""
    return u.activities.join(u.categories, "id", "left_anti").select("id")


@query(
    "j12_token_blocks",
    """WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(split_part(text, '.', 1)), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> ''))) AS w, source FROM documents)
SELECT array_to_string(w[1:3], ' ') AS block, count(*) AS n, count(DISTINCT source) AS sources FROM t GROUP BY 1 HAVING count(*) > 1""",
    base=False,
)
def token_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the first three distinct tokens of a title that hold more than one record."""
    title = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.substring_index("text", ".", 1)), "[^a-z ]", " "), " +", " "))
    words = F.sort_array(F.array_distinct(F.filter(F.split(title, " "), lambda w: w != "")))
    grouped = tables(spark, d, "documents").groupBy(F.array_join(F.slice(words, 1, 3), " ").alias("block")).agg(F.count("*").alias("n"), n_distinct("source").alias("sources"))
    return grouped.where("n > 1")


@modelled("j16_alias_join", "SELECT id, part, CASE part WHEN 'NATION_1' THEN 'First' WHEN 'NATION_2' THEN 'Second' ELSE part END AS name FROM (SELECT id, trim(unnest(string_split(department_display, ';'))) AS part FROM act)")
def alias_join(u: Universe, spark: SparkSession) -> DataFrame:
    alias = F.create_map(*map(F.lit, ("nation_1", "First", "nation_2", "Second")))
    each = u.activities.select("id", F.explode(parts(F.col("department_display"))).alias("part"))
    return each.select("id", "part", F.coalesce(F.try_element_at(alias, F.lower("part")), "part").alias("name"))


@modelled("a34_admin_overview", "SELECT count(*) AS total, count(*) FILTER (department_display = 'General') AS general, count(*) FILTER (status = 'REVIEW_REQUIRED') AS backlog, count(*) FILTER (review_status IS NULL) AS unreviewed, max(day) AS latest FROM act")
def admin_overview(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.agg(F.count("*").alias("total"), F.count_if(F.col("department_display") == GENERAL).alias("general"), F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("backlog"), F.count_if(F.col("review_status").isNull()).alias("unreviewed"), F.max("day").alias("latest"))


@modelled(
    "a41_candidate_summary",
    """SELECT 'status' AS metric, status AS key, count(*) AS n FROM act GROUP BY 2 UNION ALL SELECT 'multi_label', '', count(*) FROM (SELECT id FROM cat GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'band', CASE WHEN score >= 8 THEN 'strong' WHEN score >= 4 THEN 'medium' WHEN score >= 1 THEN 'weak' ELSE 'none' END, count(*) FROM act GROUP BY 2 UNION ALL SELECT 'category', code, count(*) FROM cat GROUP BY 2""",
)
def candidate_summary(u: Universe, spark: SparkSession) -> DataFrame:
    """Metric rows of the candidate layer."""
    band = F.when(F.col("score") >= 8, "strong").when(F.col("score") >= 4, "medium").when(F.col("score") >= 1, "weak").otherwise("none")
    multi = u.categories.groupBy("id").count().where("count > 1").agg(F.lit("multi_label").alias("metric"), F.lit("").alias("key"), F.count("*").alias("n"))
    rows = [u.activities.groupBy(F.lit("status").alias("metric"), F.col("status").alias("key")).agg(F.count("*").alias("n")), multi]
    rows += [u.activities.groupBy(F.lit("band").alias("metric"), band.alias("key")).agg(F.count("*").alias("n")), u.categories.groupBy(F.lit("category").alias("metric"), F.col("code").alias("key")).agg(F.count("*").alias("n"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@modelled("a42_staging_report", "SELECT period, count(*) AS n, count(url) AS with_url, count(DISTINCT url) AS urls, count(*) - count(DISTINCT title) AS repeated_titles FROM act GROUP BY period")
def staging_report(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.groupBy("period").agg(F.count("*").alias("n"), F.count("url").alias("with_url"), n_distinct("url").alias("urls"), (F.count("*") - n_distinct("title")).alias("repeated_titles"))


@modelled(
    "a43_data_quality_report",
    """SELECT 'completeness' AS kind, 'url' AS metric, round(count(url) / count(*), 4) AS value FROM act UNION ALL SELECT 'completeness', 'academic_year', round(count(academic_year) / count(*), 4) FROM act
UNION ALL SELECT 'classification', 'links_per_activity', round((SELECT count(*) FROM cat) / count(*), 4) FROM act UNION ALL SELECT 'review', 'open', count(*) FILTER (review_status IS NULL)::DOUBLE FROM act""",
)
def data_quality_report(u: Universe, spark: SparkSession) -> DataFrame:
    """Metrics in groups, as long rows."""
    links = u.categories.agg(F.count("*").alias("links"))
    one = u.activities.agg(F.count("*").alias("total"), F.count("url").alias("url"), F.count("academic_year").alias("year"), F.count_if(F.col("review_status").isNull()).alias("open")).crossJoin(links)  # one row by one row
    share = lambda c: F.round(F.col(c) / F.col("total"), 4)
    metrics = [("completeness", "url", share("url")), ("completeness", "academic_year", share("year")), ("classification", "links_per_activity", share("links")), ("review", "open", F.col("open").cast("double"))]
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(m).alias("metric"), v.alias("value")) for k, m, v in metrics))).alias("r")).select("r.*")


@modelled("a45_audits", "SELECT 'period' AS audit, period AS value, count(*) AS n, min(id) AS example FROM act GROUP BY 2 UNION ALL SELECT 'description', CASE WHEN length(description) < 45 THEN 'short' ELSE 'long' END, count(*), min(id) FROM act GROUP BY 2 UNION ALL SELECT 'stakeholder', coalesce(stakeholder_display, 'missing'), count(*), min(id) FROM act GROUP BY 2")
def audits(u: Universe, spark: SparkSession) -> DataFrame:
    length = F.when(F.length("description") < 45, "short").otherwise("long")
    out = None
    for name, value in (("period", F.col("period")), ("description", length), ("stakeholder", F.coalesce("stakeholder_display", F.lit("missing")))):
        rows = u.activities.groupBy(F.lit(name).alias("audit"), value.alias("value")).agg(F.count("*").alias("n"), F.min("id").alias("example"))
        out = rows if out is None else out.unionByName(rows)
    return out


@modelled("a46_build_audit", "SELECT count(*) AS facts, count(DISTINCT id) AS ids, count(*) FILTER (title IS NULL OR title = '') AS untitled, count(*) FILTER (day IS NULL) AS undated, count(*) FILTER (period NOT IN (SELECT period FROM periods)) AS bad_periods FROM act")
def build_audit(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.agg(F.count("*").alias("facts"), n_distinct("id").alias("ids"), F.count_if(F.coalesce(F.col("title") == "", F.lit(True))).alias("untitled"), F.count_if(F.col("day").isNull()).alias("undated"), F.count_if(~F.col("period").isin(*PERIODS)).alias("bad_periods"))


@query("w07_cluster_canonical", "SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, count(*) AS n FROM documents GROUP BY source", base=False)
def cluster_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Longest text of each cluster, then smallest id."""
    best = tables(spark, d, "documents").groupBy("source").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("m"))).alias("b"), F.count("*").alias("n"))
    return best.select("source", (-F.col("b.m")).alias("doc_id"), "n")


@modelled("w10_stratified_sample")
def stratified_sample(u: Universe, spark: SparkSession, per_category: int = 6) -> DataFrame:
    """At most six activities of each category, by a seeded hash; sampling is the feature."""
    order = Window.partitionBy("code").orderBy(F.xxhash64("id", F.lit(42)), "id")
    return u.categories.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_category).select("code", "id")


@modelled("o02_title_tie_break", "SELECT id, title, day FROM act ORDER BY day DESC NULLS LAST, id ASC LIMIT 20")
def title_tie_break(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id", "title", "day").orderBy(F.desc_nulls_last("day"), "id").limit(20)


@modelled("u02_code_sets", "SELECT id, list_sort(list_distinct(list_concat(a, b))) AS either, list_sort(list_intersect(a, b)) AS both FROM (SELECT cat.id, list(DISTINCT cat.code) AS a, ['PROMO', 'LARGE'] AS b FROM cat GROUP BY cat.id)")
def code_sets(u: Universe, spark: SparkSession) -> DataFrame:
    own = u.categories.groupBy("id").agg(F.collect_set("code").alias("a"))
    other = F.array(F.lit("PROMO"), F.lit("LARGE"))
    return own.select("id", F.sort_array(F.array_union("a", other)).alias("either"), F.sort_array(F.array_intersect("a", other)).alias("both"))


@modelled("u03_new_rows", "SELECT id FROM act WHERE period = '2000-01' AND title NOT IN (SELECT title FROM act WHERE period = '1996-97' AND status = 'REPORTABLE' AND score > 8)")
def new_rows(u: Universe, spark: SparkSession) -> DataFrame:
    seen = u.activities.where("period = '1996-97' and status = 'REPORTABLE' and score > 8").select("title").distinct()
    return u.activities.where("period = '2000-01'").join(seen, "title", "left_anti").select("id")


@query("u06_union_sources", "SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'document' AS kind, text FROM documents UNION ALL SELECT 'passage', text FROM benchmark UNION ALL SELECT 'turn', text FROM conversations) GROUP BY kind", base=False)
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for kind, name in (("document", "documents"), ("passage", "benchmark"), ("turn", "conversations")):
        rows = tables(spark, d, name).select(F.lit(kind).alias("kind"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("f16_promote", "SELECT lower(split_part(text, '.', 1)) AS title, min(doc_id) AS id, count(*) AS sources FROM documents WHERE n_chars >= 100 AND text NOT ILIKE '%licensed under%' GROUP BY 1", base=False)
def promote(spark: SparkSession, d: str) -> DataFrame:
    """Good candidates become activities; equal titles merge and count as sources."""
    good = tables(spark, d, "documents").where((F.col("n_chars") >= 100) & ~F.col("text").ilike("%licensed under%"))
    return good.groupBy(F.lower(F.substring_index("text", ".", 1)).alias("title")).agg(F.min("doc_id").alias("id"), F.count("*").alias("sources"))


@query("f20_document_frequency", "SELECT word, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS word FROM documents) WHERE word NOT IN ('the','and','for','with','this','that','from','held','will','was','have','been') GROUP BY word HAVING count(*) >= 5", base=False)
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a vector space: words of at least five documents, with their document frequency."""
    each = tables(spark, d, "documents").select(F.explode(keywords(F.col("text"))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")


def counted_terms(records: DataFrame) -> DataFrame:
    """(id, term, tf) of the words and word pairs of records (id, text), counted within the row of their id before any shuffle of terms."""
    words = F.transform("texts", lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w{2,}"), F.lit(0)))
    own = records.groupBy("id").agg(F.collect_list(F.coalesce(F.col("text"), F.lit(""))).alias("texts")).select("id", words.alias("w"))
    pairs = lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda v, i: F.concat_ws(" ", w[i], v))
    rows = own.select("id", F.sort_array(F.flatten(F.transform("w", lambda w: F.concat(w, pairs(w))))).alias("s")).where("size(s) > 0")
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.col("s")[i] != F.get("s", i - 1)))
    runs = F.transform("first", lambda i, k: F.struct(F.col("s")[i].alias("term"), (F.coalesce(F.get("first", k + 1), F.size("s")) - i).cast("long").alias("tf")))
    return rows.select("id", "s", first.alias("first")).select("id", F.explode(runs).alias("t")).select("id", "t.term", "t.tf")


def tfidf(records: DataFrame) -> DataFrame:
    """(id, term, tf, df, weight) of the words and word pairs of records (id, text), all of them.

    Words have two letters or digits at least. The weight is tf times
    ln((1 + n) / (1 + df)) + 1 over n records, in rows of length 1. Terms are
    shuffled twice, by term and by record; neither has more rows than there are records or terms of one.
    """
    n = records.agg(F.countDistinct("id").alias("n")).first()["n"]
    counts = counted_terms(records).withColumn("df", F.count("*").over(Window.partitionBy("term")))
    raw = counts.withColumn("raw", F.col("tf") * (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "term", "tf", "df", (F.col("raw") / norm).alias("weight"))


@query("f20_tfidf")
def tfidf_query(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF of words and word pairs over all documents, without a least frequency."""
    return tfidf(tables(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


@modelled("f21_search_terms", "SELECT id, list_filter([title, title || ' ' || split_part(department_display, ';', 1), title || ' ' || academic_year], lambda x: x IS NOT NULL) AS terms FROM act")
def search_terms(u: Universe, spark: SparkSession) -> DataFrame:
    with_department = F.concat_ws(" ", "title", F.substring_index("department_display", ";", 1))
    terms = F.array(F.col("title"), F.when(F.col("department_display").isNotNull(), with_department), F.when(F.col("academic_year").isNotNull(), F.concat_ws(" ", "title", "academic_year")))
    return u.activities.select("id", F.array_distinct(F.array_compact(terms)).alias("terms"))


@query("f25_content_normalization", r"SELECT page_id, regexp_replace(split_part(regexp_replace(html, '[–—]', '-', 'g'), '<footer', 1), '(\w)-\s+(\w)', '\1\2', 'g') AS body FROM pages", base=False)
def content_normalization(spark: SparkSession, d: str) -> DataFrame:
    """Dashes unified, the footer cut, hyphenated line ends joined."""
    cut = F.substring_index(F.regexp_replace("html", "[–—]", "-"), "<footer", 1)
    return tables(spark, d, "pages").select("page_id", F.regexp_replace(cut, r"(\w)-\s+(\w)", "$1$2").alias("body"))


@query("f26_blocks", r"SELECT doc_id, count(*) AS blocks, max(length(s)) AS longest FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '[.!?]\s+'))) AS s FROM documents) WHERE length(s) >= 24 GROUP BY doc_id", base=False)
def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of 24 characters or more."""
    each = tables(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[.!?]\s+")).alias("s")).select("doc_id", F.trim("s").alias("s"))
    return each.where(F.length("s") >= 24).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max(F.length("s")).cast("long").alias("longest"))


@modelled("d13_date_range", "SELECT id, day AS first_day, (day + INTERVAL 3 DAY)::DATE AS last_day FROM act")
def date_range(u: Universe, spark: SparkSession) -> DataFrame:
    """A range written as two days round a dash, split and read."""
    from ..functions.dates import normalize_date

    written = F.concat(F.date_format("day", "d MMM yyyy"), F.lit(" - "), F.date_format(F.date_add("day", 3), "d MMM yyyy"))
    halves = u.activities.select("id", F.split(written, r"\s+-\s+").alias("h"))
    return halves.select("id", normalize_date(F.col("h")[0]).alias("first_day"), normalize_date(F.col("h")[1]).alias("last_day"))


_WEIGHTED = {"FREE": (("apache license|mit license", 4), ("public license", 3)), "CONTACT": ((r"@mail", 3), (r"\+1", 2)), "CODE": (("token = ", 3), ("import ", 1))}


@query(
    "c03_weighted_patterns",
    "SELECT doc_id, label, score FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, (" + " + ".join(f"{w} * regexp_matches(lower(text), '{p}')::INT" for p, w in ps) + ")::BIGINT AS score FROM documents" for k, ps in _WEIGHTED.items()) + ") WHERE score >= 3",
    base=False,
)
def weighted_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose matching patterns weigh at least 3."""
    lowered = tables(spark, d, "documents").select("doc_id", F.lower("text").alias("body"))
    scores = []
    for label, patterns in _WEIGHTED.items():
        score = F.lit(0).cast("long")
        for p, w in patterns:
            score = score + F.when(F.col("body").rlike(p), w).otherwise(0)
        scores.append(F.struct(F.lit(label).alias("label"), score.alias("score")))
    return lowered.select("doc_id", F.explode(F.array(*scores)).alias("s")).select("doc_id", "s.label", "s.score").where("score >= 3")


@modelled("c17_department_status", "SELECT id, CASE WHEN department_display = 'General' THEN 'institution' WHEN department_display IS NULL THEN 'unknown' WHEN department_display LIKE '%;%' THEN 'multiple' ELSE 'single' END AS status FROM act")
def department_status(u: Universe, spark: SparkSession) -> DataFrame:
    n = F.size(parts(F.col("department_display")))
    status = F.when(F.col("department_display") == GENERAL, "institution").when(F.col("department_display").isNull(), "unknown").when(n > 1, "multiple").otherwise("single")
    return u.activities.select("id", status.alias("status"))


@query("c23_source_exclusion", "SELECT page_id, regexp_matches(lower(url), 'page=|admission|syllabus|tender') AS excluded FROM pages", base=False)
def source_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "pages").select("page_id", F.lower("url").rlike("page=|admission|syllabus|tender").alias("excluded"))


@modelled("c27_report_schema", "SELECT code, name, row_number() OVER (PARTITION BY code ORDER BY day, act.id) AS s_no, act.id, title, day FROM act JOIN cat ON cat.id = act.id JOIN categories USING (code) WHERE cat.is_primary AND period = '1996-97'")
def category_report(u: Universe, spark: SparkSession) -> DataFrame:
    """Numbered rows of every category's report for a period."""
    names = F.create_map(*(F.lit(x) for c in CATEGORIES for x in (c, PUBLIC_NAMES[c])))
    rows = narrowed(u, Filter(period="1996-97")).join(u.categories.where("is_primary").select("id", "code"), "id")
    listed = numbered(rows.select("code", "id", "title", "day"), ["day", "id"], "s_no", ("code",))
    return listed.select("code", names[F.col("code")].alias("name"), "s_no", "id", "title", "day")


@modelled("c30_reclassify", "SELECT cat.id, code, CASE WHEN code <> 'SMALL' THEN code WHEN url IS NOT NULL THEN 'LARGE' WHEN score >= 6 THEN 'MEDIUM' ELSE 'REVIEW' END AS new_code FROM cat JOIN act USING (id)")
def reclassify(u: Universe, spark: SparkSession) -> DataFrame:
    """A retired category's links move by evidence, or go to review."""
    joined = u.categories.select("id", "code").join(u.activities.select("id", "url", "score"), "id")
    new = F.when(F.col("code") != "SMALL", F.col("code")).when(F.col("url").isNotNull(), "LARGE").when(F.col("score") >= 6, "MEDIUM").otherwise("REVIEW")
    return joined.select("id", "code", new.alias("new_code"))


@modelled("m02_override_fold", "SELECT id, coalesce(CASE WHEN id % 9 = 0 THEN 'Corrected ' || id END, title) AS title, coalesce(CASE WHEN id % 9 = 0 THEN period WHEN id % 4 = 0 THEN 'Before 1996' END, period) AS period FROM act")
def override_fold(u: Universe, spark: SparkSession) -> DataFrame:
    """Manual overrides win over computed fields on a rebuild."""
    over = u.activities.select("id", F.when(F.col("id") % 9 == 0, F.concat(F.lit("Corrected "), F.col("id").cast("string"))).alias("t"), F.when((F.col("id") % 9 != 0) & (F.col("id") % 4 == 0), PERIODS[5]).alias("p"))
    return u.activities.join(over, "id", "left").select("id", F.coalesce("t", "title").alias("title"), F.coalesce("p", "period").alias("period"))


@modelled("m04_occurrence_refresh", "SELECT id, code, count(*) AS n FROM (SELECT id, unnest(string_split(department_display, '; ')) AS code FROM act WHERE status = 'REPORTABLE') GROUP BY ALL")
def occurrence_refresh(u: Universe, spark: SparkSession) -> DataFrame:
    each = u.activities.where("status = 'REPORTABLE'").select("id", F.explode(parts(F.col("department_display"))).alias("code"))
    return each.groupBy("id", "code").agg(F.count("*").alias("n"))


@modelled("m12_queue_items", "SELECT id, review_status, day FROM act WHERE status = 'REVIEW_REQUIRED' AND review_status IS NULL AND period = '1998-99'")
def queue_items(u: Universe, spark: SparkSession) -> DataFrame:
    return narrowed(u, Filter(period="1998-99", status="REVIEW_REQUIRED")).where("review_status is null").select("id", "review_status", "day")


@modelled("m13_match_queue", "SELECT id, 'UNCHECKED' AS match_status FROM act WHERE url IS NULL AND id NOT IN (SELECT id FROM stk WHERE code = 'STAFF')")
def match_queue(u: Universe, spark: SparkSession) -> DataFrame:
    checked = u.stakeholders.where("code = 'STAFF'")
    return u.activities.where("url is null").join(checked, "id", "left_anti").select("id", F.lit("UNCHECKED").alias("match_status"))


@query("t01_cursor", "SELECT event_type, max(event_id) AS last_id, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY event_type", base=False)
def cursor(spark: SparkSession, d: str) -> DataFrame:
    """The cursor that a next run of each source begins after."""
    return tables(spark, d, "events").groupBy("event_type").agg(F.max("event_id").alias("last_id"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("t03_run_counters", "SELECT date_trunc('day', ts)::DATE AS run, count(*) AS fetched, count(DISTINCT (user_id, event_type)) AS keys, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1", base=False)
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    events = tables(spark, d, "events")
    return events.groupBy(F.to_date("ts").alias("run")).agg(F.count("*").alias("fetched"), n_distinct("user_id", "event_type").alias("keys"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("t04_insert_if_absent", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02')", base=False)
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    events = tables(spark, d, "events")
    known = events.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp")).select("user_id").distinct()
    return events.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).join(known, "user_id", "left_anti").select("event_id", "user_id")


@query("t05_latest_run", "SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type <> 'error' GROUP BY event_type", base=False)
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    last = tables(spark, d, "events").where("event_type <> 'error'").groupBy("event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return last.select("event_type", "m.value")


@modelled("s17_lookup_sheet", "SELECT act.id, title, url, code AS first_category FROM act LEFT JOIN cat ON cat.id = act.id AND cat.is_primary WHERE review_status IS NULL AND status = 'REPORTABLE'")
def lookup_sheet(u: Universe, spark: SparkSession) -> DataFrame:
    """Unchecked activities with their primary category, as a sheet to fill in."""
    first = u.categories.where("is_primary").select("id", F.col("code").alias("first_category"))
    open_ = u.activities.where("review_status is null and status = 'REPORTABLE'").select("id", "title", "url")
    return open_.join(first, "id", "left")


@query("s19_fingerprints", "SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS length FROM documents", base=False)
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 and byte length of every whole text."""
    return tables(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("length"))


@modelled("s20_seed_dimensions", "SELECT code, name, place::INT AS place FROM categories")
def seed_dimensions(u: Universe, spark: SparkSession) -> DataFrame:
    """The category dimension's reference rows."""
    return spark.createDataFrame([(c, PUBLIC_NAMES[c], i) for i, c in enumerate(CATEGORIES)], "code string, name string, place int")
