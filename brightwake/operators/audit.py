"""Audited mutations, runs and incremental import, as logs that are folded, and the checks after them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.model import CATEGORIES, DEFAULT_STAKEHOLDER, Universe, modelled, query, tables
from ..sources.store import stored_table
from .changes import IMMUTABLE, checked_change
from .evaluate import golden_accuracy, macro_micro, per_label_query, rates
from .ranking import numbered

#: Fields of a record in the change log that may be edited.
EDITABLE = ("click", "purchase", "signup", "view")


def history(changes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The changes with the value each replaced (``old``); a change to the same value is none."""
    old = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return changes.withColumn("old", old).where(~F.col("old").eqNullSafe(F.col(value)))


def checked(changes: DataFrame, field: str, fields: tuple[str, ...]) -> DataFrame:
    """The changes with an ``error``: of an immutable or an unknown field."""
    known = [checked_change(f, list(fields)) for f in fields]
    error = F.when(F.col(field).isin(*IMMUTABLE), "immutable").when(~F.col(field).isin(*known), "unknown_field")
    return changes.withColumn("error", error)


@query(
    "m05_history",
    """WITH h AS (SELECT user_id, event_type AS field, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old, value AS new, ts FROM events WHERE event_type <> 'error')
SELECT * FROM h WHERE old IS DISTINCT FROM new""",
    base=False,
)
def change_history(spark: SparkSession, d: str) -> DataFrame:
    """History rows of all accepted edits; edits of unknown fields are refused."""
    log = checked(tables(spark, d, "events"), "event_type", EDITABLE).where("error is null")
    return history(log, ["user_id", "event_type"], ["ts", "event_id"], "value").select("user_id", F.col("event_type").alias("field"), "old", F.col("value").alias("new"), "ts")


@query("m05_refused", "SELECT event_type AS field, 'unknown_field' AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1", base=False)
def refused_changes(spark: SparkSession, d: str) -> DataFrame:
    return checked(tables(spark, d, "events"), "event_type", EDITABLE).where("error is not null").groupBy(F.col("event_type").alias("field"), "error").agg(F.count("*").alias("n"))


def rebuilt(u: Universe) -> DataFrame:
    """The reportable table: facts with their labels in a fixed order; the same rows whatever the partitioning."""
    codes = u.categories.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("code")), ";").alias("codes"))
    return u.activities.where("status = 'REPORTABLE'").join(codes, "id", "left").select("id", "title", "period", "codes")


@modelled("m03_rebuild", "SELECT count(*) AS n, 0::BIGINT AS differences FROM act WHERE status = 'REPORTABLE'")
def deterministic_rebuild(u: Universe, spark: SparkSession) -> DataFrame:
    """Rows of a rebuild, and rows by which a rebuild from other partitions differs."""
    again = Universe(u.activities.repartition(7, "day"), u.categories.repartition(5, "code"), u.departments, u.stakeholders, u.members)
    row = F.xxhash64("id", "title", "period", "codes").cast("decimal(20,0)")
    one, two = (rebuilt(x).agg(F.count("*").alias(f"n{i}"), F.sum(row).alias(f"h{i}")) for i, x in enumerate((u, again)))
    both = one.crossJoin(two)  # one row by one row
    return both.select(F.col("n0").alias("n"), F.when(F.col("h0").eqNullSafe(F.col("h1")), F.abs(F.col("n0") - F.col("n1"))).otherwise(F.greatest("n0", "n1")).alias("differences"))


def published(staged: DataFrame, live: DataFrame, value: str = "title") -> DataFrame:
    """(id, value, action): the live table after publishing ``staged``; publishing again changes nothing."""
    joined = live.select("id", F.col(value).alias("old")).join(staged.select("id", F.col(value).alias("new")), "id", "full")
    action = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "inserted").when(F.col("old") != F.col("new"), "updated").otherwise("unchanged")
    return joined.select("id", F.coalesce("new", "old").alias(value), action.alias("action"))


_PUBLISH = """, live AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'Old' ELSE title END AS title FROM act WHERE id % 3 = 0), staged AS (SELECT id, title FROM act WHERE status = 'REPORTABLE'),
p AS (SELECT coalesce(l.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'kept' WHEN l.id IS NULL THEN 'inserted' WHEN l.title <> s.title THEN 'updated' ELSE 'unchanged' END AS action FROM live l FULL JOIN staged s ON l.id = s.id)"""


@modelled("m06_publish", f"{_PUBLISH} SELECT 'first' AS run, action, count(*) AS n FROM p GROUP BY action UNION ALL SELECT 'second', CASE action WHEN 'kept' THEN 'kept' ELSE 'unchanged' END, count(*) FROM p GROUP BY 2")
def publish(u: Universe, spark: SparkSession) -> DataFrame:
    """What two runs of the same publication do."""
    live = u.activities.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, "Old").otherwise(F.col("title")).alias("title"))
    staged = u.activities.where("status = 'REPORTABLE'").select("id", "title")
    first = stored_table(published(staged, live), "published")
    second = published(staged, first.select("id", "title"))
    runs = (x.groupBy(F.lit(name).alias("run"), "action").agg(F.count("*").alias("n")) for name, x in (("first", first), ("second", second)))
    return reduce(DataFrame.unionByName, runs)


def problems(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules.items())))


@modelled(
    "m08_validated_changes",
    """SELECT id, array_to_string(list_filter([CASE WHEN id % 7 = 0 THEN 'title' END, CASE WHEN day > DATE '1998-06-01' THEN 'date' END, CASE WHEN price > 300000 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS problems,
CASE WHEN id % 7 = 0 OR day > DATE '1998-06-01' OR price > 300000 THEN 'refused' WHEN id % 2 = 0 THEN 'updated' ELSE 'added' END AS action FROM act""",
)
def validated_changes(u: Universe, spark: SparkSession) -> DataFrame:
    """New and changed records with what is wrong with them; only sound ones are applied."""
    title = F.when(F.col("id") % 7 == 0, F.lit(" ")).otherwise(F.col("title"))
    wrong = problems({"title": F.trim(title) == "", "date": F.col("day") > F.lit("1998-06-01").cast("date"), "price": F.col("price") > 300000})
    action = F.when(F.size(wrong) > 0, "refused").when(F.col("id") % 2 == 0, "updated").otherwise("added")
    return u.activities.select("id", F.array_join(wrong, ",").alias("problems"), action.alias("action"))


@query(
    "m09_review_actions",
    """SELECT user_id AS id, CASE arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('purchase', 'error')) WHEN 'purchase' THEN 'APPROVED' WHEN 'error' THEN 'REJECTED' ELSE 'OPEN' END AS status,
coalesce(bool_or(event_type = 'click'), false) AS source_verified, coalesce(bool_or(event_type = 'signup'), false) AS duplicate, max(value) FILTER (event_type = 'view') AS edited, count(*) AS actions FROM events GROUP BY user_id""",
    base=False,
)
def review_actions(spark: SparkSession, d: str) -> DataFrame:
    """State of each record after its log of actions: approve and reject (the latest counts), verify, mark as duplicate, edit."""
    e = tables(spark, d, "events")
    kind = F.col("event_type")
    decided = F.max_by(F.when(kind.isin("purchase", "error"), kind), F.when(kind.isin("purchase", "error"), F.struct("ts", "event_id")))
    status = F.when(F.col("decided") == "purchase", "APPROVED").when(F.col("decided") == "error", "REJECTED").otherwise("OPEN")
    states = e.groupBy(F.col("user_id").alias("id")).agg(decided.alias("decided"), F.bool_or(kind == "click").alias("source_verified"), F.bool_or(kind == "signup").alias("duplicate"), F.max(F.when(kind == "view", F.col("value"))).alias("edited"), F.count("*").alias("actions"))
    return states.select("id", status.alias("status"), "source_verified", "duplicate", "edited", "actions")


_TARGET = "CASE WHEN id % 10 = 1 THEN id - 1 ELSE id END"


@modelled("m10_merge_all", "SELECT kind, count(*) AS links, count(DISTINCT id) AS ids FROM (" + " UNION ALL ".join(f"SELECT DISTINCT '{kind}' AS kind, {_TARGET} AS id, code FROM {t}" for kind, t in (("categories", "cat"), ("departments", "dep"), ("stakeholders", "stk"))) + ") GROUP BY kind")
def merge_all(u: Universe, spark: SparkSession) -> DataFrame:
    """All child tables point to the survivors, without repeated pairs."""
    target = F.when(F.col("id") % 10 == 1, F.col("id") - 1).otherwise(F.col("id"))
    # A survivor's links are one set, which is distinct by itself.
    each = (df.groupBy(target.alias("id")).agg(F.size(F.collect_set(F.struct("code"))).alias("n")).select(F.lit(kind).alias("kind"), "id", "n") for kind, df in (("categories", u.categories), ("departments", u.departments), ("stakeholders", u.stakeholders)))
    return reduce(DataFrame.unionByName, each).groupBy("kind").agg(F.sum("n").alias("links"), F.count("id").alias("ids"))


@modelled("m14_safe_merges", "SELECT a.id, m.survivor, a.id <> m.survivor AS merged FROM act a JOIN (SELECT title, day, customer, min(id) AS survivor, count(*) AS n FROM act GROUP BY ALL HAVING count(*) > 1) m ON a.title = m.title AND a.day = m.day AND a.customer = m.customer")
def safe_merges(u: Universe, spark: SparkSession) -> DataFrame:
    """Members of the clusters of equal title, day and customer, with the record that stays."""
    clusters = u.activities.groupBy("title", "day", "customer").agg(F.min("id").alias("survivor"), F.count("*").alias("n")).where("n > 1").drop("n")
    return u.activities.join(clusters, ["title", "day", "customer"]).select("id", "survivor", (F.col("id") != F.col("survivor")).alias("merged"))


@modelled("m15_stakeholder_links", f"SELECT id, code FROM stk UNION SELECT id, '{DEFAULT_STAKEHOLDER}' FROM act WHERE stakeholder_display IS NULL")
def stakeholder_links(u: Universe, spark: SparkSession) -> DataFrame:
    """The links after those without a stakeholder got the default one."""
    new = u.activities.where("stakeholder_display is null").select("id", F.lit(DEFAULT_STAKEHOLDER).alias("code"))
    return u.stakeholders.select("id", "code").unionByName(new).distinct()


@modelled("m15_post_checks", "SELECT 'without' AS check_name, count(*) AS n FROM act WHERE stakeholder_display IS NULL AND id NOT IN (SELECT id FROM act WHERE stakeholder_display IS NULL) UNION ALL SELECT 'orphans', count(*) FROM stk WHERE id NOT IN (SELECT id FROM act)")
def stakeholder_checks(u: Universe, spark: SparkSession) -> DataFrame:
    """After the migration nothing is without a stakeholder, and no link is without a fact."""
    links = stakeholder_links(u, spark)
    without = u.activities.join(links, "id", "left_anti").agg(F.lit("without").alias("check_name"), F.count("*").alias("n"))
    orphans = links.join(u.activities, "id", "left_anti").agg(F.lit("orphans").alias("check_name"), F.count("*").alias("n"))
    return without.unionByName(orphans)


_DECIDE = "CASE WHEN score >= 8 THEN 'PROMO' WHEN score >= 3 THEN code END"


@modelled(
    "m15c_redecide",
    f"SELECT act.id, code AS old, {_DECIDE} AS new, CASE WHEN {_DECIDE} IS NULL THEN 'unresolved' WHEN {_DECIDE} = code THEN 'unchanged' ELSE 'move' END AS action, CASE WHEN {_DECIDE} <> code THEN 'category: ' || code || ' -> ' || {_DECIDE} END AS note FROM act JOIN cat USING (id) WHERE is_primary",
)
def redecide(u: Universe, spark: SparkSession) -> DataFrame:
    """Primary categories decided anew; a move leaves a line in the history, an open case stays as it is."""
    rows = u.activities.select("id", "score").join(u.categories.where("is_primary").select("id", "code"), "id")
    new = F.when(F.col("score") >= 8, CATEGORIES[3]).when(F.col("score") >= 3, F.col("code"))
    action = F.when(new.isNull(), "unresolved").when(new == F.col("code"), "unchanged").otherwise("move")
    note = F.when(new != F.col("code"), F.concat(F.lit("category: "), "code", F.lit(" -> "), new))
    return rows.select("id", F.col("code").alias("old"), new.alias("new"), action.alias("action"), note.alias("note"))


@modelled("m15d_url_period", "SELECT id, CASE WHEN id % 4 = 0 THEN '1997-98' ELSE academic_year END AS year, CASE WHEN id % 11 = 0 THEN 'Named ' || id ELSE title END AS title, CASE WHEN id % 11 = 0 THEN 'review: title corrected' END AS note FROM act")
def url_period(u: Universe, spark: SparkSession) -> DataFrame:
    """The year that a source's URL states wins, and corrections of named records come with a note."""
    url = F.when(F.col("id") % 4 == 0, F.lit("https://example.org/reports/1997-98/list"))
    stated = F.nullif(F.regexp_extract(url, r"/((?:19|20)\d{2}-\d{2})(?:/|$)", 1), F.lit(""))
    corrections = u.activities.where("id % 11 = 0").select("id", F.concat(F.lit("Named "), F.col("id").cast("string")).alias("corrected"))
    rows = u.activities.select("id", "title", F.coalesce(stated, F.col("academic_year")).alias("year")).join(corrections, "id", "left")
    return rows.select("id", "year", F.coalesce("corrected", "title").alias("title"), F.when(F.col("corrected").isNotNull(), "review: title corrected").alias("note"))


@modelled("m15e_flags", "SELECT id, list_filter([CASE WHEN title ILIKE 'low order%' THEN 'boilerplate_title' END, CASE WHEN url IS NULL AND score < 2 THEN 'no_evidence' END, CASE WHEN academic_year IS NULL THEN 'no_year' END], lambda x: x IS NOT NULL) AS flags FROM act")
def cleanup_flags(u: Universe, spark: SparkSession) -> DataFrame:
    rules = {"boilerplate_title": F.col("title").ilike("low order%"), "no_evidence": F.col("url").isNull() & (F.col("score") < 2), "no_year": F.col("academic_year").isNull()}
    return u.activities.select("id", problems(rules).alias("flags"))


_RUNS = "SELECT date_trunc('day', ts)::DATE AS run, event_id, event_type, value, ts FROM events"


@query("m16_run_log", f"WITH r AS ({_RUNS}) SELECT run, count(*) AS fetched, count(*) FILTER (event_type = 'error') AS errors, min(event_id) FILTER (event_type = 'error') AS first_error, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'failed' ELSE 'partial' END AS status FROM r GROUP BY run", base=False)
def run_log(spark: SparkSession, d: str) -> DataFrame:
    """One log row a run: what it fetched, its errors, the first of them, and how it ended."""
    error = F.col("event_type") == "error"
    runs = tables(spark, d, "events").groupBy(F.to_date("ts").alias("run")).agg(F.count("*").alias("fetched"), F.count_if(error).alias("errors"), F.min(F.when(error, F.col("event_id"))).alias("first_error"))
    return runs.withColumn("status", F.when(F.col("errors") == 0, "success").when(F.col("errors") == F.col("fetched"), "failed").otherwise("partial"))


@query(
    "t06_notify_once",
    f"WITH r AS ({_RUNS}), s AS (SELECT run, count(*) FILTER (event_type = 'signup') AS fresh FROM r GROUP BY run) SELECT run, fresh FROM s WHERE fresh > 0 AND run > DATE '2024-01-10' ORDER BY run DESC LIMIT 1",
    base=False,
)
def notify_once(spark: SparkSession, d: str) -> DataFrame:
    """The latest run with new rows that was not announced yet; the last announced run is the state."""
    runs = tables(spark, d, "events").groupBy(F.to_date("ts").alias("run")).agg(F.count_if(F.col("event_type") == "signup").alias("fresh"))
    return runs.where((F.col("fresh") > 0) & (F.col("run") > F.lit("2024-01-10").cast("date"))).orderBy(F.desc("run")).limit(1)


@query("t07_next_trigger", "SELECT event_id, date_trunc('week', ts - INTERVAL 9 HOUR) + INTERVAL 7 DAY + INTERVAL 9 HOUR AS due FROM events", base=False)
def next_trigger(spark: SparkSession, d: str) -> DataFrame:
    """The next Monday, 9 o'clock, after each event: when a weekly run is due."""
    week = F.date_trunc("week", F.col("ts") - F.expr("INTERVAL 9 HOURS"))
    return tables(spark, d, "events").select("event_id", (week + F.expr("INTERVAL 7 DAYS 9 HOURS")).alias("due"))


@query(
    "t08_incremental_import",
    """WITH r AS (SELECT doc_id, text, doc_id % 5 = 0 AS incoming FROM documents), old AS (SELECT DISTINCT text FROM r WHERE NOT incoming), top AS (SELECT max(doc_id) AS m FROM r WHERE NOT incoming),
n AS (SELECT text, min(doc_id) AS first_row FROM r WHERE incoming AND text NOT IN (SELECT text FROM old) GROUP BY text), k AS (SELECT text, first_row, (SELECT m FROM top) + row_number() OVER (ORDER BY first_row) AS post_id FROM n)
SELECT r.doc_id AS row_id, k.post_id, CASE WHEN k.text IS NULL THEN 'existing' WHEN r.doc_id = k.first_row THEN 'new_post' ELSE 'occurrence' END AS action FROM r LEFT JOIN k ON r.text = k.text WHERE r.incoming""",
    base=False,
)
def incremental_import(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an incoming sheet: new posts get the ids that follow the greatest, their repeats become occurrences of them.

    Ids follow the rows' order: rows are sorted by range, and each part begins after the parts before it.
    """
    rows = tables(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", (F.col("doc_id") % 5 == 0).alias("incoming"))
    old = rows.where("not incoming")
    first = rows.where("incoming").join(old.select("text").distinct(), "text", "left_anti").groupBy(F.sha2("text", 256).alias("key")).agg(F.min("row_id").alias("first_row"))
    placed = stored_table(numbered(stored_table(first, "import-new"), ["first_row"], "place"), "import-ids")
    top = old.agg(F.max("row_id").alias("top"))
    ids = placed.crossJoin(top).select("key", "first_row", (F.coalesce("top", F.lit(0)) + F.col("place")).alias("post_id"))  # by one row
    joined = rows.where("incoming").withColumn("key", F.sha2("text", 256)).join(ids, "key", "left")
    action = F.when(F.col("post_id").isNull(), "existing").when(F.col("row_id") == F.col("first_row"), "new_post").otherwise("occurrence")
    return joined.select("row_id", "post_id", action.alias("action"))


@query("t09_within_batch", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) = 1 AS fresh FROM events", base=False)
def within_batch(spark: SparkSession, d: str) -> DataFrame:
    """In a batch (a day) only the first row of a key is new; the later ones see it."""
    e = tables(spark, d, "events")
    first = e.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.min(F.struct("ts", "event_id")).alias("m")).select(F.col("m.event_id").alias("event_id"), F.lit(True).alias("fresh"))
    return e.select("event_id").join(first, "event_id", "left").select("event_id", F.coalesce("fresh", F.lit(False)).alias("fresh"))


@query("s12_mock_source", "SELECT event_id, event_type, value FROM events WHERE event_id > 40 ORDER BY event_id LIMIT 15", base=False)
def mock_source(spark: SparkSession, d: str, cursor: int = 40, batch: int = 15) -> DataFrame:
    """The next batch after a cursor; a batch's size is the feature."""
    return tables(spark, d, "events").where(F.col("event_id") > cursor).select("event_id", "event_type", "value").orderBy("event_id").limit(batch)


@modelled(
    "s16_result_export",
    """, r AS (SELECT id, title, department_display FROM act WHERE period = '1997-98' AND status = 'REPORTABLE') SELECT 'row' AS block, row_number() OVER (ORDER BY id) AS s_no, title AS label, id AS value FROM r
UNION ALL SELECT 'breakdown', row_number() OVER (ORDER BY code), code, count(*) FROM (SELECT unnest(string_split(department_display, '; ')) AS code FROM r) GROUP BY code""",
)
def result_export(u: Universe, spark: SparkSession) -> DataFrame:
    """Numbered rows of a result, and a block that counts them by department."""
    rows = u.activities.where("period = '1997-98' and status = 'REPORTABLE'").select("id", "title", "department_display")
    listed = numbered(rows, ["id"], "s_no").select(F.lit("row").alias("block"), "s_no", F.col("title").alias("label"), F.col("id").alias("value"))
    counted = rows.select(F.explode(F.split("department_display", "; ")).alias("label")).groupBy("label").agg(F.count("*").alias("value"))
    place = F.row_number().over(Window.orderBy("label")).cast("long")  # one row a department
    return listed.unionByName(counted.select(F.lit("breakdown").alias("block"), place.alias("s_no"), "label", "value"))


def crawled(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(page, depth) of the pages reached from ``seeds`` (page) over ``links`` (page, to), each at its least depth."""
    seen = stored_table(seeds.select("page", F.lit(0).alias("depth")), "crawl")
    links = stored_table(links, "crawl-links")
    frontier = seen
    for level in range(1, depth + 1):
        found = frontier.join(links, "page").select(F.col("to").alias("page")).distinct().join(seen, "page", "left_anti")
        frontier = stored_table(found.select("page", F.lit(level).alias("depth")), "crawl")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


@query(
    "s09_crawl_frontier",
    """WITH RECURSIVE l AS (SELECT a.page_id AS page, b.page_id AS target FROM pages a JOIN pages b ON b.page_id = 3 * a.page_id + 1 OR b.page_id = 3 * a.page_id + 2 OR b.page_id = a.page_id - 2),
r AS (SELECT 0::BIGINT AS page, 0 AS depth UNION SELECT l.target, depth + 1 FROM r JOIN l USING (page) WHERE depth < 4) SELECT page, min(depth) AS depth FROM r GROUP BY page""",
    base=False,
)
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first search with a depth limit; a page links to two later ones and one before."""
    p = tables(spark, d, "pages").select(F.col("page_id").cast("long").alias("page"))
    targets = F.explode(F.array(F.col("page") * 3 + 1, F.col("page") * 3 + 2, F.col("page") - 2))
    links = p.select("page", targets.alias("to")).join(p.toDF("to"), "to", "left_semi")
    return crawled(links, p.where("page = 0"), 4)


@modelled("p19_id_list", "SELECT id, title FROM act WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1)")
def id_list(u: Universe, spark: SparkSession) -> DataFrame:
    """A long list of ids is a table and a semi-join, whatever its length."""
    wanted = u.activities.where("id % 3 = 1").select("id").distinct()
    return u.activities.join(wanted, "id", "left_semi").select("id", "title")


@modelled("j05_not_in", "SELECT id FROM act WHERE id NOT IN (SELECT id FROM stk WHERE code = 'STAFF')")
def not_in(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.join(u.stakeholders.where("code = 'STAFF'"), "id", "left_anti").select("id")


@modelled("j06_not_exists", "SELECT id FROM act WHERE NOT EXISTS (SELECT 1 FROM dep WHERE dep.id = act.id AND code = 'General')")
def not_exists(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.join(u.departments.where("code = 'General'"), "id", "left_anti").select("id")


@query("j01_customer_metadata", "SELECT o_orderkey AS id, c_name AS name, c_acctbal AS balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey", base=False)
def customer_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The fact with its one-to-one metadata row, kept where there is none."""
    joined = tables(spark, d, "orders").join(tables(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


_SETS = """, gold AS (SELECT id, code FROM cat), told AS (SELECT id, code FROM cat WHERE is_primary UNION SELECT id, 'PROMO' FROM act WHERE score < 4),
c AS (SELECT count(*) FILTER (g.id IS NOT NULL AND t.id IS NOT NULL) AS tp, count(*) FILTER (g.id IS NULL) AS fp, count(*) FILTER (t.id IS NULL) AS fn FROM gold g FULL JOIN told t ON g.id = t.id AND g.code = t.code)"""


@modelled("e04_entity_sets", f"{_SETS} SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c")
def entity_sets(u: Universe, spark: SparkSession) -> DataFrame:
    """Precision, recall and F1 of predicted sets of entities against gold sets, over all records."""
    gold = u.categories.select("id", "code").withColumn("gold", F.lit(True))
    told = u.categories.where("is_primary").select("id", "code").unionByName(u.activities.where("score < 4").select("id", F.lit("PROMO").alias("code"))).distinct().withColumn("told", F.lit(True))
    both = gold.join(told, ["id", "code"], "full")
    counts = both.agg(F.count_if(F.col("gold") & F.col("told")).alias("tp"), F.count_if(F.col("gold").isNull()).alias("fp"), F.count_if(F.col("told").isNull()).alias("fn"))
    return counts.withColumns(rates()).select("tp", "fp", "fn", *(F.round(x, 4).alias(x) for x in ("precision", "recall", "f1")))


@modelled("e05_match_accuracy", "SELECT round(avg((review_status = 'APPROVED')::INT), 4) AS accuracy, count(*) AS n FROM act WHERE coalesce(review_status, 'pending-batch') <> 'pending-batch'")
def match_accuracy(u: Universe, spark: SparkSession) -> DataFrame:
    """Share of checked matches that are right; those that wait in a batch are left out."""
    checked_ = u.activities.where(F.coalesce("review_status", F.lit("pending-batch")) != "pending-batch")
    return checked_.agg(F.round(F.avg((F.col("review_status") == "APPROVED").cast("int")), 4).alias("accuracy"), F.count("*").alias("n"))


@query("e06_evaluation")
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of a run as (part, name, metric, value) rows."""
    parts = (("overall", "average", macro_micro), ("label", "label", per_label_query), ("golden", "label", golden_accuracy))
    out = []
    for part, key, run in parts:
        df = run(spark, d)
        metrics = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns if c != key)))
        out.append(df.select(F.lit(part).alias("part"), F.col(key).alias("name"), metrics.alias("m")).select("part", "name", "m.*"))
    return reduce(DataFrame.unionByName, out)
