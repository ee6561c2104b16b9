"""Questions in plain English to safe plans, and plans to DataFrames.

A question becomes a frozen :class:`Plan` by ordered rules on the driver; only
members of the model's own vocabularies ever reach a plan, as literals of the
Column API, so no text of the user is run as SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Filter, narrowed
from .model import CATEGORIES, GENERAL, GENERAL_MEMBER, PERIODS, PUBLIC_NAMES, Universe, master, modelled

MAX_QUESTION = 500
MAX_TOP = 50
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "STAFF")
_AXES = {"department": ("department", "nation"), "category": ("category", "categories", "kind"), "period": ("year", "period"), "stakeholder": ("stakeholder", "segment")}


#: Other names of departments; those of one or two letters must be in capitals.
ALIASES = {"first nation": "NATION_1", "second nation": "NATION_2", "sixth nation": "NATION_6", "N7": "NATION_7", "EX": "NATION_8"}
#: Words of each category for questions that name none, with the category that wins a tie first.
CUES = {"PROMO": ("promotion", "advert", "campaign offer"), "LARGE": ("large", "mass gathering", "big"), "SMALL": ("small", "tiny"), "ECONOMY": ("economy", "low cost programme"), "MEDIUM": ("medium", "middle sized"), "STANDARD": ("standard", "regular")}


@dataclass(frozen=True)
class Plan:
    """What to compute: ``kind``, the axis to group by, a limit, one or two filters, and a phrase of the activity's texts."""

    kind: str
    filters: Filter = Filter()
    against: Filter | None = None
    axis: str | None = None
    limit: int = 50
    message: str = ""
    phrase: str | None = None


def _whole(word: str, text: str) -> bool:
    return re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text) is not None


def _period(text: str) -> str | None:
    for p in PERIODS:
        if p.lower() in text:
            return p
    years = set(re.findall(r"(?<!\d)((?:19|20)\d{2})(?![\d-])", text))
    found = [p for p in PERIODS[:5] if p[:4] in years]
    return found[0] if len(found) == 1 else None


def _longest(options: dict[str, str], text: str) -> str | None:
    hits = [(len(k), v) for k, v in options.items() if _whole(k, text)]
    return max(hits)[1] if hits else None


def _range(text: str) -> tuple[int, int] | None:
    """First years of a range such as from 1996 to 1998, or between 1996-97 and 1998-99."""
    year = r"((?:19|20)\d{2})(?:-\d{2})?(?!\d)"
    found = re.search(rf"(?<!\w)(?:from|between) {year} (?:to|and|until) {year}", text)
    return (min(int(found[1]), int(found[2])), max(int(found[1]), int(found[2]))) if found else None


def _department(text: str, raw: str) -> str | None:
    named = re.search(r"(?<!\w)nation[_ ](\d{1,2})(?!\w)", text)
    if named:
        return f"NATION_{int(named[1])}"
    long = _longest({k.lower(): v for k, v in ALIASES.items() if len(k) > 2}, text)
    return long or _longest({k: v for k, v in ALIASES.items() if len(k) <= 2}, raw)


def ground(text: str, raw: str = "") -> Filter:
    """The filter that the text names, by longest whole-word matches; ``raw`` is the text with its capitals."""
    names = {c.lower(): c for c in CATEGORIES} | {PUBLIC_NAMES[c].lower(): c for c in CATEGORIES}
    segments = {form: s for s in _SEGMENTS for form in (s.lower(), s.lower() + "s")}
    years = _range(text)
    return Filter(
        period=None if years else _period(text),
        category=_longest(names, text),
        department=_department(text, raw),
        stakeholder=_longest(segments, text),
        from_year=years[0] if years else None,
        to_year=years[1] if years else None,
    )


def event_phrase(question: str) -> str | None:
    """What the question quotes, else its longest run of two or more capitalised words that are no known names."""
    quoted = re.search(r'"([^"]{2,})"', question)
    if quoted:
        return quoted[1].strip().lower()
    known = "|".join(re.escape(k) for k in sorted([*PUBLIC_NAMES.values(), *ALIASES], key=len, reverse=True))
    masked = re.sub(rf"(?i)(?<!\w)(?:{known}|nation[_ ]\d+)(?!\w)", "|", question)
    runs = re.findall(r"(?<!^)(?<![.?!] )\b[A-Z][\w'-]*(?: [A-Z][\w'-]*)+", masked)
    return max(runs, key=len).lower() if runs else None


def weighted_category(text: str) -> str | None:
    """The category whose cues in the text have most words; the first of the vocabulary on a tie."""
    weight = {c: sum(len(w.split()) for w in words if w in text) for c, words in CUES.items()}
    best = max(weight, key=lambda c: weight[c])
    return best if weight[best] else None


def _axis(text: str) -> str | None:
    found = [(text.index(w), a) for a, words in _AXES.items() for w in words if _whole(w, text) or _whole(w + "s", text)]
    return min(found)[1] if found else None


def interpret(question: str) -> Plan:
    """Rules in order: too long, unknown year, compare, top n, ranking, extremes, trend, breakdown, count, list."""
    text = " ".join(question.lower().split())
    if not text or len(text) > MAX_QUESTION:
        return Plan("unsupported", message="Ask one question of at most 500 characters.")
    years = re.findall(r"(?<!\d)((?:19|20)\d{2})-\d{2}(?!\d)", text)
    if any(not any(p.startswith(y) for p in PERIODS) for y in years):
        return Plan("clarification", message="The data has " + ", ".join(PERIODS) + ".")
    raw = " ".join(question.split())
    # What is quoted is looked for in the texts and names nothing.
    bare = re.sub(r'"[^"]*"', " ", raw)
    f, axis = ground(bare.lower(), bare), _axis(bare.lower())
    two = re.match(r"compare (.+) (?:and|with|versus|vs\.?) (.+)", text)
    if text.startswith("compare") and axis and not two:
        return Plan("rows", f, axis=axis)
    if two:
        return Plan("compare", ground(two[1]), ground(two[2]))
    if re.search(r"\b(tell me about|details? of|what was|describe)\b", text) and event_phrase(raw):
        return Plan("detail", f, limit=10, phrase=event_phrase(raw))
    if re.search(r"\b(share|rate|percentage)\b", text) and re.search(r"\breportable\b", text):
        return Plan("rate", f, axis=axis)
    if re.search(r"\bundated\b", text):
        return Plan("undated", f)
    top = re.search(r"(?<!\w)top (\d+)", text)
    if top and axis:
        return Plan("top", f, axis=axis, limit=max(1, min(MAX_TOP, int(top[1]))))
    if axis and re.search(r"\brank", text):
        return Plan("ranking", f, axis=axis)
    if axis and re.search(r"\b(most|highest|largest)\b", text):
        return Plan("highest", f, axis=axis, limit=1)
    if axis and re.search(r"\b(fewest|least|lowest|smallest)\b", text):
        return Plan("lowest", f, axis=axis, limit=1)
    if re.search(r"\b(trend|over the years|year by year|year-wise)\b", text):
        return Plan("trend", f, axis="period")
    if axis and re.search(r"\b(by|per|breakdown|each)\b", text):
        return Plan("breakdown", f, axis=axis)
    if re.search(r"\b(how many|count|number of)\b", text):
        return Plan("count", f)
    if re.search(r"\b(list|show|which|find)\b", text):
        return Plan("list", f, phrase=event_phrase(raw))
    return Plan("unsupported", message="Ask for a count, list, comparison, ranking, trend or breakdown of activities.")


def _grouped(u: Universe, f: Filter, axis: str) -> DataFrame:
    """(key, n): distinct activities of each member of the axis."""
    rows = narrowed(u, f)
    if axis == "period":
        return rows.groupBy(F.col("period").alias("key")).agg(F.count("*").alias("n"))
    bridge = {"department": u.departments, "category": u.categories, "stakeholder": u.stakeholders}[axis]
    # A bridge has each pair once.
    return rows.select("id").join(bridge, "id").groupBy(F.col("code").alias("key")).agg(F.count("*").alias("n"))


def _mentions(phrase: str | None):
    """Whether the activity's title, description or written day holds the phrase."""
    told = F.lower(F.concat_ws(" ", "title", "description", F.date_format("day", "d MMMM yyyy")))
    return F.contains(told, F.lit(phrase)) if phrase else F.lit(True)


def _axis_members(u: Universe, spark: SparkSession, axis: str) -> DataFrame:
    """(key): all members of the axis, used or not."""
    if axis == "department":
        return u.members.select(F.when(F.col("code") == GENERAL_MEMBER, GENERAL).otherwise(F.col("code")).alias("key"))
    names = {"period": PERIODS, "category": CATEGORIES, "stakeholder": _SEGMENTS}[axis]
    return master(spark, tuple(names), "key").select("key")


def answer(u: Universe, plan: Plan, spark: SparkSession) -> DataFrame:
    """The plan's result."""
    if plan.kind in ("unsupported", "clarification"):
        return spark.createDataFrame([(plan.kind, plan.message)], "status string, message string")
    if plan.kind == "count":
        return narrowed(u, plan.filters).agg(F.count("*").alias("n"))
    if plan.kind == "list":
        return narrowed(u, plan.filters).where(_mentions(plan.phrase)).select("id", "title", "day").orderBy("day", "id").limit(plan.limit)
    if plan.kind == "detail":
        return narrowed(u, plan.filters).where(_mentions(plan.phrase)).select("id", "title", "description", "day").orderBy("id").limit(plan.limit)
    if plan.kind == "undated":
        return narrowed(u, plan.filters).where("academic_year is null").agg(F.count("*").alias("n"))
    if plan.kind == "rate":
        reportable = F.count_if(F.col("status") == "REPORTABLE")
        key = F.col("period").alias("key") if plan.axis == "period" else F.lit("all").alias("key")
        return narrowed(u, plan.filters).groupBy(key).agg(reportable.alias("reportable"), F.count("*").alias("n"), F.round(reportable / F.count("*"), 4).alias("rate"))
    if plan.kind == "compare":
        each = [narrowed(u, f).agg(F.lit(side).alias("side"), F.count("*").alias("n")) for side, f in (("first", plan.filters), ("second", plan.against))]
        return each[0].unionByName(each[1])
    counted = _grouped(u, plan.filters, plan.axis)
    if plan.kind in ("highest", "top"):
        return counted.orderBy(F.desc("n"), F.desc("key")).limit(plan.limit)
    if plan.kind == "lowest":
        return counted.orderBy("n", "key").limit(1)
    if plan.kind in ("trend", "rows"):
        return _axis_members(u, spark, plan.axis).join(counted, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    return counted


def ask(u: Universe, spark: SparkSession, question: str) -> DataFrame:
    return answer(u, interpret(question), spark)


def bounded(u: Universe, spark: SparkSession, question: str, limit: int = 20) -> DataFrame:
    """The older, narrower way: labels by inner joins, nothing for a year that is not there, and at most ``limit`` rows."""
    text = " ".join(question.lower().split())
    category, period = weighted_category(text), _period(text)
    unknown = bool(re.findall(r"(?<!\d)(?:19|20)\d{2}(?:-\d{2})?(?!\d)", text)) and period is None
    rows = u.activities.where(F.lit(not unknown) & (F.lit(True) if period is None else F.col("period") == period))
    links = u.categories.where(F.col("code") == category) if category else u.categories.where("is_primary")
    note = "The year is not in the data." if unknown else ""
    return rows.join(links.select("id", "code"), "id").select("id", "title", F.col("code").alias("category"), F.lit(note).alias("note")).orderBy("id").limit(limit)


def dispatched(u: Universe, spark: SparkSession, question: str) -> DataFrame:
    """The newer way if there are metadata rows (displays), else the older one."""
    described = u.activities.where("department_display is not null").limit(1)
    return bounded(u, spark, question) if described.isEmpty() else ask(u, spark, question)


_ASKED = {
    "q07_count": ("How many large events did NATION_3 hold in 1998-99?", "SELECT count(*) AS n FROM act WHERE period = '1998-99' AND list_contains(string_split(department_display, '; '), 'NATION_3') AND id IN (SELECT id FROM cat WHERE code = 'LARGE')"),
    "q07_list": ("List the promotions of the building segment in 1996-97", "SELECT id, title, day FROM act WHERE period = '1996-97' AND id IN (SELECT id FROM cat WHERE code = 'PROMO') AND id IN (SELECT id FROM stk WHERE code = 'BUILDING') ORDER BY day, id LIMIT 50"),
    "q09_compare": ("Compare small events in 1997-98 with small events in 1998-99", "SELECT 'first' AS side, count(*) AS n FROM act WHERE period = '1997-98' AND id IN (SELECT id FROM cat WHERE code = 'SMALL') UNION ALL SELECT 'second', count(*) FROM act WHERE period = '1998-99' AND id IN (SELECT id FROM cat WHERE code = 'SMALL')"),
    "q10_highest": ("Which department has the most activities in 1999-00?", "SELECT code AS key, count(DISTINCT id) AS n FROM dep JOIN act USING (id) WHERE period = '1999-00' GROUP BY code ORDER BY n DESC, key DESC LIMIT 1"),
    "q10_lowest": ("Which category has the fewest activities?", "SELECT code AS key, count(DISTINCT id) AS n FROM cat GROUP BY code ORDER BY n, key LIMIT 1"),
    "q10_top": ("Top 7 departments for promotions", "SELECT code AS key, count(DISTINCT id) AS n FROM dep WHERE id IN (SELECT id FROM cat WHERE code = 'PROMO') GROUP BY code ORDER BY n DESC, key DESC LIMIT 7"),
    "q10_ranking": ("Rank the stakeholders", "SELECT code AS key, count(DISTINCT id) AS n FROM stk GROUP BY code"),
    "q10_trend": ("Show the trend of economy programmes", "SELECT p.period AS key, count(act.id) AS n FROM periods p LEFT JOIN act ON act.period = p.period AND act.id IN (SELECT id FROM cat WHERE code = 'ECONOMY') GROUP BY p.period"),
    "q10_breakdown": ("Activities by category in 2000-01", "SELECT code AS key, count(DISTINCT id) AS n FROM cat JOIN act USING (id) WHERE period = '2000-01' GROUP BY code"),
    "q12_unsupported": ("Tell me a joke", "SELECT 'unsupported' AS status, 'Ask for a count, list, comparison, ranking, trend or breakdown of activities.' AS message"),
    "q17_unknown_year": ("How many activities in 2015-16?", "SELECT 'clarification' AS status, 'The data has " + ", ".join(PERIODS) + ".' AS message"),
}


_TOLD = "lower(concat_ws(' ', title, description, day(day) || ' ' || strftime(day, '%B') || ' ' || year(day)))"
_ASKED |= {
    "q02_range": ("How many activities from 1996 to 1998?", "SELECT count(*) AS n FROM act WHERE left(academic_year, 4)::INT BETWEEN 1996 AND 1998"),
    "q03_alias": ("How many activities of the First Nation between 1996-97 and 1997-98?", "SELECT count(*) AS n FROM act WHERE left(academic_year, 4)::INT BETWEEN 1996 AND 1997 AND list_contains(string_split(department_display, '; '), 'NATION_1')"),
    "q03_capitals": ("How many small events of EX?", "SELECT count(*) AS n FROM act WHERE list_contains(string_split(department_display, '; '), 'NATION_8') AND id IN (SELECT id FROM cat WHERE code = 'SMALL')"),
    "q05_plural": ("How many activities for automobiles in 1997-98?", "SELECT count(*) AS n FROM act WHERE period = '1997-98' AND id IN (SELECT id FROM stk WHERE code = 'AUTOMOBILE')"),
    "q06_quoted_phrase": ('List activities with "medium order for b" in 1998-99', "SELECT id, title, day FROM act WHERE period = '1998-99' AND contains(" + _TOLD + ", 'medium order for b') ORDER BY day, id LIMIT 50"),
    "q06_capitalised_phrase": ("Show the activities Placed By Customer in 1996-97", "SELECT id, title, day FROM act WHERE period = '1996-97' AND contains(" + _TOLD + ", 'placed by customer') ORDER BY day, id LIMIT 50"),
    "q08_detail": ('Tell me about "order for building" in 1999-00', "SELECT id, title, description, day FROM act WHERE period = '1999-00' AND contains(" + _TOLD + ", 'order for building') ORDER BY id LIMIT 10"),
    "q11_category_rows": ("Compare categories in 1996-97", "SELECT c.code AS key, count(act.id) AS n FROM categories c LEFT JOIN cat ON cat.code = c.code LEFT JOIN act ON act.id = cat.id AND period = '1996-97' GROUP BY c.code"),
    "q11_department_rows": ("Compare the departments for promotions", "SELECT m.code AS key, count(p.id) AS n FROM (SELECT CASE n_name WHEN 'NATION_0' THEN 'General' ELSE n_name END AS code FROM nation) m LEFT JOIN dep ON dep.code = m.code LEFT JOIN (SELECT id FROM cat WHERE code = 'PROMO') p ON p.id = dep.id GROUP BY m.code"),
    "q15_rate": ("What share of activities is reportable?", "SELECT 'all' AS key, count(*) FILTER (status = 'REPORTABLE') AS reportable, count(*) AS n, round(count(*) FILTER (status = 'REPORTABLE') / count(*), 4) AS rate FROM act"),
    "q15_rate_by_year": ("What is the reportable rate for promotions by year?", "SELECT period AS key, count(*) FILTER (status = 'REPORTABLE') AS reportable, count(*) AS n, round(count(*) FILTER (status = 'REPORTABLE') / count(*), 4) AS rate FROM act WHERE id IN (SELECT id FROM cat WHERE code = 'PROMO') GROUP BY period"),
    "q15_undated": ("Count undated activities of NATION_4", "SELECT count(*) AS n FROM act WHERE academic_year IS NULL AND list_contains(string_split(department_display, '; '), 'NATION_4')"),
    "q18_hostile_text": ("x'; DROP TABLE orders; --", "SELECT 'unsupported' AS status, 'Ask for a count, list, comparison, ranking, trend or breakdown of activities.' AS message"),
    "q18_too_long": ("how many " * 100, "SELECT 'unsupported' AS status, 'Ask one question of at most 500 characters.' AS message"),
}


@modelled("q13_bounded", "SELECT act.id, title, code AS category, '' AS note FROM act JOIN cat USING (id) WHERE period = '1997-98' AND code = 'ECONOMY' ORDER BY act.id LIMIT 20")
def bounded_query(u: Universe, spark: SparkSession) -> DataFrame:
    return bounded(u, spark, "low cost programme activities in 1997-98")


@modelled("q13_unknown_year", "SELECT act.id, title, code AS category, 'The year is not in the data.' AS note FROM act JOIN cat USING (id) WHERE false")
def bounded_unknown_year(u: Universe, spark: SparkSession) -> DataFrame:
    return bounded(u, spark, "big activities in 2015-16")


@modelled("q14_dispatch", "SELECT count(*) AS n FROM act WHERE period = '1998-99' AND id IN (SELECT id FROM cat WHERE code = 'LARGE')")
def dispatch_query(u: Universe, spark: SparkSession) -> DataFrame:
    return dispatched(u, spark, "How many large events in 1998-99?")


_HEARD = [
    ("tiny regular standard things", "STANDARD"),
    ("a big campaign offer", "PROMO"),
    ("mass gathering, middle sized", "LARGE"),
    ("nothing at all", None),
]


@modelled("q16_weighted_hit", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {'NULL' if c is None else repr(c)})" for t, c in _HEARD) + ") AS t(text, category)")
def weighted_hit(u: Universe, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, weighted_category(t)) for t, _ in _HEARD], "text string, category string")


_PLANS = [
    ("How many small events of EX?", "count", None, "SMALL", "NATION_8", None),
    ("How many small events of ex?", "count", None, "SMALL", None, None),
    ("Which department has the most promotions in 1997-98", "highest", "department", "PROMO", None, "1997-98"),
    ("Rank years for the second nation", "ranking", "period", None, "NATION_2", None),
    ("top 3 segments", "top", "stakeholder", None, None, None),
    ("Activities in 1999", "unsupported", None, None, None, None),
    ("Count activities in 1999", "count", None, None, None, "1999-00"),
]


@modelled("q01_interpret", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in _PLANS) + ") AS t(question, kind, axis, category, department, period)")
def interpret_query(u: Universe, spark: SparkSession) -> DataFrame:
    """Plans of some questions."""
    rows = [(q, p.kind, p.axis, p.filters.category, p.filters.department, p.filters.period) for q, p in ((row[0], interpret(row[0])) for row in _PLANS)]
    return spark.createDataFrame(rows, "question string, kind string, axis string, category string, department string, period string")


def _asking(question: str):
    return lambda u, spark: ask(u, spark, question)


for _name, (_question, _sql) in _ASKED.items():
    modelled(_name, _sql)(_asking(_question))
