"""Text functions as columns, and the queries that apply them to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import parts
from ..plans.model import GENERAL, Universe, modelled, query, tables

#: Words that are no keywords.
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "held", "will", "was", "have", "been")
#: Category cues of the keyword classifier.
CATEGORY_CUES = {
    "WORKSHOP": ("workshop", "hands-on", "certificate course", "training program", "training programme", "bootcamp"),
    "SEMINAR": ("seminar", "technical talk", "guest talk", "industry talk"),
    "CONFERENCE": ("conference", "international conference", "national conference"),
    "SYMPOSIUM": ("symposium", "symposia"),
    "GUEST_LECTURE": ("guest lecture", "special lecture", "invited lecture", "invited talk", "guest talk"),
    "FDP": ("fdp", "faculty development"),
    "STTP": ("sttp", "short term training", "short-term training"),
    "HACKATHON": ("hackathon", "hack-a-thon"),
    "TECH_FEST": ("technical festival", "tech fest", "symposium cum exhibition"),
    "CULTURAL": ("cultural", "competitions", "dance", "music", "cultural fest"),
    "SPORTS": ("sports", "athletics", "tournament", "cricket", "football", "volleyball", "kabaddi", "fitness"),
    "NCC": ("ncc", "national cadet corps", "cadet"),
    "NSS": ("nss", "national service scheme", "blood donation", "swachh", "village adoption"),
    "CLUB": ("club", "chapter", "society meeting", "ieee", "iste", "iie", "technical association"),
    "OUTREACH": ("outreach", "school students", "extension activity", "community", "rural", "awareness campaign"),
    "INDUSTRY": ("mou", "industry", "collaboration", "industry visit", "memorandum of understanding"),
    "ACHIEVEMENT": ("achievement", "award", "rank holder", "best outgoing", "international recognition", "awarded"),
    "PLACEMENT": ("placement", "recruitment", "campus drive", "placement training", "career guidance", "career development"),
    "INTERNSHIP": ("internship", "industrial training"),
    "RESEARCH": ("research", "consultancy", "patent", "sponsored", "funded project", "seed money"),
    "ALUMNI": ("alumni", "reunion", "silver jubilee reunion", "alumni meet"),
    "ORIENTATION": ("orientation", "convocation", "induction", "fresher"),
    "CAMPUS": ("hostel", "campus", "canteen", "transport", "health camp", "medical camp"),
    "WEBINAR": ("webinar", "online session", "virtual talk", "online course", "online fdp"),
}
#: Stakeholder cues; they are substrings, also where they look like patterns.
STAKEHOLDER_CUES = {
    "STUDENTS": ("students", "student", "student teams", "student projects", "ug students", "pg students", "students association", "student volunteers", "first year students", "final year students", "interns", "cadets", "participants received certificates", "code camp", "profr.?student", "girl students"),
    "FACULTY": ("faculty", "faculty members", "teaching staff", "professors", "teachers", "faculty development", "fdp", "staff of the department", "teaching faculty", "non-teaching staff", "college faculty", "young faculty"),
    "STAFF": ("non-teaching staff", "support staff", "administrative staff", "office staff", "technical staff", "laboratory staff"),
    "ALUMNI": ("alumni", "alumnus", "alumni association", "silver jubilee reunion", "alumni meet", "alumni networking", "alumni webinar", "old students"),
    "INDUSTRY": ("industry", "industries", "companies", "corporate", "company officials", "mou", "memorandum of understanding", "recruiters", "industry experts", "industry visits", "startup", "startup founder", "entrepreneurs"),
    "PARENTS": ("parents", "guardians", "parents association", "parent teacher"),
    "GOVERNMENT": ("government", "aicte", "ugc", "dst", "drdo", "isro", "ministry", "tnedu", "tnea", "sponsored by", "funded by", "agency", "nba", "naac", "nirf", "iqac", "tamil nadu government", "bharat", "india"),
    "COMMUNITY": ("community", "rural", "village", "school students", "school children", "blood bank", "blood donation", "society", "public", "farmers", "local community", "nearby schools", "adopted village", "ngos", "underprivileged"),
}
CUE_CONFIDENCE = 0.8


def strip_html(html: Column) -> Column:
    """Text with script and style blocks, then tags, as blanks."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\s]+", " ")


def normalized_title(text: Column) -> Column:
    """Lower case, without punctuation, single spaces. The caller normalises compatibility characters first."""
    return normalize_whitespace(normalize_punctuation(F.lower(text)))


def for_vectors(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")


def keywords(text: Column) -> Column:
    """Distinct ASCII words of 4 letters or more that are no stop words, sorted."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))
    return F.sort_array(F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS))))


def human_list(items: Column) -> Column:
    """a, b and c"""
    head = F.array_join(F.slice(items, 1, F.size(items) - 1), ", ")
    return F.when(F.size(items) == 0, F.lit("")).when(F.size(items) == 1, items[0]).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def acronym(text: Column, skipped: tuple[str, ...] = ("of", "the", "and", "for", "in", "on")) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*skipped))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def normalize_department(display: Column, aliases: dict[str, str]) -> Column:
    """Parts of a display string by their full names; General if null, blank or only general words."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in (kv[0].lower(), kv[1])))
    known = F.transform(parts(display), lambda p: F.coalesce(F.try_element_at(table, F.lower(p)), p))
    named = F.array_distinct(F.filter(known, lambda p: ~F.lower(p).isin("general", "institution", "all", "na", "-")))
    return F.when(display.isNull() | (F.size(named) == 0), F.lit(GENERAL)).otherwise(F.array_join(named, "; "))


def cue_labels(text: Column, cues: dict[str, tuple[str, ...]]) -> Column:
    """Labels with a cue that is a substring of the text, in the vocabulary's order."""
    table = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("cues")) for label, words in cues.items()))
    # The text is bound once; inside the lambdas its expression would be evaluated for every cue.
    hits = F.transform(F.array(text), lambda t: F.filter(table, lambda v: F.exists(v["cues"], lambda c: F.contains(t, c))))[0]
    return F.transform(hits, lambda v: v["label"])


def _cue_sql(cues: dict[str, tuple[str, ...]], text: str) -> str:
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{label}' END" for label, words in cues.items()) + "], lambda x: x IS NOT NULL)"


_TAGS = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_SPACES = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_PUNCT = r"regexp_replace({}, '[^\p{{L}}\p{{N}}\p{{M}}_\s]+', ' ', 'g')"


@query("f01_strip_html", f"SELECT page_id, {_SPACES.format(_TAGS)} AS body FROM pages", base=False)
def strip_html_query(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "pages").select("page_id", normalize_whitespace(strip_html(F.col("html"))).alias("body"))


@query("f05_normalized_title", f"SELECT doc_id, {_SPACES.format(_PUNCT.format('lower(text)'))} AS title FROM documents", base=False)
def normalized_title_query(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "documents").select("doc_id", normalized_title(F.col("text")).alias("title"))


@query(
    "f07_validate_record",
    """SELECT doc_id, list_filter([CASE WHEN trim(split_part(text, '.', 1)) = '' THEN 'missing-title' END, CASE WHEN n_chars < 40 THEN 'missing-description' END], lambda x: x IS NOT NULL) AS flags,
trim(split_part(text, '.', 1)) <> '' OR n_chars >= 40 AS valid FROM documents""",
    base=False,
)
def validate_record(spark: SparkSession, d: str) -> DataFrame:
    """Flags of a record whose title is its first sentence; valid with a title or a description."""
    title, described = F.trim(F.substring_index("text", ".", 1)) != "", F.col("n_chars") >= 40
    flags = F.array_compact(F.array(F.when(~title, "missing-title"), F.when(~described, "missing-description")))
    return tables(spark, d, "documents").select("doc_id", flags.alias("flags"), (title | described).alias("valid"))


@query("f14_duplicate_groups", "SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1", base=False)
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    grouped = tables(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return grouped.where("n > 1")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("f17_keywords", f"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda x: x NOT IN ({_STOPS})))) AS keywords FROM documents", base=False)
def keywords_query(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "documents").select("doc_id", keywords(F.col("text")).alias("keywords"))


@query("f18_for_vectors", r"SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g') AS body FROM documents", base=False)
def for_vectors_query(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d, "documents").select("doc_id", for_vectors(F.col("text")).alias("body"))


@modelled("f22_split_display", "SELECT id, string_split(department_display, '; ') AS members FROM act WHERE department_display IS NOT NULL")
def split_display(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.where("department_display is not null").select("id", parts(F.col("department_display")).alias("members"))


@modelled(
    "f23_normalize_department",
    """SELECT id, CASE WHEN coalesce(department_display, 'General') = 'General' THEN 'General' ELSE array_to_string(list_transform(list_filter(string_split(department_display, '; '), lambda x: x <> 'General'),
lambda x: CASE x WHEN 'NATION_1' THEN 'First Nation' WHEN 'NATION_2' THEN 'Second Nation' ELSE x END), '; ') END AS department FROM act""",
)
def normalize_department_query(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id", normalize_department(F.col("department_display"), {"NATION_1": "First Nation", "nation_2": "Second Nation"}).alias("department"))


@modelled(
    "f31_human_list",
    """, c AS (SELECT id, list(code ORDER BY code) AS codes FROM cat GROUP BY id) SELECT id, CASE WHEN len(codes) = 1 THEN codes[1] ELSE array_to_string(codes[1:-2], ', ') || ' and ' || codes[-1] END AS listed FROM c""",
)
def human_list_query(u: Universe, spark: SparkSession) -> DataFrame:
    codes = u.categories.groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    return codes.select("id", human_list(F.col("codes")).alias("listed"))


@modelled("f32_acronym", "SELECT id, upper(array_to_string(list_transform(list_filter(string_split(title, ' '), lambda w: w <> '' AND lower(w) NOT IN ('of', 'the', 'and', 'for', 'in', 'on')), lambda w: w[1]), '')) AS short FROM act")
def acronym_query(u: Universe, spark: SparkSession) -> DataFrame:
    return u.activities.select("id", acronym(F.col("title")).alias("short"))


@query("f33_length_caps", "SELECT doc_id, left(text, 400) AS title, left(text, 1200) AS evidence FROM documents", base=False)
def length_caps(spark: SparkSession, d: str) -> DataFrame:
    """The feature is the cap: titles of at most 400 and evidence of at most 1,200 characters."""
    return tables(spark, d, "documents").select("doc_id", F.left("text", F.lit(400)).alias("title"), F.left("text", F.lit(1200)).alias("evidence"))


@query("c01_keyword_classifier", rf"WITH t AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g') AS body FROM documents) SELECT doc_id, {_cue_sql(CATEGORY_CUES, 'body')} AS labels FROM t", base=False)
def keyword_classifier(spark: SparkSession, d: str) -> DataFrame:
    body = tables(spark, d, "documents").select("doc_id", for_vectors(F.col("text")).alias("body"))
    return body.select("doc_id", cue_labels(F.col("body"), CATEGORY_CUES).alias("labels"))


@query(
    "c02_classify_all",
    rf"""WITH t AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g') AS body FROM documents), l AS (SELECT doc_id, {_cue_sql(CATEGORY_CUES, 'body')} AS labels FROM t)
SELECT doc_id, unnest(labels) AS label, {CUE_CONFIDENCE}::DOUBLE AS confidence, unnest(range(len(labels))) = 0 AS is_primary, greatest(0.5, {CUE_CONFIDENCE})::DOUBLE AS overall FROM l""",
    base=False,
)
def classify_all(spark: SparkSession, d: str) -> DataFrame:
    """A row for each label, the first one primary, and the document's overall confidence."""
    each = keyword_classifier(spark, d).select("doc_id", F.posexplode("labels").alias("place", "label"))
    return each.select("doc_id", "label", F.lit(CUE_CONFIDENCE).alias("confidence"), (F.col("place") == 0).alias("is_primary"), F.greatest(F.lit(0.5), F.lit(CUE_CONFIDENCE)).alias("overall"))


@query("c16_stakeholder_cues", f"SELECT doc_id, list_sort({_cue_sql(STAKEHOLDER_CUES, 'lower(text)')}) AS stakeholders FROM documents", base=False)
def stakeholder_cues(spark: SparkSession, d: str) -> DataFrame:
    lowered = tables(spark, d, "documents").select("doc_id", F.lower("text").alias("body"))
    return lowered.select("doc_id", F.sort_array(cue_labels(F.col("body"), STAKEHOLDER_CUES)).alias("stakeholders"))


#: Word boundaries that know letters beyond ASCII.
_B, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def _told_sql(*groups: str) -> str:
    return " + ".join(f"regexp_matches(lower(text), '{_B}({g}){_E}')::INT" for g in groups)


#: What evidence is made of: each of the terms and of the actions found counts once.
TERMS, ACTIONS = ("the|der|les|los", "and|und|et|y", "license|licensed"), ("was|ist|est|es", "released|under")
EVIDENCE_SQL = f"round(least(1.0, 0.18 * ({_told_sql(*TERMS)}) + 0.16 * ({_told_sql(*ACTIONS)}))::DOUBLE, 4)"


def evidence(text: Column) -> Column:
    """min(1, 0.18 a term + 0.16 an action), by whole words."""
    body, score = F.lower(text), F.lit(0.0)
    for weight, groups in ((0.18, TERMS), (0.16, ACTIONS)):
        for g in groups:
            score = score + F.when(body.rlike(rf"\b({g})\b"), weight).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), score), 4)


@query("c22_evidence_assessment", f"SELECT doc_id, {EVIDENCE_SQL} AS score, {EVIDENCE_SQL} >= 0.5 AS enough FROM documents", base=False)
def evidence_assessment(spark: SparkSession, d: str) -> DataFrame:
    """At least 0.5 is enough."""
    rated = tables(spark, d, "documents").select("doc_id", evidence(F.col("text")).alias("score"))
    return rated.withColumn("enough", F.col("score") >= 0.5)


@query(
    "c25_quality_gate",
    """WITH r AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 100 THEN 'weak-text' END, CASE WHEN text NOT LIKE '%.%' THEN 'no-sentence' END, CASE WHEN text LIKE '%@%' THEN 'has-contact' END], lambda x: x IS NOT NULL) AS reasons, text FROM documents)
SELECT doc_id, reasons, CASE WHEN text ILIKE '%licensed under%' THEN 'NON_ACTIVITY' WHEN len(reasons) > 0 THEN 'REVIEW' ELSE 'GOOD' END AS verdict FROM r""",
    base=False,
)
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Non-activity text, text to review with the reasons, or good."""
    text = F.col("text")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 100, "weak-text"), F.when(~text.contains("."), "no-sentence"), F.when(text.contains("@"), "has-contact")))
    verdict = F.when(text.ilike("%licensed under%"), "NON_ACTIVITY").when(F.size(reasons) > 0, "REVIEW").otherwise("GOOD")
    return tables(spark, d, "documents").select("doc_id", reasons.alias("reasons"), verdict.alias("verdict"))
