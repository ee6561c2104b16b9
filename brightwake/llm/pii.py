"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns with checks. The
method adds spans of further kinds. Broad patterns propose candidates; three
labelers (the strict shape of a kind, a gazetteer, the words before) each vote
yes, no or abstain. Expectation-maximisation over the counts of vote patterns
estimates every labeler's reliability and the probability of each pattern; these
probabilities train a logistic classifier on the span's own features, which
decides. The counts are at most one row a combination of votes and features, so
what reaches the driver does not grow with the data; all texts are counted.

A span's place is found from the lengths of the pieces between matches, in code
points. Possessive quantifiers and look-behinds keep every pattern linear in the
text and free of deep recursion; they match the same spans as the plain forms.

Defined results: null or empty text has no spans (``base_sha256`` of the empty
string, ``spans`` empty); null ``doc_id`` rows and repeated rows are kept as rows;
an empty table gives an empty result; other columns pass through ``annotate`` and
``redact`` unchanged. Candidates that a base span covers are dropped;
added spans may overlap base spans otherwise; extra columns may have any names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import unused, written

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "national_id", "iban", "local_phone", "person")
KINDS = BASE_KINDS + ADDED_KINDS

#: Common first names of the four languages.
_NAMES = (
    "Alexander Alice Ana Andrea Andreas Andrew Anna Anne Antonio Barbara Bernard Birgit Brian Camille Carlos Carmen Carol Caroline Catherine Charles Charlotte "
    "Christian Christine Claire Claude Claudia Daniel David Denis Diego Dieter Edward Elena Elizabeth Emily Emma Erik Eva Fernando Francisco Frank François "
    "Gabriel George Gerhard Hans Heike Helen Helga Henry Hugo Ingrid Isabel Jacques James Jan Javier Jean Jennifer Jessica Joan John Jorge Joseph José Juan "
    "Julia Julie Jürgen Karen Karin Karl Katharina Kevin Klaus Laura Laurent Lena Linda Lisa Louis Louise Lucas Lucía Luis Manuel Margaret Maria Marie Marina "
    "Mark Markus Marta Martin Martine Mary María Matthew Max Michael Michel Miguel Monika Nancy Nathalie Nicolas Nicole Olivier Otto Pablo Patricia Patrick "
    "Paul Pedro Peter Petra Philippe Pierre Pilar Rafael Ralf Raquel Rebecca Richard Robert Roberto Rosa Sabine Sandra Sara Sarah Sergio Simon Sofía Sophie "
    "Stefan Stephen Steven Susan Susanne Teresa Thomas Ursula Valérie Vincent Walter Werner William Wolfgang"
).split()
#: Lengths of bank account numbers by country.
_IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_TITLES = r"Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "person": rf"(?<=\b(?:{_TITLES})\.?\x20)[A-Z][\p{{L}}'-]++(?:\x20[A-Z][\p{{L}}'-]++)?+",
}
#: A text without a match of these cannot hold the kind; they are cheaper to look for.
_NEEDS = {"email": "@", "phone": "+"}
_NEEDS_DIGIT = ("ip", "card", "secret", "national_id", "iban", "local_phone")

#: Strict shapes: (yes, no); None never matches. Bank accounts are also checked by length and modulus.
_SHAPES = {
    "secret": (r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|xox[abp])[_-][A-Za-z0-9_-]{12,})$", r"^[a-z]+(?:[_-][a-z]+)*[_-]?[0-9]{1,4}$"),
    "national_id": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^(?:000|666|9)"),
    "iban": (None, None),
    "local_phone": (r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]", r"^\(?[01]"),
    "person": (r"^[A-Z][^\x20]+\x20[A-Z][^\x20]+$", r"^[A-Z]{2,}$"),
}
#: Gazetteers: how a span of the kind begins, for and against.
_GAZETTEER = {
    "secret": (r"^(?:AKIA|ASIA|sk[_-]|pk[_-]|ghp_|gho_|xox|eyJ|AIza)", r"(?i)^(?:version|release|chapter|section|license|utf|iso|sha|build)"),
    "national_id": (None, r"^(?:123-45-6789|078-05-1120|219-09-9999|111-11-1111|999-99-9999)$"),
    "iban": (rf"^(?:{'|'.join(_IBAN_LENGTHS)})", r"^(?:XX|ZZ|ISO|UTF|SHA)"),
    "local_phone": (r"^\(?(?:800|833|844|855|866|877|888)\)?", r"^\(?(?:000|123|555)\)?[\x20.-](?:000|456|555)[\x20.-]"),
    "person": (rf"^(?:{'|'.join(_NAMES)})(?![\p{{L}}])", r"^(?:Who|No|Evil|Strange|President|Director|Minister|Chair|Professor|Doctor)(?![\p{L}])"),
}
#: Words in the 32 characters before a span, for and against.
_CONTEXT = {
    "secret": (r"(?i)(?:token|secret|passwor[dt]|passwd|key|credential|bearer|auth)[^\p{L}]*$", r"(?i)(?:commit|checksum|digest|version|revision|build|isbn|doi)[^\p{L}]*$"),
    "national_id": (r"(?i)(?:ssn|social security|tax|id|number|nummer|numéro|número)[^\p{L}]*$", r"(?i)(?:part|order|page|version|model)[^\p{L}]*$"),
    "iban": (r"(?i)(?:iban|account|konto|compte|cuenta|bank)[^\p{L}]*$", r"(?i)(?:isbn|model|version|serial)[^\p{L}]*$"),
    "local_phone": (r"(?i)(?:phone|tel|call|fax|mobile|telefon|appel|llam\w*)[^\p{L}]*$", r"(?i)(?:isbn|version|page|order|score)[^\p{L}]*$"),
    "person": (r"(?i)(?:dear|name|sincerely|signed|liebe[r]?|cher|estimad[oa])\W+\w+\.?\W*$", r"(?i)(?:the|a|der|die|le|la|el)\W+\w+\.?\W*$"),
}
LABELERS = ("shape", "gazetteer", "context")
_GROUP = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _starts(lengths: Column) -> Column:
    """Sums of all elements before each one, by sums of groups of elements."""
    zero = F.lit(0).cast("long")
    add = lambda a, x: a + x
    heads = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _GROUP).cast("int"))
    grouped = F.transform(heads, lambda g: F.aggregate(F.slice(lengths, g * _GROUP + 1, _GROUP), zero, add))
    running = _let(grouped, lambda s: F.transform(heads, lambda g: F.aggregate(F.slice(s, 1, g), zero, add)))

    def place(_: Column, i: Column) -> Column:
        g = F.floor(i / _GROUP).cast("int")
        return F.aggregate(F.slice(lengths, g * _GROUP + 1, i - g * _GROUP), zero, add)

    return _let(running, lambda r: F.transform(lengths, lambda x, i: r[F.floor(i / _GROUP).cast("int")] + place(x, i)))


def matches(text: Column, kind: str) -> Column:
    """Array of (start, end, match) of the kind's pattern, before checks."""
    pattern = PATTERNS[kind]
    empty = F.array().cast("array<struct<start:bigint,end:bigint,m:string>>")

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed_pairs(m, F.split(text, pattern, -1))).otherwise(empty))
    there = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]") if kind in _NEEDS_DIGIT else F.lit(True)
    return F.when(there, found).otherwise(empty)


def placed_pairs(m: Column, between: Column) -> Column:
    """(start, end, match) from the matches and the pieces between them."""

    def ends(n: Column) -> Column:
        return _let(_starts(n), lambda s: F.transform(m, lambda x, i: F.struct((s[i] + n[i] - F.length(x)).alias("start"), (s[i] + n[i]).alias("end"), x.alias("m"))))

    return _let(between, lambda b: _let(F.transform(m, lambda x, i: (F.length(b[i]) + F.length(x)).cast("long")), ends))


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        x = c.cast("int")
        doubled = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.when(i % 2 == 1, doubled).otherwise(x)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, rank, end, kind)."""

    def passing(rank: int, kind: str) -> Column:
        kept = F.filter(matches(text, kind), lambda s: _passes(kind, s["m"]))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.sort_array(F.concat(*(passing(rank, kind) for rank, kind in enumerate(BASE_KINDS))))


def _vote(value: Column, yes_no: tuple[str | None, str | None]) -> Column:
    yes, no = yes_no
    voted = F.when(value.rlike(no), -1) if no else F.when(F.lit(False), -1)
    return (voted.when(value.rlike(yes), 1) if yes else voted).otherwise(0)


def account_checks(account: Column) -> Column:
    """Whether a bank account number has its country's length and leaves 1 modulo 97, its first four characters moved to the end and letters as 10 to 35."""
    packed = F.replace(account, F.lit(" "), F.lit(""))
    lengths = F.create_map(*(F.lit(x) for pair in _IBAN_LENGTHS.items() for x in pair))
    known = F.try_element_at(lengths, F.substring(packed, 1, 2))
    turned = F.split(F.concat(F.substring(packed, 5, 64), F.substring(packed, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c == "", rest).when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.coalesce(known == F.length(packed), F.lit(True)) & (F.aggregate(turned, F.lit(0), step) == 1)


def _shape(kind: str, m: Column) -> Column:
    return F.when(account_checks(m), 1).otherwise(-1) if kind == "iban" else _vote(m, _SHAPES[kind])


#: Span features of the final classifier and their numbers of values.
FEATURES = {"kind": len(ADDED_KINDS), "size": 3, "digits": 3, "case": 2, "cue": 2, "quoted": 2, "checked": 3, "listed": 3}


def candidates(text: Column) -> Column:
    """Array of candidate spans with votes and features."""

    def proposed(k: int, kind: str) -> Column:
        def told(s: Column) -> Column:
            before = F.substring(text, F.greatest(s["start"] - 31, F.lit(1)).cast("int"), F.least(s["start"], F.lit(32)).cast("int"))
            share = F.length(F.regexp_replace(s["m"], "[^0-9]", "")) / F.length(s["m"])
            return F.struct(
                s["start"].alias("start"),
                F.lit(len(BASE_KINDS) + k).alias("rank"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind_name"),
                _shape(kind, s["m"]).alias("shape"),
                _vote(s["m"], _GAZETTEER[kind]).alias("gazetteer"),
                _vote(before, _CONTEXT[kind]).alias("context"),
                F.lit(k).alias("kind"),
                F.when(F.length(s["m"]) < 20, 0).when(F.length(s["m"]) < 33, 1).otherwise(2).alias("size"),
                F.when(share < 0.2, 0).when(share < 0.7, 1).otherwise(2).alias("digits"),
                F.when(s["m"].rlike("[A-Z]") & s["m"].rlike("[a-z]"), 1).otherwise(0).alias("case"),
                F.when(before.rlike(_CONTEXT[kind][0]), 1).otherwise(0).alias("cue"),
                F.when(before.rlike("[\"'=:]\\s*$"), 1).otherwise(0).alias("quoted"),
                (_shape(kind, s["m"]) + 1).alias("checked"),
                (_vote(s["m"], _GAZETTEER[kind]) + 1).alias("listed"),
            )

        return F.transform(matches(text, kind), told)

    return F.concat(*(proposed(k, kind) for k, kind in enumerate(ADDED_KINDS)))


def annotate(docs: DataFrame, base: str, cand: str, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with base spans and candidates in columns of these names."""
    text, every = unused([*docs.columns, base, cand], "read"), unused([*docs.columns, base, cand], "all")
    based = docs.select(*keep, F.coalesce("text", F.lit("")).alias(text)).withColumn(base, base_spans(F.col(text))).withColumn(every, candidates(F.col(text)))
    clear = F.filter(every, lambda c: ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    return based.withColumn(cand, clear).drop(every, text)


@dataclass(frozen=True)
class LabelModel:
    """What EM estimates: P(vote | truth) of each labeler, and P(true) of each kind."""

    vote_given: dict[tuple[str, int, int], float]
    prior: dict[int, float]

    def probability(self, kind: int, votes: tuple[int, ...]) -> float:
        p = [1 - self.prior[kind], self.prior[kind]]
        for labeler, v in zip(LABELERS, votes, strict=True):
            for y in (0, 1):
                p[y] *= self.vote_given[labeler, v, y]
        return p[1] / (p[0] + p[1])


def fit_labelers(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over counts of (kind, votes)."""
    given = {(name, v, y): {1: 0.7 if y else 0.1, 0: 0.2, -1: 0.1 if y else 0.7}[v] for name in LABELERS for v in (-1, 0, 1) for y in (0, 1)}
    prior = {kind: 0.5 for kind, _ in counts}
    model = LabelModel(given, prior)
    for _ in range(rounds):
        seen: dict = defaultdict(float)
        mass: dict = defaultdict(float)
        true: dict = defaultdict(float)
        total: dict = defaultdict(float)
        for (kind, votes), n in counts.items():
            p = model.probability(kind, votes)
            true[kind] += n * p
            total[kind] += n
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                for labeler, v in zip(LABELERS, votes, strict=True):
                    seen[labeler, v, y] += w
                    mass[labeler, y] += w
        given = {(name, v, y): (seen[name, v, y] + 10 * model_prior(v, y)) / (mass[name, y] + 10) for name in LABELERS for v in (-1, 0, 1) for y in (0, 1)}
        model = LabelModel(given, {k: (true[k] + 1) / (total[k] + 2) for k in total})
    return model


def model_prior(vote: int, truth: int) -> float:
    """Pseudo-counts that tie a yes vote to the true class."""
    return {1: 0.5 if truth else 0.1, 0: 0.4, -1: 0.1 if truth else 0.5}[vote]


def _cells(features: tuple[int, ...]) -> list[int]:
    out, base = [], 1
    for value, n in zip(features, FEATURES.values(), strict=True):
        out.append(base + value)
        base += n
    return [0, *out]


def fit_classifier(rows: list[tuple[tuple[int, ...], float, int]], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Logistic regression on (features, probability, count): weights of the intercept and of each feature value."""
    weights = [0.0] * (1 + sum(FEATURES.values()))
    total = sum(n for _, _, n in rows)
    for _ in range(rounds if total else 0):
        gradient = [ridge * w for w in weights]
        for features, target, n in rows:
            cells = _cells(features)
            p = 1 / (1 + math.exp(-sum(weights[c] for c in cells)))
            for c in cells:
                gradient[c] += n * (p - target) / total
        weights = [w - rate * g for w, g in zip(weights, gradient, strict=True)]
    return weights


def train(annotated: DataFrame, cand: str) -> list[float]:
    """The classifier's weights, learned from all candidates."""
    each = annotated.select(F.explode(cand).alias("c")).select("c.*")
    names = [*LABELERS, *FEATURES]
    counted = each.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most one row a combination
    votes: dict = defaultdict(int)
    for r in counted:
        votes[r["kind"], tuple(r[x] for x in LABELERS)] += r["n"]
    model = fit_labelers(votes)
    merged: dict = defaultdict(lambda: [0.0, 0])
    for r in counted:
        cell = merged[tuple(r[x] for x in FEATURES)]
        cell[0] += r["n"] * model.probability(r["kind"], tuple(r[x] for x in LABELERS))
        cell[1] += r["n"]
    return fit_classifier([(f, p / n, n) for f, (p, n) in sorted(merged.items())])


def all_spans(weights: list[float], base_spans_: str, cand: str) -> Column:
    """Base spans and the candidates that the classifier accepts, sorted by start, then kind."""

    def accepted(c: Column) -> Column:
        score, base = F.lit(weights[0]), 1
        for name, n in FEATURES.items():
            score = score + F.array(*(F.lit(w) for w in weights[base : base + n]))[c[name]]
            base += n
        return score > 0

    added = F.transform(F.filter(cand, accepted), lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind_name"].alias("kind")))
    return F.sort_array(F.concat(F.col(base_spans_), added))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_query(docs: DataFrame) -> DataFrame:
    annotated = written(annotate(docs, "base", "cand", "doc_id"), "pii-spans")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return annotated.select("doc_id", *map(count, BASE_KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(all_spans(train(annotated, "cand"), "base", "cand")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of overlapping spans the first to begin is named."""
    base, cand, spans = (unused(docs.columns, x) for x in ("base", "cand", "spans"))
    annotated = written(annotate(docs, base, cand, *(F.col(f"`{c}`") for c in docs.columns)), "pii-annotated")
    text = F.col("text")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(ahead, F.concat(acc["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    tail = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    spanned = annotated.withColumn(spans, all_spans(train(annotated, cand), base, cand))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, tail)).otherwise(text)
    return spanned.withColumn("text", clean).select(*(f"`{c}`" for c in docs.columns))
