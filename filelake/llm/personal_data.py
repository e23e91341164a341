"""Personal data found by weak supervision, in DataFrame expressions only.

Broad patterns per kind give candidate spans. On each candidate, labelers vote for (1), against (0) or not at all (2):
a regex labeler per kind's strict form, its arithmetic (digit counts, Luhn, parts up to 255), gazetteers (domain endings,
words that announce contact data) and context labelers (what stands before, code-like neighbours). How reliable each
labeler is, given that a candidate is or is not personal data, is estimated per kind by expectation-maximisation over
the counts of vote patterns; the posteriors train the final classifier, a logistic regression over features of the
span. Its score is one expression over all candidates.

Spans of the base patterns that pass their arithmetic are always kept; other candidates are added where the classifier
is sure and no kept span overlaps them. The driver sees vote patterns and feature patterns with their counts only: at
most 3^6 per kind and 2^9 per kind, whatever the corpus.

Positions are code points. Defined cases: a null text is empty; texts without candidates have no spans; repeated rows
are answered each; equal matches stay separate spans; extra columns are kept by ``mask`` and not read by ``find``.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.llm import common

KINDS = ("email", "ip", "card", "phone")

# The base pattern of each kind. Possessive quantifiers match the same texts, without retrying.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Forms beyond the base patterns, per kind.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
# Fixed value: the least code points of a card candidate; a match of so many has at least CARD_DIGITS digits.
CARD_LENGTH, CARD_DIGITS = 12, 7
# What a text must contain for any form of a kind to be in it.
NEEDS = {"email": r"[@\[(]", "ip": r"[0-9A-Fa-f][.:][0-9A-Fa-f]", "card": "[0-9]{4}", "phone": r"[0-9]{3}[ .)-]|\+[0-9]"}

# Gazetteers.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk")
ANNOUNCE = ("mail", "email", "e-mail", "phone", "tel", "telephone", "call", "fax", "mobile", "contact", "card", "visa", "ip",
            "address", "telefon", "anruf", "karte", "adresse", "correo", "tarjeta", "llame", "courriel", "carte", "appelez")
CODE = ("version", "ver", "v", "rev", "build", "release", "id", "no", "nr", "isbn", "order", "invoice", "section", "chapter")

BEFORE = 24  # code points of context on the left
SURE = 0.9
PLACE = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right doubled, and its two digits added."""
    reverse = F.reverse(digits)
    doubled = F.translate(F.regexp_replace(reverse, "([0-9])([0-9])?", "$2"), "0123456789", "0246813579")
    plain = F.regexp_replace(reverse, "([0-9])([0-9])?", "$1")

    def total(s: Column) -> Column:
        return F.aggregate(F.filter(F.split(s, ""), lambda d: d != ""), F.lit(0), lambda a, d: a + d.cast("int"))

    return (total(plain) + total(doubled)) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The arithmetic of a base match."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return common.let(_digits(match), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _running(values: Column, combine: Callable[[Column, Column], Column] = operator.add) -> Column:
    """Exclusive running sums (or other folds, from 0) of an array, in chunks of 64: long arrays are not copied at every step."""
    size = 64

    def append(acc: Column, x: Column) -> Column:
        return F.array_append(acc, combine(F.element_at(acc, -1), x))

    def chunks(ls: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(ls) / size).cast("int") - 1, F.lit(0)))
        return F.transform(numbers, lambda b: F.slice(ls, b * size + 1, size))

    def sums(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: combine(a, x)))
        starts = F.aggregate(totals, F.array(F.lit(0)), append)
        return common.let(starts, lambda st: F.flatten(F.transform(parts, lambda p, b: F.slice(
            F.aggregate(p, F.array(F.get(st, b)), append), 1, F.size(p)))))

    return common.let(values, lambda vs: common.let(chunks(vs), sums))


MATCH = "array<struct<start:int,end:int,match:string,before:string>>"


def _places(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern with their places and what stands before them."""

    def join(gaps: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return common.let(_running(lengths), lambda st: F.transform(found, lambda m, i: F.struct(
            (F.get(st, i) + F.length(F.get(gaps, i))).alias("start"),
            (F.get(st, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"),
            m.alias("match"), F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return common.let(found, lambda ms: F.when(F.size(ms) == 0, F.array().cast(MATCH)).otherwise(
        common.let(F.split(text, pattern), lambda gaps: join(gaps, ms))))


def candidates(text: Column) -> Column:
    """All candidates of a text, by kind and place: structs kind, start, end, match, before, base."""
    parts = []
    for number, kind in enumerate(KINDS):
        for loose, pattern in ((False, BASE[kind]), (True, LOOSE[kind])):
            if loose and kind == "email":
                gate = text.rlike(r"[\[(]at[\])]")
            elif loose and kind == "ip":
                gate = text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")
            elif not loose and kind == "card":  # a separator may stand between any two digits
                gate = text.rlike(rf"[0-9](?:[\x20-]?[0-9]){{{CARD_DIGITS - 1}}}")
            else:
                gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike(NEEDS[kind]))
                if loose:
                    gate = text.rlike(NEEDS[kind])
            found = F.when(gate, _places(text, pattern)).otherwise(F.array().cast(MATCH))
            if kind == "card" and not loose:
                found = F.filter(found, lambda m: F.length(m["match"]) >= CARD_LENGTH)
            parts.append(F.transform(found, _tag(number, kind, loose)))
    return F.flatten(F.array(*parts))


def _tag(number: int, kind: str, loose: bool):
    def tag(m: Column) -> Column:
        return F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"),
                        m["before"].alias("before"), F.lit(False).alias("base") if loose else passes(kind, m["match"]).alias("base"),
                        F.lit(loose).alias("loose"))

    return tag


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(2)


def _last_word(before: Column) -> Column:
    return F.regexp_extract(F.lower(before), r"([\p{L}-]+)[^\p{L}]{0,3}$", 1)


def votes(c: Column) -> list[Column]:
    """The labelers: each says 1 (personal data), 0 (not) or 2 (nothing)."""
    match, before, digits = c["match"], c["before"], F.length(_digits(c["match"]))
    word = _last_word(before)
    ending = F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1))
    kind = c["kind"]
    return [
        _vote(c["base"], ~c["base"] & ~c["loose"]),  # regex with its arithmetic
        _vote((kind == 0) & ending.isin(*ENDINGS), (kind == 0) & ~ending.isin(*ENDINGS)),  # gazetteer of endings
        _vote(word.isin(*ANNOUNCE), word.isin(*CODE)),  # gazetteers of announcing words
        _vote(F.lit(False), before.rlike(r"[\p{L}0-9_#$=/.:-]$")),  # glued to code or numbers
        _vote((kind == 3) & (digits >= 10) & (digits <= 13), (kind == 3) & ((digits < 8) | (digits > 15))),  # length of numbers
        _vote((kind == 2) & (digits == 16), (kind == 2) & ((digits < 14) | (digits > 19))),
    ]


def features(c: Column) -> list[Column]:
    """Binary features of the final classifier."""
    match, before, digits = c["match"], c["before"], F.length(_digits(c["match"]))
    word = _last_word(before)
    return [
        c["base"], c["loose"], word.isin(*ANNOUNCE), word.isin(*CODE), before.rlike(r"[\p{L}0-9_#$=/.:-]$"),
        digits.between(10, 16), match.rlike(r"[ ()-]"), F.lower(F.regexp_extract(match, r"([A-Za-z]+)$", 1)).isin(*ENDINGS),
        F.length(match) > 40,
    ]


N_VOTES, N_FEATURES = 6, 9


def _patterns(rows: DataFrame) -> list[tuple[int, tuple[int, ...], tuple[int, ...], int]]:
    """(kind, votes, features, count) of all candidates: a bounded table."""
    c = F.col("c")
    coded = rows.select(c["kind"].alias("kind"), F.concat(*[v.cast("string") for v in votes(c)]).alias("v"),
                        F.concat(*[F.when(f, "1").otherwise("0") for f in features(c)]).alias("f"))
    found = coded.groupBy("kind", "v", "f").count().collect()
    return sorted((r.kind, tuple(map(int, r.v)), tuple(map(int, r.f)), r["count"]) for r in found)


def reliabilities(patterns: list, steps: int = 40) -> dict[int, tuple[float, list, list]]:
    """Per kind the prior and, given yes and given no, how often each labeler says 0, 1, 2 (expectation-maximisation)."""
    out = {}
    for kind in range(len(KINDS)):
        counts: dict[tuple[int, ...], int] = {}
        for k, v, _, n in patterns:
            if k == kind:
                counts[v] = counts.get(v, 0) + n
        prior = 0.5
        yes = [[0.1, 0.6, 0.3]] * N_VOTES  # a labeler is better than chance at first
        no = [[0.6, 0.1, 0.3]] * N_VOTES
        for _ in range(steps if counts else 0):
            total = mass = 0.0
            ty = [[1.0 * 0.1, 1.0 * 0.6, 1.0 * 0.3] for _ in range(N_VOTES)]  # what one assumed candidate of each class says
            tn = [[1.0 * 0.6, 1.0 * 0.1, 1.0 * 0.3] for _ in range(N_VOTES)]
            for v, n in counts.items():
                p = posterior((prior, yes, no), v)
                total, mass = total + n, mass + n * p
                for k, x in enumerate(v):
                    ty[k][x] += n * p
                    tn[k][x] += n * (1 - p)
            prior = min(0.99, max(0.01, mass / total))
            yes, no = ([[x / sum(t) for x in t] for t in table] for table in (ty, tn))
        out[kind] = (prior, yes, no)
    return out


def posterior(model: tuple[float, list, list], v: tuple[int, ...]) -> float:
    prior, yes, no = model
    odds = math.log(prior) - math.log(1 - prior)
    for k, x in enumerate(v):
        odds += math.log(yes[k][x]) - math.log(no[k][x])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def classifier(patterns: list, models: dict, steps: int = 300) -> dict[int, list[float]]:
    """Per kind the weights (bias first) of a logistic regression on the posteriors, by damped gradient steps."""
    out = {}
    for kind in range(len(KINDS)):
        rows = [(f, posterior(models[kind], v), n) for k, v, f, n in patterns if k == kind]
        total = sum(n for *_, n in rows) or 1
        w = [0.0] * (N_FEATURES + 1)
        for _ in range(steps if rows else 0):
            gradient = [0.002 * x for x in w]
            for f, p, n in rows:
                z = w[0] + sum(a for a, x in zip(w[1:], f) if x)
                error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
                gradient[0] += error
                for k, x in enumerate(f):
                    gradient[k + 1] += error * x
            w = [a - 2.0 * g for a, g in zip(w, gradient)]
        out[kind] = w if rows else [-10.0] + [0.0] * N_FEATURES
    return out


def learn(docs: DataFrame) -> dict[int, list[float]]:
    rows = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c"))
    patterns = _patterns(rows)
    return classifier(patterns, reliabilities(patterns))


def score(c: Column, weights: dict[int, list[float]]) -> Column:
    out = F.lit(0.0)
    for kind, w in weights.items():
        z = F.lit(w[0])
        for a, f in zip(w[1:], features(c)):
            z = z + F.when(f, a).otherwise(0.0)
        out = F.when(c["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(out)
    return out


def spans(cs: Column, weights: dict[int, list[float]]) -> Column:
    """The kept candidates: base ones, and sure ones of the classifier that overlap none of them. Sure ones of different
    kinds may overlap each other.

    In order of place a candidate overlaps a base span if one that comes before it ends beyond its start, or one that
    comes after it starts before its end; running maxima from both sides decide that in one pass.
    """
    fields = ("start", "end", "kind", "match", "before", "base", "loose")
    high = F.lit(2**31 - 1)

    def keep(found: Column) -> Column:
        ends = _running(F.transform(found, lambda c: F.when(c["base"], c["end"]).otherwise(0)), F.greatest)
        starts = _running(F.reverse(F.transform(found, lambda c: F.when(c["base"], high - c["start"]).otherwise(0))), F.greatest)

        def free(sides: Column) -> Column:
            def kept(c: Column, i: Column) -> Column:
                apart = (F.get(sides["ends"], i) <= c["start"]) & (high - F.get(sides["starts"], F.size(found) - 1 - i) >= c["end"])
                return c["base"] | (c["loose"] & (score(c, weights) >= SURE) & apart)

            return F.filter(found, kept)

        return common.let(F.struct(ends.alias("ends"), starts.alias("starts")), free)

    by_place = F.sort_array(F.transform(cs, lambda c: F.struct(*[c[f].alias(f) for f in fields])))
    by_kind = ("kind", "start", "end", "match", "before", "base", "loose")
    return F.sort_array(F.transform(common.let(by_place, keep), lambda c: F.struct(*[c[f].alias(f) for f in by_kind])))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda c: F.concat_ws(
        ":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def _number(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda c: c["base"] & (c["kind"] == kind))).cast("long")


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base counts, base_sha256, spans (kind:start:end by kind and start)."""
    rows = common.stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(
        F.coalesce("text", F.lit(""))).alias("cs")), "candidates")
    patterns = _patterns(rows.select(F.explode("cs").alias("c")))
    weights = classifier(patterns, reliabilities(patterns))
    found = rows.select("doc_id", F.when(F.size("cs") == 0, F.col("cs")).otherwise(spans(F.col("cs"), weights)).alias("s"))
    base = F.filter("s", lambda c: c["base"])
    return found.select("doc_id", *[_number(F.col("s"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def _masked(text: Column, weights: dict[int, list[float]]) -> Column:
    """The text cut at the borders of its spans in one pass; what a span starts inside of an earlier one is dropped."""

    def by_place(found: Column) -> Column:
        return F.sort_array(F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))

    def cut(found: Column) -> Column:
        ends = _running(F.transform(found, lambda c: c["end"]), F.greatest)
        names = F.array(*[F.lit(PLACE[k]) for k in KINDS])

        def build(to: Column) -> Column:
            pieces = F.transform(found, lambda c, i: F.concat(
                F.when(c["start"] > F.get(to, i), F.substring(text, F.get(to, i) + 1, c["start"] - F.get(to, i))).otherwise(""),
                F.when(c["start"] >= F.get(to, i), F.get(names, c["kind"])).otherwise("")))
            rest = F.substring(text, F.array_max(F.transform(found, lambda c: c["end"])) + 1, F.length(text))
            return F.concat(F.array_join(pieces, ""), rest)

        return common.let(ends, build)

    return common.let(spans(candidates(text), weights), lambda s: F.when(F.size(s) == 0, text).otherwise(common.let(by_place(s), cut)))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by the name of its kind, and ``n_chars`` counted anew.

    Texts that changed are swept once more: a number that began inside of a masked one may only now be a match.
    """
    weights = learn(docs)
    text, once = F.col("text"), common.fresh(docs.columns)
    swept = docs.withColumn(once, _masked(text, weights))  # a column of its own keeps the expressions flat enough to resolve
    twice = F.when(F.col(once) == text, text).otherwise(_masked(F.col(once), weights))
    out = swept.withColumn("text", F.when(text.isNull(), text).otherwise(twice)).drop(once)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
