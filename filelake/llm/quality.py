"""Quality rules as a learned decision list over statistics of whole texts, in DataFrame expressions only.

Statistics are worked out once per document by column functions. Rules are grown by sequential covering on labelled
documents: a rule starts empty and takes, one at a time, the threshold condition with the best gain in a weighted
information measure; it is pruned on a third of the documents that was not used to grow it, and kept if it is precise
there; what it covers is set aside and the next one is grown. The finished list is one ordered conditional expression.

Every growing step is one aggregation: for the documents that the rule so far covers, how many of each class lie in
each bin of each statistic. The driver sees only these histograms (statistics x bins x classes), whatever the number of
documents. Rules speak of the rejected class; what no rule covers is kept, so clean text passes unless proven junk.

Words are runs outside space and \\t..\\r. Defined cases: a null text has no words; texts without labels take no part in
learning; null labels are not used; a document labelled more than once counts once per label; without rejected labels
the list is empty and everything is kept; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.llm import common

SPACE = " \t\n\x0b\x0c\r"
# Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"

MOST_LABELLED = 200_000  # labelled documents used for learning; more are thinned by a hash of doc_id
BINS = 16
MOST_RULES = 8
MOST_CONDITIONS = 3
PRECISION = 0.9  # of a rule, on documents it was not grown on
FEWEST = 3  # rejected documents that a rule must cover there


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return common.let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t-\\r]+")))


def _without(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def repeated_words(hashes: Column) -> Column:
    """How many positions lie in a window of five words that stands in the text twice or more.

    Windows are told apart by 64-bit hashes. Texts without repeats are settled by counting distinct windows; otherwise
    windows are sorted with their places, those with an equal neighbour taken, and their extents joined.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - 4), lambda i: F.struct(
            F.xxhash64(*[F.get(h, i + k) for k in range(-1, 4)]).alias("h"), i.alias("i")))

    def repeated(ordered: Column) -> Column:
        found = F.filter(ordered, lambda w, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == w["h"]))
                         | F.coalesce(F.get(ordered, k + 1)["h"] == w["h"], F.lit(False)))
        return F.sort_array(F.transform(found, lambda w: w["i"]))

    def covered(ws: Column) -> Column:
        starts = common.let(F.sort_array(ws), repeated)
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-9).alias("at")), lambda a, s: F.struct(
            (a["n"] + F.least(F.lit(5), s - a["at"])).alias("n"), s.alias("at")), lambda a: a["n"])

    def count(ws: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(ws, lambda w: w["h"])))
        return F.when(distinct == F.size(ws), F.lit(0)).otherwise(covered(ws))

    return F.when(F.size(hashes) < 6, F.lit(0)).otherwise(common.let(windows(hashes), count))


def describe(text: Column) -> Column:
    """The base counts and the ratios that rules may use, as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def counts(words: Column) -> Column:
        return common.let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: common.let(lines, lambda ls: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            _without(text, SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(h).cast("long").alias("n_repeat_words"),
            F.greatest(F.size(ls), F.lit(1)).alias("lines"),
            _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"),
            _without(text, "!?").alias("cries"),
            _without(text, "0123456789").alias("digits"),
            F.size(F.array_distinct(h)).alias("distinct"),
        )))

    def ratios(c: Column) -> Column:
        n, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
        return F.struct(
            *[c[name].alias(name) for name in BASE],
            (c["word_chars"] / n).alias("chars_per_word"),
            (c["n_symbols"] / n).alias("symbols_per_word"),
            (c["n_dup_lines"] / c["lines"]).alias("dup_line_share"),
            (c["n_repeat_words"] / n).alias("repeat_share"),
            (c["upper"] / chars).alias("upper_share"),
            (c["cries"] / n).alias("cries_per_word"),
            (c["digits"] / chars).alias("digit_share"),
            (c["distinct"] / n).alias("distinct_share"),
        )

    return common.let(words_of(text), lambda ws: common.let(counts(ws), ratios))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of ``describe``. Narrow: no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), describe(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "cries_per_word",
            "digit_share", "distinct_share")


Get = Callable[[str], Column]  # a statistic by its name


def base_failed(get: Get = F.col) -> Column:
    return (get("n_words") < 10) | (100 * get("n_repeat_words") > 20 * get("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, get: Get) -> Column:
        value = get(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, get: Get = F.col) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(get)
    return out


def _gain(before: tuple[float, float], after: tuple[float, float]) -> float:
    """Rejected documents that stay, times the bits of information that the condition adds about them."""
    (p0, n0), (p, n) = before, after
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p else 0.0


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of the thresholds lie below the value."""
    return F.size(F.filter(F.lit(cuts), lambda t: t < F.col(feature)))


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """feature -> bin -> (rejected, accepted) in one aggregation."""
    bins = F.array(*[
        F.struct(F.lit(f).alias("f"), _bin(f, c).alias("b")) for f, c in cuts.items()])
    found = (rows.select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.b")
             .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect())
    out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in cuts}
    for r in found:
        out[r.f][r.b] = (r.p, r.n)
    return out


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        counts = _histogram(rows.where(covers(rule)), cuts)
        total = tuple(sum(x[k] for x in next(iter(counts.values())).values()) for k in (0, 1))
        if not total[0] or not total[1]:
            break
        best, chosen = 0.0, None
        for f, c in cuts.items():
            below = [0, 0]
            for b, threshold in enumerate(c):
                p, n = counts[f].get(b, (0, 0))
                below = [below[0] + p, below[1] + n]
                for above, after in ((False, tuple(below)), (True, (total[0] - below[0], total[1] - below[1]))):
                    if (g := _gain(total, after)) > best + 1e-9:
                        best, chosen = g, Condition(f, above, threshold)
        if chosen is None:
            break
        rule = (*rule, chosen)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the rule that does best on held-out rows, with the (rejected, accepted) it covers there."""
    prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
    sums = [F.sum(F.when(covers(r), x)).alias(f"{name}{k}") for k, r in enumerate(prefixes)
            for name, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
    got = rows.agg(*sums).first()
    scored = [((p - n) / (p + n) if p + n else -1.0, -k, p, n) for k in range(len(prefixes))
              for p, n in [(got[f"p{k}"] or 0, got[f"n{k}"] or 0)]]
    _, k, p, n = max(scored)
    return prefixes[-k], p, n


def marks_of(labels: DataFrame) -> DataFrame:
    """(doc_id, bad) of ``labels`` (doc_id, quality 0 or 1), thinned to about ``MOST_LABELLED`` documents."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    n = marks.count()
    if n > MOST_LABELLED:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(n)) < MOST_LABELLED)
    return marks


def learn(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list of rejecting rules, from staged statistics and ``labels`` (doc_id, quality 0 or 1)."""
    marks = marks_of(labels)
    usable = stats.where(~base_failed()).select("doc_id", *FEATURES)
    rows = common.stage(usable.join(marks, "doc_id").withColumn(
        "fold", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(3))), "labelled")
    grow, prune = rows.where("fold > 0"), rows.where("fold = 0")
    if not rows.where("bad = 1").head(1):
        return []
    shares = [k / BINS for k in range(1, BINS)]
    cut = {}
    for kind, part in (("all", grow), ("bad", grow.where("bad = 1")), ("good", grow.where("bad = 0"))):
        cut[kind] = part.agg(*[F.percentile_approx(f, [*shares, 0.99, 0.999], 1000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({x for c in cut.values() for x in (c[f] or [])}) for f in FEATURES}
    rules: list[Rule] = []
    left, left_prune = grow, prune
    while len(rules) < MOST_RULES:
        rule = _grow(left, cuts)
        if not rule:
            break
        rule, p, n_wrong = _prune(left_prune, rule)
        if p < FEWEST or p < PRECISION * (p + n_wrong):
            break
        rules.append(rule)
        left, left_prune = left.where(~covers(rule)), left_prune.where(~covers(rule))
    return rules


def verdict(rules: list[Rule], get: Get = F.col) -> Column:
    """The decision list as one ordered conditional expression: true keeps."""
    if not rules:
        return F.lit(True)
    out = F.when(covers(rules[0], get), False)
    for rule in rules[1:]:
        out = out.when(covers(rule, get), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    stats = common.stage(statistics(docs), "statistics")
    keep = verdict(learn(stats, labels))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"), (~base_failed() & keep).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass the base rules and the list."""
    # the list is learned from labelled documents only; their ids, 8 bytes each, are bounded by MOST_LABELLED
    ids = common.stage(marks_of(labels).select("doc_id").distinct(), "labelled_ids")
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    rules = learn(common.stage(statistics(labelled), "statistics"), labels)

    def good(s: Column) -> Column:
        return ~base_failed(s.getField) & verdict(rules, s.getField)

    return docs.where(common.let(describe(F.coalesce("text", F.lit(""))), good))
