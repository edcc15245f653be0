"""Learned decision lists over document statistics, as ordered Spark conditional expressions.

Everything here is DataFrame work: statistics come from array functions inside one row, learning reads
class counts per threshold from grouped aggregates, and the learned list is a ``CASE WHEN`` column.

Learning is sequential covering. A rule for the class "low quality" grows by the condition
(statistic above or below a threshold) with the greatest information gain on two thirds of the
labelled rows, is pruned to the prefix with the best balance of hits and false hits on the other third,
and is kept while its precision there is high enough; the rows it covers leave and the next rule is
grown. Thresholds are quantiles over all labelled rows.
"""

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.storage import fresh, materialize

#: Characters that end a word; fixed by the definition of words.
WHITE_SPACE = " \t\n\x0b\x0c\r"
_SPACE_CLASS = "[\\x20\\x09-\\x0D]"
_WORD_CLASS = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word_chars", "symbols_per_word", "dup_lines_per_word", "repeat_share", "upper_share", "marks_per_word"]


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and a struct column of statistics, with that column's name.

    The struct has the long fields of ``BASE`` and the double fields of ``FEATURES`` (n_words is in both
    as a long). A null or empty text has all counts 0 and all ratios 0. No row is shuffled; the cost of
    a text is that of sorting its word windows.
    """
    body, words, grams, spots, places, stats = (fresh(f"_quality_{k}", docs) for k in ("text", "words", "grams", "spots", "places", "stats"))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    step = docs.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit("")))
    step = step.withColumn(words, F.filter(F.split(body, f"{_SPACE_CLASS}+"), lambda w: w != ""))
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    n = F.size(words)
    step = step.withColumn(grams, F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")))
    numbered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.withColumn(spots, F.when(F.size(F.array_distinct(grams)) == F.size(grams), none).otherwise(numbered))
    twice = F.filter(spots, lambda x, k: F.get(spots, k - 1)["h"].eqNullSafe(x["h"]) | F.get(spots, k + 1)["h"].eqNullSafe(x["h"]))
    step = step.withColumn(places, F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(places, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - i, F.lit(3)))), F.lit(0), lambda total, x: total + x
    )
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(_WORD_CLASS))
    without = lambda chars: F.length(F.translate(body, chars, ""))
    step = step.select(
        *keep,
        F.inline(
            F.array(
                F.struct(
                    n.cast("long").alias("n_words"),
                    without(WHITE_SPACE).cast("long").alias("word_chars"),
                    (F.length(body) - without(SYMBOLS)).cast("long").alias("n_symbols"),
                    F.aggregate(F.array(lines), F.lit(0), lambda _, x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                    covered.cast("long").alias("n_repeat_words"),
                    (F.length(body) - F.length(F.regexp_replace(body, "\\p{Lu}", ""))).cast("long").alias("_n_upper"),
                    (F.length(body) - without("!|")).cast("long").alias("_n_marks"),
                ).alias("s")
            )
        ).alias(*(names := [fresh(f"_quality_s{k}", docs) for k in range(7)])),
    )
    n_words, word_chars, n_symbols, n_dup, n_repeat, n_upper, n_marks = (F.col(c) for c in names)
    per = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    return step.select(
        *keep,
        F.struct(
            n_words.alias("n_words"),
            word_chars.alias("word_chars"),
            n_symbols.alias("n_symbols"),
            n_dup.alias("n_dup_lines"),
            n_repeat.alias("n_repeat_words"),
            per(word_chars, n_words).alias("mean_word_chars"),
            per(n_symbols, n_words).alias("symbols_per_word"),
            per(n_dup, n_words).alias("dup_lines_per_word"),
            per(n_repeat, n_words).alias("repeat_share"),
            per(n_upper, word_chars).alias("upper_share"),
            per(n_marks, n_words).alias("marks_per_word"),
        ).alias(stats),
    ), stats


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, stats: str) -> Column:
        value = F.col(stats)[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered rules for low quality; a row that none of them covers is good."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self, stats: str) -> Column:
        """True for a row to keep; the first rule that holds decides."""
        out = None
        for rule in self.rules:
            out = (F if out is None else out).when(_all(rule, stats), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join([f"if {' and '.join(map(str, r))}: low" for r in self.rules] + ["else: good"])


def _all(rule: list[Condition], stats: str) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column(stats)
    return out


def learn(labelled: DataFrame, stats: str, label: str, max_rules: int = 8, max_conditions: int = 3, n_thresholds: int = 32, least_cover: int = 10, least_precision: float = 0.95) -> DecisionList:
    """Sequential covering over rows with a struct of statistics and a label (1 good, 0 low).

    Rows without a label don't count. All labelled rows take part. Without rows of both classes the list
    is empty. What reaches the driver is bounded by statistics times thresholds, never by rows. Equal
    gains are decided by the order of ``FEATURES``, then the smaller threshold.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(stats, (F.col(label) == 0).alias("low"))
    quantiles = rows.agg(*(F.percentile_approx(F.col(stats)[f].cast("double"), [k / n_thresholds for k in range(n_thresholds)], 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(quantiles[f] or [])) for f in FEATURES}
    bin_of = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda t: F.col(stats)[f] > t)) if cuts[f] else F.lit(0)
    # rows of equal bins and class act alike: the learner works on their counts
    fold = (F.xxhash64(*(F.col(stats)[f] for f in FEATURES)) % 3) == 0
    cells = rows.select(*(bin_of(f).alias(f) for f in FEATURES), "low", fold.alias("held_out")).groupBy(*FEATURES, "low", "held_out").agg(F.count("*").alias("n"))
    cells = materialize(cells.coalesce(8), "quality-cells")

    def holds(conditions) -> Column:
        out = F.lit(True)
        for c in conditions:
            k = cuts[c.feature].index(c.threshold)
            out = out & ((F.col(c.feature) > k) if c.above else (F.col(c.feature) <= k))
        return out

    found = DecisionList()
    while len(found.rules) < max_rules:
        left = cells
        for rule in found.rules:
            left = left.where(~holds(rule))
        rule = _grow(left.where(~F.col("held_out")), cuts, holds, max_conditions, least_cover)
        if not rule:
            break
        ends = range(1, len(rule) + 1)
        counts = left.where("held_out").agg(*(F.coalesce(F.sum(F.when((F.col("low") == low) & holds(rule[:k]), F.col("n"))), F.lit(0)).alias(f"n{k}_{int(low)}") for k in ends for low in (True, False))).first()
        worth = {k: (counts[f"n{k}_1"] - counts[f"n{k}_0"]) / max(1, counts[f"n{k}_1"] + counts[f"n{k}_0"]) for k in ends}
        best = max(ends, key=lambda k: (worth[k], -k))
        hits, misses = counts[f"n{best}_1"], counts[f"n{best}_0"]
        if hits + misses < max(1, least_cover // 3) or hits < least_precision * (hits + misses):
            break
        found.rules.append(rule[:best])
    return _centred(found, rows, stats)


def _centred(found: DecisionList, rows: DataFrame, stats: str) -> DecisionList:
    """The same rules with every threshold midway between the labelled values on its two sides."""
    used = sorted({(c.feature, c.threshold) for rule in found.rules for c in rule})
    if not used:
        return found
    value = lambda f: F.col(stats)[f].cast("double")
    sides = rows.agg(*(x for k, (f, t) in enumerate(used) for x in (F.max(F.when(value(f) <= t, value(f))).alias(f"a{k}"), F.min(F.when(value(f) > t, value(f))).alias(f"b{k}")))).first()
    middle = {u: (u[1] if sides[f"a{k}"] is None or sides[f"b{k}"] is None else (sides[f"a{k}"] + sides[f"b{k}"]) / 2) for k, u in enumerate(used)}
    return DecisionList([[Condition(c.feature, c.above, middle[c.feature, c.threshold]) for c in rule] for rule in found.rules])


def _grow(cells: DataFrame, cuts: dict, holds, max_conditions: int, least_cover: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < max_conditions:
        pairs = ", ".join(f"'{f}', `{f}`" for f in FEATURES)
        counted = cells.where(holds(rule)).selectExpr(f"stack({len(FEATURES)}, {pairs}) AS (feature, bin)", "low", "n").groupBy("feature", "bin", "low").agg(F.sum("n").alias("n")).collect()
        at: dict = {}
        for r in counted:
            at.setdefault(r.feature, {}).setdefault(r.bin, [0, 0])[0 if r.low else 1] += r.n
        if not at:
            break
        p0, n0 = (sum(x[k] for x in next(iter(at.values())).values()) for k in (0, 1))
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for f in FEATURES:
            below = [0, 0]
            for k, threshold in enumerate(cuts[f]):
                below = [a + b for a, b in zip(below, at[f].get(k, [0, 0]), strict=True)]
                for above, (p, n) in ((False, below), (True, [p0 - below[0], n0 - below[1]])):
                    if p >= least_cover and p + n < p0 + n0:
                        g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Condition(f, above, threshold), g
        if best is None:
            break
        rule.append(best)
    return rule


def _training_rows(stats_rows: DataFrame, stats: str, labels: DataFrame, id_col: str) -> DataFrame:
    given = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(F.min("quality").alias("_label"))
    return stats_rows.select(F.col(id_col).alias("_row_id"), stats).join(given, F.col("_row_id") == F.col("_label_id")).select(stats, "_label")


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", carry: bool = False) -> tuple[DataFrame, DecisionList]:
    """Base statistics, base_failed and kept for every row of ``docs``, and the learned list.

    ``labels`` has doc_id and quality (1 good, 0 low; of repeated labels the lowest counts; null ids and
    labels don't). ``kept`` is false where the base rule fails, else the list's verdict. With ``carry``
    the columns of ``docs`` come along in front of a struct column ``_judged`` (with more underscores where ``docs`` has that name), else ``id_col`` and the
    statistics are returned. Every row of ``docs`` is returned, repeated ids and null ids included; an
    empty table gives an empty result.
    """
    source = docs if carry else docs.select(F.col(id_col), F.col(text))
    rows, stats = with_statistics(source, text)
    rows = materialize(rows if carry else rows.select(id_col, stats), "quality-statistics")
    rules = learn(_training_rows(rows, stats, labels, id_col), stats, "_label")
    s = F.col(stats)
    verdict = ~base_failed(stats) & rules.verdict(stats)
    if carry:
        return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.struct(*(s[c] for c in BASE), base_failed(stats).alias("base_failed"), verdict.alias("kept")).alias(fresh("_judged", docs))), rules
    return rows.select(F.col(id_col), *(s[c].alias(c) for c in BASE), base_failed(stats).alias("base_failed"), verdict.alias("kept")), rules


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rule and the learned list keep, with their own columns."""
    judged, _ = judge(docs, labels, id_col, text, carry=True)
    return judged.where(F.col(fresh("_judged", docs))["kept"]).select(*(F.col(f"`{c}`") for c in docs.columns))
