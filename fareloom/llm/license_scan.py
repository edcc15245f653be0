"""License scan of texts by ordered signature rules; DataFrame functions only, no row is shuffled.

A text becomes its words, lower-cased and joined by one space. The distinct words that are keywords of any rule gate the rules:
only rules whose keywords all occur are searched, in their order (by kind, longer signatures first). A match that is
accepted has its interval of words blanked out, one placeholder a word; what lies inside it or reaches into it
can't match for a later rule. So of overlapping detections the one of the better rule is left, in time linear in the text for each gated rule.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.license_rules import KINDS, Rule, rules
from fareloom.llm.storage import fresh

#: Phrases of the base labels; fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_SCORE = 0.3
#: A word is a run of digits, letters and all characters beyond ASCII.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: In front of a blanked match's number, and a blanked word behind its first one: no characters of words.
_MARK, _BLANK = "\x01", "\x02"

RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _table(found: list[Rule]) -> Column:
    """The rules as a literal array of structs, in their order."""
    row = lambda k, r: F.struct(F.lit(k).alias("no"), F.lit(_whole(r.pattern)).alias("pattern"), F.array(*map(F.lit, r.keywords)).alias("keywords"))
    return F.array(*(row(k, r) for k, r in enumerate(found)))


def _blank(body: Column, rule: Column) -> Column:
    """``body`` with the rule's matches blanked out: mark, rule number, colon and word count, then a placeholder for each other word."""
    words = lambda m: F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1
    mark = lambda m: F.concat(F.lit(_MARK), rule["no"].cast("string"), F.lit(":"), words(m).cast("string"), F.repeat(F.lit(f" {_BLANK}"), words(m) - 1))
    pieces, matches = F.split(body, rule["pattern"], -1), F.regexp_extract_all(body, rule["pattern"], F.lit(0))
    joined = F.array_join(F.zip_with(pieces, matches, lambda p, m: F.concat(p, F.coalesce(mark(m), F.lit("")))), "")
    return F.when(F.rlike(body, rule["pattern"]), joined).otherwise(body)


def scan(docs: DataFrame, text: str = "text", found: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the licenses that its texts name.

    Added columns (an underscore in front where the name is taken): n_words; n_base (places of the base phrases), first_word and
    last_word (their least and greatest start, words from 0, null if none); base_labels and labels (distinct, sorted, joined by
    commas, empty if none; labels holds the base ones as well); score (of the best detection's kind, 0.3 if there are base phrases only, 0 if
    nothing); detections (array of first_word, n_words, label, kind of the accepted detections in order). A null or empty text has no
    words. Every row stands for itself, repeated rows and null ids too; an empty table gives no rows.
    """
    found = rules() if found is None else found
    body, words, hits, blanked, marked, places = (fresh(f"_license_{k}", docs) for k in ("body", "words", "hits", "blanked", "marked", "places"))
    names = {c: fresh(c, docs) for c in RESULTS}
    # lower() would make an ASCII k of the Kelvin sign; no other character beyond ASCII becomes a word of ASCII alone
    plain = F.lower(F.replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u00e5")))
    step = docs.withColumn(body, F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, _BETWEEN, " ")), F.lit(" ")))
    step = step.withColumn(words, F.filter(F.split(body, " "), lambda w: w != ""))
    keywords = sorted({w for r in found for w in r.keywords} | {w for p in BASE for w in p.split()})
    step = step.withColumn(hits, F.array_intersect(words, F.array(*map(F.lit, keywords)) if keywords else F.array().cast("array<string>")))

    gated = F.filter(_table(found), lambda r: F.size(F.array_except(r["keywords"], F.col(hits))) == 0) if found else None
    searched = F.aggregate(gated, F.col(body), _blank) if found else F.col(body)
    step = step.withColumn(blanked, F.when(F.size(hits) > 0, searched).otherwise(F.lit("")))
    kinds, labels = (F.array(*(F.lit(getattr(r, c)) for r in found)) if found else F.array().cast("array<string>") for c in ("kind", "label"))
    numbered = F.filter(F.transform(F.split(F.substring(blanked, 2, 2**31 - 1), " "), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.startswith(x["w"], F.lit(_MARK)))

    def detection(x: Column) -> Column:
        parts = F.split(F.substring(x["w"], 2, 40), ":")
        no = F.get(parts, F.lit(0)).cast("int")
        return F.struct(x["i"].cast("long").alias("first_word"), F.get(parts, F.lit(1)).cast("int").alias("n_words"), F.get(labels, no).alias("label"), F.get(kinds, no).alias("kind"))

    step = step.withColumn(names["detections"], F.transform(numbered, detection))

    phrases = _whole("|".join(BASE))
    step = step.withColumn(marked, F.when(F.arrays_overlap(hits, F.array(*(F.lit(p.split()[0]) for p in BASE))), F.regexp_replace(body, phrases, f"{_MARK}$0")).otherwise(F.lit("")))
    starts = F.filter(F.transform(F.split(F.substring(marked, 2, 2**31 - 1), " "), lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i.cast("long"))), lambda i: i.isNotNull())
    step = step.withColumn(places, starts)
    base = F.filter(F.array(*(F.when(F.contains(F.col(marked), F.lit(f"{_MARK}{phrase} ")), label) for phrase, label in BASE.items())), lambda x: x.isNotNull())
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    detections = F.col(names["detections"])
    scores = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    best = F.array_max(F.transform(detections, lambda d: F.element_at(scores, d["kind"])))
    results = {
        "n_words": F.size(words).cast("long"),
        "n_base": F.size(places).cast("long"),
        "first_word": F.array_min(places),
        "last_word": F.array_max(places),
        "base_labels": listed(base),
        "labels": listed(F.concat(base, F.transform(detections, lambda d: d["label"]))),
        "score": F.coalesce(best, F.when(F.size(places) > 0, BASE_SCORE).otherwise(0.0)),
        "detections": detections,
    }
    return step.select(*(F.col(f"`{c}`") for c in docs.columns), *(column.alias(names[c]) for c, column in results.items()))
