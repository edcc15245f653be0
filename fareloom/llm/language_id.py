"""Language of web pages by fusing four kinds of evidence in Bayes' rule.

    P(l | page) ~ P(text | l) * P(declared markup language | l) * P(address suffix | l) * P(l | host)

* The text likelihood is a naive Bayes model of byte trigrams, fitted on a bounded sample of labelled texts
  and tempered, since neighbouring trigrams are not independent.
* The tables for declared languages and address suffixes are smoothed counts of how often each occurs
  with each language, the language being taken from the text alone.
* The prior of a host is smoothed towards its domain, the domain towards its suffix and the suffix towards
  the whole corpus; all counts come from grouped aggregation and a page's own vote is taken out.

Counts cover all pages. Only per-language totals and the trigram model reach the driver: their size is that of
the number of languages, not of the pages or texts. Every language of the labelled texts is fitted.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.html_blocks import page_blocks
from fareloom.llm.storage import materialize
from fareloom.llm.textwords import as_text, byte_slices

#: Trigram buckets, and distinct texts a language that the model is fitted on (in expectation).
BUCKETS = 1 << 15
TRAINING_TEXTS = 2_000
#: Bytes of a model that is broadcast at most (128 kB a language): more languages than that are an error.
MOST_MODEL_BYTES = 512 << 20
#: Trigrams that count in full; a longer text counts as if it had so many.
FULL_TRIGRAMS = 60


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text, and the texts' bounds. A-Z count as a-z; runs of bytes
    that aren't letters count as one space."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lower = data | np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    letter = (lower >= 128) | ((lower >= 97) & (lower <= 122))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other bytes stays, as a space
    value = np.where(letter, lower, np.uint8(32))[keep].astype(np.uint32)
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    if len(value) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    mixed = (value[:-2] * np.uint32(0x9E3779B1) ^ value[1:-1] * np.uint32(0x85EBCA77) ^ value[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    buckets = (mixed >> np.uint32(17)).astype(np.int64) % BUCKETS
    counts = np.maximum(np.diff(bounds) - 2, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(bounds[:-1] - out[:-1], counts) + np.arange(int(out[-1]))
    return buckets[at], out


def fit_text_model(labelled: DataFrame, language: str = "lang", text: str = "text", texts: int = TRAINING_TEXTS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of trigrams, from about ``texts`` distinct texts of each language.

    The sample is by the hash of the text, each text once; of a language with fewer texts all are taken. Rows with
    a null language or text don't count.
    """
    rows = labelled.select(F.lower(F.trim(F.col(language))).alias("lang"), F.col(text).cast("string").alias("text")).where("lang != '' and text is not null")
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("hash"))
    sizes = {r.lang: r.n for r in hashed.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, BUCKETS))
    if len(languages) * BUCKETS * 4 > MOST_MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages make a model of more than {MOST_MODEL_BYTES} bytes")
    share = F.element_at(F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, 1.05 * texts / sizes[k])))), F.col("lang"))
    sample = hashed.where(F.pmod("hash", F.lit(1_000_000)) < share * 1_000_000).groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches):
        table = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            row = {k: n for n, k in enumerate(languages)}
            which = np.array([row[k] for k in batch.column(0).to_pylist()], np.int64)
            column = as_text(batch.column(1))
            for at, end in byte_slices(column):
                buckets, bounds = _trigrams(column.slice(at, end - at))
                table += np.bincount(np.repeat(which[at:end], np.diff(bounds)) * BUCKETS + buckets, minlength=table.size).reshape(table.shape)
        lang, bucket = np.nonzero(table)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang), "bucket": pa.array(bucket), "n": pa.array(table[lang, bucket])})

    found = sample.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in found:
        table[r.lang, r.bucket] += r.n
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def _argmax(scores: Column, languages: list[str]) -> Column:
    """The language of the greatest score; the first in order on ties."""
    return F.element_at(F.array(*map(F.lit, languages)), F.array_position(scores, F.array_max(scores)).cast("int"))


def _divided(values: str, by: Column) -> Column:
    return F.transform(values, lambda x: x / by)


def _table_evidence(rows: DataFrame, key: str, languages: list[str], weight: float) -> DataFrame:
    """key and ``{key}_log``: log P(key | language) for each language, smoothed by ``weight`` spread evenly."""
    by = rows.groupBy(key).pivot("vote", languages).count().na.fill(0, languages)
    totals = by.agg(F.count("*").alias("keys"), *(F.sum(f"`{k}`").alias(k) for k in languages)).first()
    n_keys = max(1, totals.keys)
    logs = [F.log((F.col(f"`{k}`") + weight / n_keys) / ((totals[k] or 0) + weight)) for k in languages]
    return by.select(key, F.array(*logs).alias(f"{key}_log"))


def identify(pages: DataFrame, labelled: DataFrame, strength: float = 4.0) -> DataFrame:
    """page_id, url, host, declared (language of the markup, null if none), text_lang (by the text alone),
    lang (by all evidence, null if ``labelled`` has no language) and confidence (its posterior, 4 places).

    ``pages``: page_id, url, html; ``labelled``: text, lang; ``strength``: pages that a prior one level up counts
    for. A page without text is judged by the other evidence; a page without any by the corpus. Null and
    malformed urls belong to the host "". Every row is returned, repeated and null ids included; an empty
    table gives an empty result. Other columns are not read.
    """
    languages, logs = fit_text_model(labelled)
    spark = pages.sparkSession
    model = spark.sparkContext.broadcast(logs.astype(np.float32))
    n = len(languages)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))

    def score(batches):
        for batch in batches:
            texts, declared = [], []
            for html in batch.column(3).to_pylist():
                blocks, language = page_blocks(html)
                texts.append(" ".join(t for t, _ in blocks))
                declared.append(language.strip().lower().replace("_", "-").split("-")[0] or None)
            column, rows = as_text(pa.array(texts, pa.large_string())), []
            for at, end in byte_slices(column):
                buckets, bounds = _trigrams(column.slice(at, end - at))
                counts = np.diff(bounds)
                row = np.repeat(np.arange(end - at), counts)
                # a language at a time: memory doesn't grow with their number
                sums = np.stack([np.bincount(row, weights=of_language[buckets], minlength=end - at) for of_language in model.value], axis=1) if n else np.zeros((end - at, 0))
                rows.append(sums * np.minimum(1.0, FULL_TRIGRAMS / np.maximum(counts, 1))[:, None])
            logs = np.round(np.concatenate(rows), 6) if rows else np.zeros((0, n))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n), pa.array(logs.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(declared, pa.string()), lists], ["page_id", "url", "host", "declared", "text_log"])

    scored = given.mapInArrow(score, "page_id long, url string, host string, declared string, text_log array<double>")
    if not languages:
        nothing = F.lit(None).cast("string")
        return scored.select("page_id", "url", "host", "declared", nothing.alias("text_lang"), nothing.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    labels = F.split("host", "\\.")
    rows = materialize(
        scored.select(
            "*",
            _argmax(F.col("text_log"), languages).alias("vote"),
            F.coalesce("declared", F.lit("")).alias("markup"),
            F.substring_index("host", ".", -1).alias("suffix"),
            F.when(F.size(labels) > 2, F.substring_index("host", ".", -2)).otherwise(F.col("host")).alias("domain"),
        ),
        "page-scores",
    )
    everything = rows.groupBy("vote").count().collect()
    total = sum(r["count"] for r in everything)
    base = {r.vote: r["count"] for r in everything}
    corpus = [(base.get(k, 0) + strength / n) / (total + strength) for k in languages]

    def counted(level: str) -> DataFrame:
        by = rows.groupBy(level).pivot("vote", languages).count().na.fill(0, languages)
        return by.select(level, F.array(*(F.col(f"`{k}`").cast("double") for k in languages)).alias(f"{level}_n"))

    # from the corpus down to the host: each level leans on the one above by `strength` pages
    hosts = rows.select("host", "domain", "suffix").distinct().join(counted("suffix"), "suffix").join(counted("domain"), "domain").join(counted("host"), "host")
    # in files: the join with the pages, of which one host may have very many, stands on nothing that Spark couldn't split
    hosts = materialize(hosts.select("host", "suffix_n", "domain_n", "host_n"), "hosts")
    own = F.array(*((F.col("vote") == k).cast("double") for k in languages))
    of_markup, of_suffix = (materialize(_table_evidence(rows, key, languages, strength * n), key) for key in ("markup", "suffix"))
    fused = rows.join(hosts, "host").join(of_markup, "markup").join(of_suffix, "suffix")
    prior = F.array(*map(F.lit, corpus))
    for level in ("suffix", "domain", "host"):
        fused = fused.withColumn(f"{level}_rest", F.zip_with(f"{level}_n", own, lambda a, b: a - b)).withColumn(f"{level}_sum", F.aggregate(f"{level}_rest", F.lit(0.0), lambda a, b: a + b))
        fused = fused.withColumn(f"{level}_prior", F.zip_with(f"{level}_rest", prior, lambda a, b: a + strength * b))
        fused = fused.withColumn(f"{level}_prior", _divided(f"{level}_prior", F.col(f"{level}_sum") + strength))
        prior = F.col(f"{level}_prior")
    total_log = F.zip_with(F.zip_with("text_log", F.transform("host_prior", lambda x: F.log(x)), lambda a, b: a + b), F.zip_with("markup_log", "suffix_log", lambda a, b: a + b), lambda a, b: a + b)
    fused = fused.withColumn("all_log", total_log)
    weights = F.transform("all_log", lambda x: F.exp(x - F.array_max("all_log")))
    return fused.select("page_id", "url", "host", "declared", F.col("vote").alias("text_lang"), _argmax(F.col("all_log"), languages).alias("lang"), F.round(1 / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b), 4).alias("confidence"))
