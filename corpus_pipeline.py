"""The corpus pipeline: documents in, packed training sequences out, stage by stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of
documents; each works on everything that its predecessor kept.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.llm.decontamination import drop_contaminated
from fareloom.llm.minhash import Settings, keep_one
from fareloom.llm.packing import pack
from fareloom.llm.quality_rules import keep_good
from fareloom.llm.queries import table, vocabulary
from fareloom.llm.storage import materialize
from fareloom.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the decision list learned from ``labels`` rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates (five-word shingles, 0.8)."""
    return keep_one(docs, Settings(words=5, percent=80))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-word windows that an earlier document holds; a document of which nothing is left goes.

    Texts that lose nothing stay as they are; n_chars follows the text.
    """
    cut, (n_words, n_removed) = remove_repeats(docs)
    left = cut.where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_words)))
    n_chars = F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which tiles cover half of a benchmark item or more."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; a row for each piece of a document."""
    return pack(docs, vocabulary("word_bpe_49k.json"), end_id=1)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: A learned decision list, connected components, tiling and packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
