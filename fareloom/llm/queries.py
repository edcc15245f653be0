"""Registered queries: every operator of this subpackage over its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.llm.conversations import damaged, repair, reports
from fareloom.llm.decontamination import contaminated_pairs
from fareloom.llm.html_extract import extract
from fareloom.llm.language_id import identify
from fareloom.llm.license_scan import scan
from fareloom.llm.minhash import Settings, near_duplicates
from fareloom.llm.oracles import ORACLE_SQL
from fareloom.llm.packing import pack
from fareloom.llm.quality_rules import judge
from fareloom.llm.storage import scratch_path
from fareloom.llm.substring_dedup import remove_repeats
from fareloom.llm.token_counts import count_tokens
from fareloom.llm.token_files import read_token_files, write_token_files

from fareloom.llm.warc import read_archives, write_archives
from fareloom.llm.whitening import whiten


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Settings(words=2, percent=80))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.withColumn("contaminated", F.lit(True))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=2048)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = scratch_path(spark, "op6")
    archives = write_archives(table(spark, sf_dir, "pages"), directory, least_payload=1000)
    return read_archives(archives, directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, (n_words, n_removed) = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), collapse=True)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", F.col(n_words).alias("n_words"), F.col(n_removed).alias("n_removed"), digest.alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = scratch_path(spark, "op9")
    files = write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), directory, end_id=2)
    return read_token_files(files, directory)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4, scale=256)
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return reports(repair(damaged(turns), turns))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def queries() -> dict:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_language_id": op3_language_id,
        "op4_packing": op4_packing,
        "op5_html_extraction": op5_html_extraction,
        "op6_warc": op6_warc,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_files": op9_token_files,
        "op10_token_counts": op10_token_counts,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict:
    return dict(ORACLE_SQL)
