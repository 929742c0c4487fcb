"""The registered queries of this subpackage, each over its whole table, and their SQL."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import avi, html_text, langid, oracle, pii, secrets
from ledgerloom.llm.divergence import divergence
from ledgerloom.llm.exact_dedup import DigestIndex, deduplicate
from ledgerloom.llm.minhash import near_duplicates
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.negatives import hard_negatives
from ledgerloom.llm.packing import pack
from ledgerloom.llm.repacking import pack_best_fit
from ledgerloom.llm.scratch import fresh_path, stored
from ledgerloom.llm.substring_dedup import repeated_passages

WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), with_ids=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(f"digest_index_{uuid.uuid4().hex}", fresh_path(spark, "digest-index"))
    return deduplicate(table(spark, sf_dir, "documents"), index).drop("row")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("row")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.features(avi.stored_texts(table(spark, sf_dir, "documents"))).withColumnRenamed("media_id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = stored(langid.learn(docs.where(~langid.held_out(F.col("doc_id")))), "profiles")
    found = langid.predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), profiles)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "nearness")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("row")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row", "stays")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    columns = secrets.digest_columns(F.col("spans"), pii.KINDS[: pii.N_BASE], lambda x: x["strict"])
    return found.select("doc_id", *(c.alias(name) for name, c in columns.items()))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_incrementally(table(spark, sf_dir, "documents"), fresh_path(spark, "secret-ledger"))
    columns = secrets.digest_columns(F.col("spans"), tuple(r.kind for r in secrets.BASE))
    return found.select("doc_id", *(c.alias(name) for name, c in columns.items()))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_repacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), with_ids=False)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_media_columns": op5_media_columns,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_minhash": op8_minhash,
    "op9_pii": op9_pii,
    "op10_secrets": op10_secrets,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_repacking": op12_repacking,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": oracle.OP2, "op6_language_id": oracle.OP6, "op7_mixing": oracle.OP7, "op8_minhash": oracle.OP8, "op10_secrets": oracle.OP10, "op11_hard_negatives": oracle.OP11, "op13_divergence": oracle.OP13}
