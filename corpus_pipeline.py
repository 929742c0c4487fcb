"""From raw documents to packed sequences: five stages, each an operator of ``ledgerloom.llm`` at work."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid
from ledgerloom.llm.exact_dedup import DigestIndex, deduplicate
from ledgerloom.llm.minhash import near_duplicates
from ledgerloom.llm.mixing import mix, mixed_documents
from ledgerloom.llm.packing import pack
from ledgerloom.llm.scratch import fresh_path, row_number, stored

#: Not expressible in SQL: language profiles, near-duplicate links and token ids.
ORACLE_SQL = None


def _rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number is in ``wanted``."""
    numbered = docs.select(row_number().alias("own_row"), F.struct("*").alias("doc"))
    kept = numbered.join(wanted.select(F.col("row").alias("kept_row")), F.col("own_row") == F.col("kept_row"), "left_semi")
    return kept.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; a missing ``lang`` becomes the one found.

    What goes: texts without a letter, null ones included, and texts that are
    less near to their language than half of what 999 in 1000 held-out documents
    found to be in it reach, such as other scripts and noise. Repeated rows are judged alike; other
    columns stay as they are, whatever their names; an empty table gives no rows.
    """
    held = langid.held_out(F.col("doc_id"))
    profiles = stored(langid.learn(docs.where(~held)), "profiles")
    bounds = langid.least_nearness(docs.where(held), profiles).withColumnRenamed("lang", "bound_lang")
    held_rows = docs.select("text", F.struct("*").alias("doc"))
    found = langid.predict(held_rows, profiles).where(F.col("lang_pred") != langid.UNKNOWN)
    found = found.join(F.broadcast(bounds), F.col("lang_pred") == F.col("bound_lang"), "left").where(F.col("nearness") >= F.coalesce("bound", F.lit(0.0)))
    lang = F.coalesce(F.col("doc")["lang"], "lang_pred")
    return found.select(*((lang if c == "lang" else F.col("doc")[c]).alias(c) for c in docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then that with the smallest doc_id.

    Null and empty texts are one group; of rows with that doc_id, or wholly alike,
    one stays. Other columns stay, whatever their names; an empty table gives no rows.
    """
    index = DigestIndex(f"digest_index_{uuid.uuid4().hex}", fresh_path(spark, "digest-index"))
    return _rows(docs, deduplicate(docs, index).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; documents without words stay."""
    return _rows(docs, near_duplicates(docs).where("stays"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a last partial copy ends after the words that are taken.

    A document of no words is not taken, null texts included; a null source is a source; repeated
    rows are taken one by one; other columns are copied, whatever their names; an
    empty table gives no rows.
    """
    return mixed_documents(docs, mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids.

    A null text has its end token only; repeated rows are packed one by one; other
    columns are not read; an empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
