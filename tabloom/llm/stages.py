"""Stages of the corpus pipeline: (spark, docs, folder of tables) to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import minhash_dedup, packing, quality, suffix_dedup, toxicity
from tabloom.llm.common import small_batches
from tabloom.llm.queries import table, tokenizer_path

NEAR_PERCENT = 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is usual for trusted text of their language."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not likely to be toxic."""
    return toxicity.harmless(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, as ``minhash_dedup.without_near_duplicates`` says, which also names
    what nulls, empty texts and repeated rows give."""
    small_batches(spark)
    return minhash_dedup.without_near_duplicates(docs, percent=NEAR_PERCENT)


def repeat_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur more than once; a character of which bytes went goes as a whole."""
    small_batches(spark)
    rest = {c: f"_rest{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    kept = suffix_dedup.remove_repeats(docs.withColumnsRenamed(rest), carry=list(rest.values()), as_text=True)
    kept = kept.select("doc_id", F.col("kept").alias("text"), F.char_length("kept").cast("long").alias("n_chars"), *rest.values())
    return kept.withColumnsRenamed({v: c for c, v in rest.items()}).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())
