"""Training-data pipeline: documents in, packed token sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import stages
from tabloom.session import scratch_path

STAGES = [
    ("quality", stages.quality_filter),
    ("toxicity", stages.toxicity_filter),
    ("near_duplicates", stages.near_duplicate_filter),
    ("repeats", stages.repeat_filter),
    ("packing", stages.packed),
]

# Trained models and token ids are beyond SQL; the pipeline is tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
