"""Distinct counts from stored, mergeable sketches.

A sketch has a fixed size (about 2.6 kB at 12 bits) whatever it has seen, and the union of two sketches is the sketch of all
rows of both.  So each part of a table (a day, a file, a batch that was appended) is scanned once; counts of any union of
parts follow from the stored rows.  The relative standard error is 1.04 / sqrt(2 ** bits), 1.6 % at 12 bits, so an estimate is
within 5 % in 998 of 1,000 cases.  Exact counts (``facts.column_facts``) stay the default of the profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.facts import unpivoted

BITS = 12
ERROR = 0.05


def column_sketches(df: DataFrame, columns: list[str] | None = None, part: Column | None = None, bits: int = BITS) -> DataFrame:
    """(part, column, n_rows, non_null, sketch), one row per part and column; null parts are a part.

    One shuffle of sketches, which are combined before it: a hot part or column costs one row per task.
    """
    columns = columns or df.columns
    cells = unpivoted(df.withColumn("_part", (F.lit("") if part is None else part).cast("string")), columns, ["_part"])
    return cells.groupBy(F.col("_part").alias("part"), "column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("non_null"), F.hll_sketch_agg("value", F.lit(bits)).alias("sketch"))


def merged(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The parts' sketches as one per column (and per value of ``by``)."""
    return sketches.groupBy(*(by or []), "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("non_null").alias("non_null"), F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame) -> DataFrame:
    """Adds ``n_unique``, the estimated number of distinct values."""
    return sketches.withColumn("n_unique", F.hll_sketch_estimate("sketch")).drop("sketch")
