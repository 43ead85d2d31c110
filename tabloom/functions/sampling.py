"""Seeded samples that do not depend on partitioning.

Rows are ordered by ``md5(seed:key)``; the n smallest are the sample.  Spark's
``sample``/``rand`` change with the file layout, this order does not.

On many thousands of partitions a plain ``orderBy.limit`` would send n whole rows
per partition to one task.  So the hashes are first counted by their number of
leading zero bits: at most 61 groups, combined before the shuffle, from the key
columns alone.  The largest number of zeros that still leaves n rows is an exact
prefilter, which keeps about n to 2n rows of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_hash(seed: int, *keys: Column) -> Column:
    parts = [F.lit(f"{seed}:")]
    for i, k in enumerate(keys):
        if i:
            parts.append(F.lit(","))
        parts.append(k.cast("string"))
    return F.md5(F.concat(*parts))


def _zeros(h: Column) -> Column:
    """Leading zero bits among the first 60 bits of the hash."""
    return F.lit(60) - F.length(F.conv(F.substring(h, 1, 15), 16, 2))


def _cutoffs(hashed: DataFrame, n: int, by: list[str]) -> DataFrame:
    """(by..., _cut): most leading zeros that at least n rows (or all) reach."""
    counts = hashed.groupBy(*by, "_z").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    reached = F.sum("_c").over(group.orderBy(F.desc("_z")))
    total = F.sum("_c").over(group)
    enough = counts.withColumn("_ok", reached >= F.least(F.lit(n), total)).where("_ok")
    return enough.groupBy(*by).agg(F.max("_z").alias("_cut"))


def seeded_sample(df: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """The n rows with the smallest hash, exactly."""
    h = order_hash(seed, *[F.col(k) for k in keys])
    cut = _cutoffs(df.select(_zeros(h).alias("_z")), n, []).select("_cut").scalar()
    return df.withColumn("_h", h).where(_zeros(F.col("_h")) >= cut).orderBy("_h", *keys).limit(n).drop("_h")


def sample_per_column(long: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """Seeded sample of n rows for every value of ``column``.

    ``long`` has ``column``, the keys and ``value``, nulls already removed.  The
    cutoffs have one row per table column, so they are broadcast.
    """
    h = order_hash(seed, *[F.col(k) for k in keys])
    cuts = _cutoffs(long.select("column", _zeros(h).alias("_z")), n, ["column"])
    ranked = Window.partitionBy("column").orderBy("_h", *keys)
    return (
        long.withColumn("_h", h)
        .join(F.broadcast(cuts), "column")
        .where(_zeros(F.col("_h")) >= F.col("_cut"))
        .withColumn("_r", F.row_number().over(ranked))
        .where(F.col("_r") <= n)
        .drop("_h", "_cut", "_r")
    )
