"""Running totals and lookups that stay spread over the cluster.

``Window.orderBy(x)`` without a partition sorts a whole table in one task.  It is replaced here by counts per distinct
value, cut into value ranges ("buckets"): each bucket is ordered on its own and bucket totals supply the offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabloom.functions import text as tx

BROADCAST_ROWS = 200_000  # (value, number) rows small enough to send everywhere
HOT_SHARE = 1000          # a key with over 1/1000 of all rows is hot: at most 1000 keys


def number(c: Column) -> Column:
    """As double; NaN counts as missing."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def present(df: DataFrame, name: str) -> Column:
    """Neither null nor NaN."""
    c = quoted_col(name)
    return c.isNotNull() & ~F.isnan(c) if isinstance(df.schema[name].dataType, T.FractionalType) and not isinstance(df.schema[name].dataType, T.DecimalType) else c.isNotNull()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted_col(name: str) -> Column:
    """``F.col`` for any name: dots, brackets and blanks included."""
    return F.col(_quoted(name))


def ordered_counts(counted: DataFrame, value: str, by: list[str] | None = None, n: str = "n") -> DataFrame:
    """Adds ``before``, how many rows of the group have a smaller value, and
    ``total``, the size of the group.

    ``counted`` has one row per (group, value) with its count ``n`` and a
    ``_bucket`` that grows with the value.  A bucket is ordered by a window over
    (group, bucket); offsets are a running total over at most one row per bucket
    and group.
    """
    by = by or []
    keys = [*by, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.groupBy(*keys).agg(F.sum(n).alias("_t"))
        .withColumn("_offset", F.coalesce(F.sum("_t").over(over), F.lit(0)))
        .withColumn("total", F.sum("_t").over(Window.partitionBy(*(by or [F.lit(0)]))))
        .drop("_t")
    )
    local = counted.withColumn("_before", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return (
        local.join(offsets, keys)
        .withColumn("before", F.col("_offset") + F.col("_before"))
        .drop("_offset", "_before", "_bucket")
    )


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], take: list[str],
           total_rows: int, distinct: int | None, weight: str = "n") -> DataFrame:
    """Left join of a key table, safe against hot keys.

    ``table`` has one row per key with the number of rows it matches in
    ``weight``.  Up to ``BROADCAST_ROWS`` keys the table is broadcast.  Beyond
    that, keys with more than 1/1000 of the rows (so at most 1000 of them) are
    broadcast and the rest is joined by shuffle; rows already answered and rows
    with a null key get a null key and a salt, so no task receives a whole hot
    group.  Strings are compared by ``value_key``, so that a key has 66
    characters at most and what is broadcast has a bounded size.
    """
    short = {k: f"_short{i}" for i, k in enumerate(keys)}
    shortened = lambda df: {s: tx.value_key(quoted_col(k)) if isinstance(df.schema[k].dataType, T.StringType) else quoted_col(k)
                            for k, s in short.items()}
    columns = rows.columns
    rows = rows.withColumns(shortened(rows))
    table = table.withColumns(shortened(table)).select(*short.values(), *take, weight)
    keys = list(short.values())
    if distinct is not None and distinct <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(weight)), keys, "left").select(*[quoted_col(c) for c in columns], *take)
    limit = max(1, total_rows // HOT_SHARE)
    hot = table.where(F.col(weight) > limit).drop(weight)
    cold = table.where(F.col(weight) <= limit).withColumnRenamed(weight, "_weight")
    hot = hot.withColumn("_hit", F.lit(True)).withColumnsRenamed({t: f"_hot_{t}" for t in take})
    marked = rows.join(F.broadcast(hot), keys, "left")
    spread = F.pmod(F.xxhash64(*[quoted_col(c) for c in columns]), F.lit(4096))
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    marked = marked.withColumn("_salt", F.when(F.coalesce(F.col("_hit"), null_key), spread).otherwise(F.lit(0)))
    # always 0, but not a literal: that would be folded out of the join keys
    cold = cold.withColumn("_salt", F.least(F.col("_weight"), F.lit(0)).cast("long")).drop("_weight").withColumnsRenamed(
        {**{k: f"_k{i}" for i, k in enumerate(keys)}, **{t: f"_cold_{t}" for t in take}}
    )
    for i, k in enumerate(keys):
        marked = marked.withColumn(f"_m{i}", F.when(F.col("_hit").isNull(), quoted_col(k)))
    on = marked["_salt"] == cold["_salt"]
    for i in range(len(keys)):
        on = on & (marked[f"_m{i}"] == cold[f"_k{i}"])
    joined = marked.join(cold, on, "left")
    return joined.select(
        *[quoted_col(c) for c in columns],
        *[F.coalesce(f"_hot_{t}", f"_cold_{t}").alias(t) for t in take],
    )
