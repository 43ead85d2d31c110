"""Exact order statistics by radix descent, for all columns and groups at once.

A value's place in the order is a whole number (``image``).  A pass counts the rows of each wanted interval by the next
digit of their images, and the wanted rank says in which digit to go on.  What is shuffled is one row per task, interval
and digit, so it does not depend on the number of distinct values; what is kept between passes is one row per group and rank.
An interval shrinks to the least and greatest image that it holds, so few distinct values end after one or two passes; the
64 bits of an image bound the passes at seven.  Every pass scans the rows once and is written, so a lost executor
repeats one pass at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.operators.ranking import lookup, number, quoted_col
from tabloom.session import written

DIGIT_BITS = 10
FEW_ROWS = 200_000  # so many rows are ordered by one window


def with_image(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the image of a double column without nulls and NaN: 0 for both zeros, mirrored for negative numbers, infinite ones last.

    Exponent and fraction, as the format has them.  Powers of two are exact, and the rounding of the logarithm is put
    right afterwards.  Every step is a column of its own, since the next ones refer to it several times.
    """
    size = F.abs(value)
    half = F.shiftright(-F.col("_e"), 1)  # in two steps, as one power might not be finite
    steps = df.withColumn("_e", F.floor(F.least(F.greatest(F.log2(size), F.lit(-1022.0)), F.lit(1023.0))).cast("int"))
    steps = steps.withColumn("_f", size * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -F.col("_e") - half))
    steps = steps.withColumn("_k", F.when(F.col("_f") >= 2, 1).when((F.col("_f") < 1) & (F.col("_e") > -1022), -1).otherwise(0))
    fraction = F.col("_f") * F.when(F.col("_k") == 1, 0.5).when(F.col("_k") == -1, 2.0).otherwise(1.0)
    # below the least exponent the fraction is less than one, which leaves the order as it is
    whole = (F.col("_e") + F.col("_k") + 1022).cast("long") * F.lit(1 << 52) + (fraction * float(1 << 52)).cast("long")
    found = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 << 52)).otherwise(whole)
    return steps.withColumn(out, F.when(F.col(value) < 0, -found).otherwise(found)).drop("_e", "_f", "_k")


def ends(rows: DataFrame, by: list[str], image: str, value: str) -> DataFrame:
    """(by..., lo, hi, value, n) of each group, written; one scan."""
    return written(rows.groupBy(*by).agg(
        F.min(image).alias("lo"), F.max(image).alias("hi"), F.min(value).alias("value"), F.count(F.lit(1)).alias("n")), "group-ends")


def selected(rows: DataFrame, by: list[str], image: str, value: str, ranks: DataFrame) -> DataFrame:
    """(by..., rank, n, image, value, left): the row of each wanted rank.

    ``rows`` has groups (not null), images and values; ``ranks`` has the columns of ``ends`` and ``rank``, ranks from 0 in the order of
    images.  ``left`` is the rank among the rows that share the image, ``value`` the least of their values.

    Once all open intervals hold no more than ``FEW_ROWS`` rows together, these are ordered as they are.
    """
    wanted = ranks.withColumns({"left": F.col("rank"), "inside": F.col("n")})
    while True:
        spans = wanted.where("lo < hi").groupBy(*by, "lo", "hi").agg(F.max("inside").alias("inside"), F.max("n").alias("n"))
        now = spans.agg(F.count(F.lit(1)).alias("spans"), F.sum("inside").alias("inside"), F.sum("n").alias("rows")).first()
        if not now["spans"]:
            return wanted.select(*by, "rank", "n", F.col("lo").alias("image"), "value", "left")
        few = now["inside"] <= FEW_ROWS
        narrowed = _narrowed(rows, by, image, value, wanted, now["spans"], now["rows"], few)
        if few:
            return narrowed.select(*by, "rank", "n", F.col("lo").alias("image"), "value", "left")
        wanted = written(narrowed, "selection")


def _digit(image: str) -> Column:
    """Digit of an image inside [lo, hi]: what stands above the lower bits, of which all images in there share the highest."""
    bits = F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi")))).cast("int")
    unsigned = F.col(image).bitwiseXOR(F.lit(-(1 << 63)))
    return F.call_function("shiftrightunsigned", unsigned, F.greatest(bits - DIGIT_BITS, F.lit(0)))


def _narrowed(rows: DataFrame, by: list[str], image: str, value: str, wanted: DataFrame, groups: int, size: int, whole: bool) -> DataFrame:
    """One pass: every open interval becomes the digit (``whole``: the image) that holds its rank."""
    open_ = wanted.where("lo < hi")
    # ranks of a group often share an interval; it is counted once
    spans = open_.groupBy(*by).agg(F.collect_set(F.struct("lo", "hi")).alias("_spans"), F.max("n").alias("n"))
    met = lookup(rows.select(*by, image, value), spans, by, ["_spans"], size, groups)
    inside = met.select(*by, image, value, F.explode(F.filter("_spans", lambda s: (s["lo"] <= F.col(image)) & (F.col(image) <= s["hi"]))).alias("_span"))
    cells = inside.select(*by, F.col("_span.lo").alias("lo"), F.col("_span.hi").alias("hi"), image, value)
    counted = cells.groupBy(*by, "lo", "hi", (F.col(image) if whole else _digit(image)).alias("_digit")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(image).alias("_lo"), F.max(image).alias("_hi"), F.min(value).alias("_value"))
    # at most 2 ** DIGIT_BITS rows, or FEW_ROWS
    below = Window.partitionBy(*by, "lo", "hi").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    found = open_.drop("value").join(placed, [*by, "lo", "hi"]).where((F.col("left") >= F.col("_before")) & (F.col("left") < F.col("_before") + F.col("_n")))
    went = found.select(
        *by, "rank", "n", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_value").alias("value"),
        (F.col("left") - F.col("_before")).alias("left"), F.col("_n").alias("inside"))
    return wanted.where("lo = hi").select(*went.columns).unionByName(went)


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., n, q0, q1, ...): exact quantiles with linear interpolation, one row per group (a single row without groups).

    Null and NaN values count as missing, rows with a null group are left out, and so are groups without a value.
    """
    by = by or []
    groups = [f"_g{i}" for i in range(len(by))] or ["_g"]
    x = number(quoted_col(value)) + F.lit(0.0)
    cells = df.select(*([quoted_col(b).alias(g) for b, g in zip(by, groups)] or [F.lit(0).alias("_g")]), x.alias("_v"))
    cells = with_image(cells.where(" AND ".join(f"{c} IS NOT NULL" for c in cells.columns)), "_v", "_image")
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    sides = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]))
    found = selected(cells, groups, "_image", "_v", ends(cells, groups, "_image", "_v").withColumn("rank", F.explode(sides)))
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("value")))
    out = []
    for i, p in enumerate(probs):
        low, high = at(F.floor(place(p))), at(F.ceil(place(p)))
        out.append((low + (high - low) * F.max(place(p) - F.floor(place(p)))).alias(f"q{i}"))
    result = found.groupBy(*groups).agg(F.max("n").alias("n"), *out)
    return result.withColumnsRenamed(dict(zip(groups, by))) if by else result.drop("_g")
