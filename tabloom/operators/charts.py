"""The aggregated data behind each chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import labels as lb
from tabloom.operators.ranking import lookup, number, quoted_col
from tabloom.operators.selection import quantiles
from tabloom.operators.sentiment import distribution
from tabloom.session import written
from tabloom.settings import DEFAULTS, Settings


def scatter_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, intercept, x_min, x_max) of the straight-line fit."""
    a, b = number(quoted_col(x)), number(quoted_col(y))
    both = df.where(a.isNotNull() & b.isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
        F.min(a).alias("x_min"), F.max(a).alias("x_max"),
    )


def scatter_points(df: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """(x_bin, y_bin, n, x, y): complete pairs counted in equal bins of both ranges, with the mean point of each bin.

    Every pair is in one bin, and there are ``bins`` * ``bins`` of them at most, however many rows there are.  A side
    without spread has one bin.
    """
    pairs = df.select(number(quoted_col(x)).alias("x"), number(quoted_col(y)).alias("y")).where("x is not null and y is not null")
    ends = pairs.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()

    def bin_of(side: str):
        low, high = ends[f"{side}0"], ends[f"{side}1"]
        if low is None or low == high:
            return F.lit(0)
        return F.least(F.floor((F.col(side) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")

    return pairs.groupBy(bin_of("x").alias("x_bin"), bin_of("y").alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def box_stats(df: DataFrame, value: str, category: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """(label, n, low_whisker, q1, median, q3, high_whisker) per category.

    Quartiles of all categories come from one radix descent and whiskers from one more scan; counts are combined before
    every shuffle, so a category holding a third of the rows is spread over many tasks.
    """
    rows = df.select(
        F.coalesce(quoted_col(category).cast("string"), F.lit(cfg.missing_class)).alias("cat"),
        number(quoted_col(value)).alias("v"),
    ).where("v is not null")
    quarts = written(quantiles(rows, "v", [0.25, 0.5, 0.75], ["cat"]), "quartiles")
    sizes = quarts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("cats")).first()
    placed = lookup(rows, quarts, ["cat"], ["q0", "q1", "q2"], sizes["rows"] or 0, sizes["cats"])
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    whisker = F.when((F.col("v") >= F.col("q0") - reach) & (F.col("v") <= F.col("q2") + reach), F.col("v"))
    return placed.groupBy("cat").agg(
        F.count(F.lit(1)).alias("n"),
        # a whisker never ends inside the box
        F.least(F.min(whisker), F.min("q0")).alias("low_whisker"),
        F.min("q0").alias("q1"), F.min("q1").alias("median"), F.min("q2").alias("q3"),
        F.greatest(F.max(whisker), F.max("q2")).alias("high_whisker"),
    ).withColumn("label", F.substring("cat", 1, 30)).drop("cat")


def crosstab_heatmap(df: DataFrame, a: str, b: str, limit: int = 30, cfg: Settings = DEFAULTS) -> DataFrame:
    """(a, b, n): non-empty cells of the first 30 sorted levels of each side."""
    level = lambda c: F.coalesce(quoted_col(c).cast("string"), F.lit(cfg.missing_class))
    rows = df.select(level(a).alias("a"), level(b).alias("b"))
    firsts = lambda side: rows.select(side).distinct().orderBy(side).limit(limit)
    return (
        rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(firsts("a")), "a", "left_semi")  # at most 30 rows each
        .join(F.broadcast(firsts("b")), "b", "left_semi")
    )


def daily_mean(df: DataFrame, ts: str, value: str) -> DataFrame:
    """(day, mean) for every day between the first and the last; gaps are null."""
    rows = df.where(quoted_col(ts).isNotNull() & number(quoted_col(value)).isNotNull())
    daily = rows.groupBy(F.to_date(quoted_col(ts)).alias("day")).agg(F.avg(quoted_col(value).cast("double")).alias("mean"))
    span = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(daily, "day", "left")


def shares(df: DataFrame, column: str) -> DataFrame:
    """(label, n, pct) of a pie chart."""
    return distribution(df, column).select(
        lb.display_label(F.col("label")).alias("label"), "n", (F.col("share") * 100.0).alias("pct")
    )
