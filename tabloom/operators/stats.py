"""Pairwise statistics.  Every function handles a list of pairs in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions import text as tx
from tabloom.functions.special import p_value_udf
from tabloom.operators.ranking import BROADCAST_ROWS, lookup, number, ordered_counts, present, quoted_col
from tabloom.session import written
from tabloom.settings import DEFAULTS, Settings

Pair = tuple[str, str]


def _rows(row_df: DataFrame, pairs: list[Pair], fields: dict) -> DataFrame:
    """One-row aggregate with columns <field><i> to one row per pair."""
    items = [
        F.struct(
            F.lit(i).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"),
            *[F.col(f"{f}{i}").cast(t).alias(f) for f, t in fields.items()],
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return row_df.select(F.inline(F.array(*items)))


def _correlation(x, y):
    """Null where either side is constant.

    Constancy is read from minimum and maximum: a merged variance of equal
    values can differ from zero by rounding.
    """
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def pair_counts(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """(pair, a, b, n): rows where both are present; all pairs in one pass."""
    both = lambda a, b: F.count(F.when(present(df, a) & present(df, b), 1))
    return _rows(df.agg(*[both(a, b).alias(f"n{i}") for i, (a, b) in enumerate(pairs)]), pairs, {"n": "long"})


def pearson(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """(pair, a, b, n, r, p_value); r and p are null where either side is constant."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = number(quoted_col(a)), number(quoted_col(b))
        ok = x.isNotNull() & y.isNotNull()
        x, y = F.when(ok, x), F.when(ok, y)
        aggs += [F.count(x).alias(f"n{i}"), _correlation(x, y).alias(f"r{i}")]
    rows = _rows(df.agg(*aggs), pairs, {"n": "long", "r": "double"})
    return rows.withColumn("p_value", p_value_udf(F.lit("r"), "r", (F.col("n") - 2).cast("double"), F.lit(None).cast("double")))


@dataclass(frozen=True)
class Measured:
    """What one pass over a table found for pairs of all test families."""

    base: DataFrame                # the ranked columns as c0, c1, ...
    slots: list[tuple[str, frozenset]]  # a ranked column, and the columns that must be present beside it
    rank_pairs: list[tuple[int, int]]   # slots of each pair of numbers
    cells: DataFrame               # written: (set, x, y, v, n, mean, var, lo, hi)
    n_groups: int
    n_tables: int

    def of(self, family: str) -> DataFrame:
        """Cells of a family with ``pair`` from 0."""
        first = len(self.slots) + (0 if family == "groups" else self.n_groups)
        size = self.n_groups if family == "groups" else self.n_tables
        return self.cells.where(F.col("set").between(first, first + size - 1)).withColumn("pair", F.col("set") - first)


def measure(df: DataFrame, ranks: list[Pair] = (), groups: list[Pair] = (), tables: list[Pair] = (),
            complete: set[str] | None = None, missing: str = DEFAULTS.missing_class) -> Measured:
    """One pass for numbers against numbers, numbers against classes, and classes against classes.

    Every row becomes one cell for each ranked column, (number, class) pair and cross table; cells are counted, with
    moments of the number, by a single aggregation over their sets, as by grouping sets.  The result is written: all
    statistics follow from it, so further scans of the table are needed only to bring ranks back to rows.

    Columns without missing values share one ranking.  A column that is paired with one that has some is ranked again for each such set
    of columns.  ``complete``: columns known to have none; unless given, one more scan finds out.
    """
    columns = list(dict.fromkeys(c for p in ranks for c in p))
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    base = df.select(*[number(quoted_col(c)).alias(a) for c, a in at.items()])
    if complete is None and columns:
        row = base.agg(F.count(F.lit(1)).alias("rows"), *[F.count(a).alias(a) for a in at.values()]).first()
        complete = {c for c, a in at.items() if row[a] == row["rows"]}
    slots: dict[tuple[str, frozenset], int] = {}
    pairs = []
    for a, b in ranks:
        holes = frozenset(at[c] for c in (a, b) if c not in complete)
        pairs.append(tuple(slots.setdefault((at[c], holes), len(slots)) for c in (a, b)))
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def cell(i, x=no_text, y=no_text, v=none, m=none):
        return F.struct(F.lit(i).alias("set"), x.alias("x"), y.alias("y"), v.alias("v"), m.alias("m"))

    shown = lambda c: tx.value_key(quoted_col(c).cast("string"))
    level = lambda c: tx.value_key(F.coalesce(quoted_col(c).cast("string"), F.lit(missing)))
    value = lambda slot: _masked(number(quoted_col(columns[int(slot[0][1:])])), [number(quoted_col(columns[int(h[1:])])) for h in slot[1]])
    items = [cell(i, v=value(s)) for s, i in slots.items()]
    items += [cell(len(slots) + i, x=shown(g), m=number(quoted_col(y))) for i, (y, g) in enumerate(groups)]
    # y is the second level; whether both are present is kept with the cell, as a number
    items += [cell(len(slots) + len(groups) + i, level(a), level(b), v=(present(df, a) & present(df, b)).cast("double")) for i, (a, b) in enumerate(tables)]
    first_table = len(slots) + len(groups)
    useful = ((F.col("set") >= first_table) | ((F.col("set") < len(slots)) & F.col("v").isNotNull())
              | ((F.col("set") >= len(slots)) & F.col("x").isNotNull() & F.col("m").isNotNull()))
    counted = df.select(F.inline(F.array(*items))).where(useful).groupBy("set", "x", "y", "v").agg(
        F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"), F.var_pop("m").alias("var"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    return Measured(base, list(slots), pairs, written(counted, "cells"), len(groups), len(tables))


def _masked(x: Column, others: list[Column]) -> Column:
    """The value where all others are present."""
    for o in others:
        x = F.when(o.isNotNull(), x)
    return x


def spearman(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """(pair, a, b, n, r): rank correlation with average ranks over complete pairs; one shuffle of counts for all columns."""
    return spearman_of(measure(df, ranks=pairs), pairs)


def spearman_of(found: Measured, pairs: list[Pair]) -> DataFrame:
    ranked = _with_ranks(found)
    aggs, items = [], []
    for i, ((a, b), (sa, sb)) in enumerate(zip(pairs, found.rank_pairs, strict=True)):
        x, y = F.col(f"rank{sa}"), F.col(f"rank{sb}")
        aggs += [F.count(F.when(y.isNotNull(), x)).alias(f"n{i}"), _correlation(x, y).alias(f"r{i}")]
        items.append(F.struct(F.lit(i).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")))
    return ranked.agg(*aggs).select(F.inline(F.array(*items)))


def rank_table(found: Measured) -> tuple[DataFrame, dict[int, int]]:
    """Written (set, v, n, rank) with average ranks, and the number of values of each slot.

    Values of all slots are ordered together: ranges over (slot, value), then sums of the ranges before.
    """
    counts = found.cells.where(F.col("set") < len(found.slots)).select("set", "v", "n")
    sizes = {r["set"]: r["count"] for r in counts.groupBy("set").count().collect()}
    if max(sizes.values(), default=0) <= BROADCAST_ROWS:
        below = Window.partitionBy("set").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
    else:
        ranged = written(counts.repartitionByRange("set", "v").withColumn("_bucket", F.spark_partition_id()), "ranged")
        placed = ordered_counts(ranged, "v", ["set"])
    return written(placed.select("set", "v", "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank")), "ranks"), sizes


def _with_ranks(found: Measured) -> DataFrame:
    """One row per row of the table with a column ``rank<slot>`` for every slot.

    Slots of up to ``BROADCAST_ROWS`` values get their ranks by broadcasts.  One other slot is looked up from the rows; the
    cells of several go through one lookup together and come back to their rows by one shuffle, with the ranks that the row
    already has.
    """
    ranks, sizes = rank_table(found)
    small = [i for i in range(len(found.slots)) if sizes.get(i, 0) <= BROADCAST_ROWS]
    large = [i for i in range(len(found.slots)) if i not in small]
    rows = found.base.withColumns({f"v{i}": _masked(F.col(c), [F.col(h) for h in holes]) for i, (c, holes) in enumerate(found.slots)})
    for i in small:
        table = ranks.where(F.col("set") == i).select(F.col("v").alias(f"_v{i}"), F.col("rank").alias(f"rank{i}"))
        rows = rows.join(F.broadcast(table), F.col(f"v{i}") == F.col(f"_v{i}"), "left")
    if not large:
        return rows.select(*[f"rank{i}" for i in small])
    if len(large) == 1:  # nothing to bring together
        i = large[0]
        own = ranks.where(F.col("set") == i).select(F.col("v").alias(f"v{i}"), F.col("rank").alias(f"rank{i}"), "n")
        narrow = rows.select(*[f"rank{k}" for k in small], f"v{i}")
        return lookup(narrow, own, [f"v{i}"], [f"rank{i}"], own.agg(F.sum("n")).first()[0], sizes[i]).drop(f"v{i}")
    none = F.lit(None).cast("double")
    known = F.array(*[F.col(f"rank{i}") for i in small]).cast("array<double>")
    cells = [F.struct(F.lit(-1).alias("set"), none.alias("v"), known.alias("known"))]
    cells += [F.struct(F.lit(i).alias("set"), F.col(f"v{i}").alias("v"), F.lit(None).cast("array<double>").alias("known")) for i in large]
    long = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.inline(F.array(*cells)))
    values = ranks.where(F.col("set").isin(large))
    total = sum(sizes[i] for i in large)
    placed = lookup(long, values, ["set", "v"], ["rank"], values.agg(F.sum("n")).first()[0], total)
    return placed.groupBy("_row").agg(
        F.max("known").alias("_known"), *[F.max(F.when(F.col("set") == i, F.col("rank"))).alias(f"rank{i}") for i in large],
    ).select(*[F.col("_known")[k].alias(f"rank{i}") for k, i in enumerate(small)], *[f"rank{i}" for i in large])


def spearman_time_hour(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Numeric against the hour of a timestamp; fewer than ten hours gives null."""
    hours = {b: f"_hour{i}" for i, b in enumerate(dict.fromkeys(b for _, b in pairs))}
    with_hours = df.withColumns({h: F.hour(quoted_col(b)) for b, h in hours.items()})
    out = spearman(with_hours, [(a, hours[b]) for a, b in pairs])
    names = F.create_map(*[F.lit(x) for b, h in hours.items() for x in (h, b)])
    return out.withColumn("b", names[F.col("b")]).withColumn("r", F.when(F.col("n") >= 10, F.col("r")))


def anova(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """(pair, a, b, n, groups, effect, f, df1, df2, top_mean, bottom_mean) of (numeric, category) pairs."""
    return anova_of(measure(df, groups=pairs), pairs)


def anova_of(found: Measured, pairs: list[Pair]) -> DataFrame:
    """effect is eta squared.  Between-group squares are taken around the overall mean so that large offsets cancel before squaring."""
    g = found.of("groups").withColumn("var", F.when(F.col("lo") < F.col("hi"), F.col("var")).otherwise(F.lit(0.0)))
    n = F.col("n").cast("double")
    centre = g.groupBy("pair").agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("_centre"))
    d = F.col("mean") - F.col("_centre")
    # one row for each pair
    per_pair = g.join(F.broadcast(centre), "pair").groupBy("pair").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        (F.sum(n * d * d) - F.sum(n * d) * F.sum(n * d) / F.sum(n)).alias("_between"),
        F.sum(n * F.col("var")).alias("_within"),
        F.max("mean").alias("top_mean"),
        F.min("mean").alias("bottom_mean"),
        (F.min("lo") < F.max("hi")).alias("_varies"),
    )
    total = F.col("_between") + F.col("_within")
    usable = (F.col("n") >= 10) & (F.col("groups") >= 2)
    df1, df2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    left = F.create_map(*[x for i, (y, _) in enumerate(pairs) for x in (F.lit(i), F.lit(y))])
    right = F.create_map(*[x for i, (_, c) in enumerate(pairs) for x in (F.lit(i), F.lit(c))])
    ratio = (F.col("_between") / df1) / F.nullif(F.col("_within") / F.nullif(df2, F.lit(0)), F.lit(0.0))
    return per_pair.select(
        "pair", left[F.col("pair")].alias("a"), right[F.col("pair")].alias("b"), "n", "groups",
        F.when(usable, F.when(F.col("_varies"), F.col("_between") / total).otherwise(0.0)).alias("effect"),
        F.when(usable & (df2 > 0) & F.col("_varies"), F.when((F.col("_within") == 0) & (F.col("_between") > 0), F.lit(float("inf")))
               .otherwise(ratio)).alias("f"),
        df1.cast("double").alias("df1"), df2.cast("double").alias("df2"), "top_mean", "bottom_mean",
    )


def cramers_v(df: DataFrame, pairs: list[Pair], cfg: Settings = DEFAULTS) -> DataFrame:
    """(pair, a, b, n, complete, r_levels, c_levels, chi2, effect, dof); null is a level."""
    return cramers_of(measure(df, tables=pairs, missing=cfg.missing_class), pairs)


def cramers_of(found: Measured, pairs: list[Pair]) -> DataFrame:
    """chi2 = n * (sum(cell^2 / (row * column)) - 1) over the non-empty cells only, so a wide cross table is never
    materialised.  ``complete`` counts the rows where neither side is null."""
    cells = written(found.of("tables").groupBy("pair", "x", "y").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v").cast("long")).alias("both")), "cross-tables")
    margin = lambda side, out: cells.groupBy("pair", side).agg(F.sum("n").alias(out), F.count(F.lit(1)).alias("n"))
    size = cells.agg(F.count(F.lit(1)).alias("cells"), F.approx_count_distinct(F.struct("pair", "x")).alias("x"), F.approx_count_distinct(F.struct("pair", "y")).alias("y")).first()
    placed = lookup(cells, margin("x", "row"), ["pair", "x"], ["row"], size["cells"], size["x"])
    placed = lookup(placed, margin("y", "col"), ["pair", "y"], ["col"], size["cells"], size["y"])
    o = F.col("n").cast("double")
    share = F.sum(o * o / (F.col("row").cast("double") * F.col("col").cast("double")))
    # sum over the cells of cell/row counts each level once: exact level counts without a distinct
    per_pair = placed.groupBy("pair").agg(
        F.sum("n").alias("n"), F.sum("both").alias("complete"),
        F.round(F.sum(o / F.col("row").cast("double"))).cast("long").alias("r_levels"),
        F.round(F.sum(o / F.col("col").cast("double"))).cast("long").alias("c_levels"),
        share.alias("_share"),
    )
    n = F.col("n").cast("double")
    chi2 = F.greatest(n * (F.col("_share") - 1.0), F.lit(0.0))
    smaller = F.least("r_levels", "c_levels") - 1
    left = F.create_map(*[x for i, (a, _) in enumerate(pairs) for x in (F.lit(i), F.lit(a))])
    right = F.create_map(*[x for i, (_, b) in enumerate(pairs) for x in (F.lit(i), F.lit(b))])
    return per_pair.select(
        "pair", left[F.col("pair")].alias("a"), right[F.col("pair")].alias("b"), "n", "complete", "r_levels", "c_levels",
        chi2.alias("chi2"),
        F.sqrt(chi2 / F.when(smaller > 0, n * smaller).otherwise(F.lit(1.0))).alias("effect"),
        ((F.col("r_levels") - 1) * (F.col("c_levels") - 1)).cast("double").alias("dof"),
    )


def benjamini_hochberg(relations: DataFrame, p: str = "p_value", alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Adds ``adjusted_p_value`` and ``significant_fdr``.

    Rows are column pairs, so their number is set by the width of the table and
    one window over them is small.  A null p is left out of the correction.
    """
    tested = F.col(p).isNotNull()
    everyone = Window.partitionBy(tested)
    ascending = everyone.orderBy(p)
    ties_in = everyone.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = relations.withColumns({
        "_m": F.count(F.lit(1)).over(everyone),
        "_rank": F.rank().over(ascending) + F.count(F.lit(1)).over(Window.partitionBy(tested, p)) - 1,
    })
    adjusted = F.least(F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(ties_in), F.lit(1.0))
    return (
        ranked.withColumn("adjusted_p_value", F.when(tested, adjusted))
        .withColumn("significant_fdr", F.coalesce(F.col("adjusted_p_value") <= alpha, F.lit(False)))
        .drop("_m", "_rank")
    )
