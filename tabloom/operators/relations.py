"""Relations between original columns: pairs, tests, ranking, selection, wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions import text as tx
from tabloom.functions.special import p_value_udf
from tabloom.operators import stats
from tabloom.operators.facts import physical_classes
from tabloom.operators.ranking import number, present, quoted_col
from tabloom.settings import DEFAULTS, Settings

NUMERIC_SUFFIXES = ("_num", "_z", "_confidence", "_freq", "_encoded")
# Why a test has no result.
FAILURES = {
    "spearman": "constant_or_error", "spearman_time_hour": "constant_or_error", "anova_eta2": "anova_failed_or_insufficient",
    "cramers_v": "chi2_failed_or_insufficient",
}
CATEGORY_LEVELS = 50
HOUR_FIRST = ("_hour", "_day", "_month", "_year")

# -------------------------------------------------------------------- planning


def type_facts(df: DataFrame, columns: list[str] | None = None) -> list[dict]:
    """Decision action: column, kind, constancy, sample deviation and completeness of each column.

    One scan.  A string column's exact number of values matters only near the limit of a category: a sketch decides the
    others, and only where it is near the limit, or a column may be constant, a second scan counts exactly.
    """
    columns = columns or df.columns
    kinds = physical_classes(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x = quoted_col(c)
        if kinds[c] == "string":
            x = x.cast("string")
            shown = F.when(x.isNotNull(), F.xxhash64(x))
            aggs += [F.approx_count_distinct(x).alias(f"d{i}"), F.avg(F.when(x.rlike(r"\s"), tx.word_count(x)).otherwise((x != "").cast("int"))).alias(f"w{i}")]
        else:
            shown = x
        if kinds[c] == "numeric":
            aggs.append(F.stddev_samp(number(x)).alias(f"s{i}"))
        aggs += [F.count(x).alias(f"n{i}"), F.count(F.when(present(df, c), 1)).alias(f"p{i}"), F.min(shown).alias(f"lo{i}"), F.max(shown).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    short = {c: (row[f"w{i}"] or 0.0) < 3 for i, c in enumerate(columns) if kinds[c] == "string"}
    single = {c for i, c in enumerate(columns) if row[f"lo{i}"] == row[f"hi{i}"]}
    levels = {c: row[f"d{i}"] for i, c in enumerate(columns) if kinds[c] == "string"}
    close = [c for c in levels if c in single or (short[c] and CATEGORY_LEVELS / 2 < levels[c] < 2 * CATEGORY_LEVELS)]
    if close:
        exact = df.agg(*[F.count_distinct(quoted_col(c)).alias(f"d{i}") for i, c in enumerate(close)]).first()
        levels |= {c: exact[f"d{i}"] for i, c in enumerate(close)}
    out = []
    for i, c in enumerate(columns):
        non_null, holes = row[f"n{i}"], row[f"n{i}"] < row["rows"]
        if kinds[c] != "string":
            kind = "datetime" if kinds[c] == "datetime" else "numeric"
        else:
            kind = "categorical" if non_null == 0 or (short[c] and levels[c] <= CATEGORY_LEVELS) else "text"
        one = c in single and (kinds[c] != "string" or levels[c] <= 1)
        out.append({
            "column": c, "kind": kind, "constant": non_null == 0 or (one and not holes),
            "std": row[f"s{i}"] if kinds[c] == "numeric" else None, "complete": row[f"p{i}"] == row["rows"],
        })
    return out


def parent_map(links: list[tuple[str, str, int]], existing: list[dict] = ()) -> dict[str, str]:
    out = {derived: parent for parent, derived, _ in links}
    for e in existing:
        if e.get("numeric_version"):
            out.setdefault(e["numeric_version"], e["column"])
            out.setdefault(e["column"] + "_sentiment", e["column"])
    return out


def representative(parent: str, columns: list[str], kinds: dict[str, str], derived: dict[str, list[str]],
                   hour_first: bool = False) -> str:
    """The column that stands for a parent in every test."""
    present = set(columns)
    if f"{parent}_sentiment_num" in present:
        return f"{parent}_sentiment_num"
    by_clock = [f"{parent}{s}" for s in HOUR_FIRST if kinds.get(f"{parent}{s}") == "numeric"]
    if hour_first and by_clock:
        return by_clock[0]
    for d in derived.get(parent, []):
        if d in present and (kinds.get(d) == "numeric" or d.endswith(NUMERIC_SUFFIXES)):
            return d
    if by_clock:
        return by_clock[0]
    if parent in present:
        return parent
    return next((d for d in derived.get(parent, []) if d in present), parent)


def representatives(columns: list[str], kinds: dict[str, str], links, existing=(), hour_first=False) -> dict[str, str]:
    """Parent -> representative, parents in name order."""
    parents_of = parent_map(links, existing)
    derived: dict[str, list[str]] = {}
    for parent, d, _ in sorted(links, key=lambda x: x[2]):
        derived.setdefault(parent, []).append(d)
    parents = sorted({parents_of.get(c, c) for c in columns})
    return {p: representative(p, columns, kinds, derived, hour_first) for p in parents}


def plan_pairs(df: DataFrame, reps: dict[str, str], facts: list[dict], primary: str | None, secondary: list[str],
               profiled_numeric: set[str], cfg: Settings = DEFAULTS) -> list[tuple[str, str, str, str]]:
    """(parent_a, parent_b, feature_a, feature_b) to test, each parent pair once."""
    constant = {f["column"] for f in facts if f["constant"]}
    kinds = {f["column"]: f["kind"] for f in facts}
    stds = {f["column"]: f["std"] for f in facts}
    there = set(df.columns)
    out, seen = [], set()

    def add(a, b):
        key = frozenset((a, b))
        ra, rb = reps[a], reps[b]
        if a == b or key in seen or ra == rb or not {ra, rb} <= there or {ra, rb} & constant:
            return
        seen.add(key)
        out.append((a, b, ra, rb))

    for target in [primary, *secondary]:
        if target in reps:
            for p in reps:
                if p != target and not (target != primary and p == primary):
                    add(target, p)
    spread = {p: stds.get(reps[p]) for p in reps if p in profiled_numeric and kinds.get(reps[p]) == "numeric"}
    ranked = sorted((p for p, v in spread.items() if v is not None), key=lambda p: (-round(spread[p], 9), p))
    top = ranked[: cfg.top_numeric]
    for i, a in enumerate(top):
        for b in top[i + 1:]:
            add(a, b)
    return out


# ------------------------------------------------------------------- computing


def _family(kind_a: str, kind_b: str) -> str:
    kinds = {kind_a, kind_b}
    if kinds == {"numeric"}:
        return "spearman"
    if "numeric" in kinds:
        return "spearman_time_hour" if "datetime" in kinds else "anova_eta2"
    return "cramers_v"


def compute(df: DataFrame, pairs, kinds: dict[str, str], cfg: Settings = DEFAULTS, facts: list[dict] | None = None) -> DataFrame:
    """One row per pair: method, effect, p, n, direction, notes.

    All families share one pass over the table (``stats.measure``), hours are ranked together with numbers, and one more
    pass brings the ranks to the rows.  ``facts`` as from ``type_facts`` save the scan for missing values.
    """
    families: dict[str, list[tuple[int, str, str]]] = {}
    for i, (_, _, ra, rb) in enumerate(pairs):
        family = _family(kinds[ra], kinds[rb])
        first, second = (ra, rb)
        if family in ("anova_eta2", "spearman_time_hour") and kinds[ra] != "numeric":
            first, second = rb, ra
        families.setdefault(family, []).append((i, first, second))
    numbers, clocks = families.get("spearman", []), families.get("spearman_time_hour", [])
    groups, tables = families.get("anova_eta2", []), families.get("cramers_v", [])
    hours = {b: f"_hour{i}" for i, b in enumerate(dict.fromkeys(b for _, _, b in clocks))}
    table = df.withColumns({h: F.hour(quoted_col(b)) for b, h in hours.items()})
    complete = None
    if facts is not None:
        complete = {f["column"] for f in facts if f["complete"]}
        complete |= {h for b, h in hours.items() if b in complete}
    rank_pairs = [*[(a, b) for _, a, b in numbers], *[(a, hours[b]) for _, a, b in clocks]]
    two = lambda items: [(a, b) for _, a, b in items]
    found = stats.measure(table, rank_pairs, two(groups), two(tables), complete, cfg.missing_class)

    def seq(items):
        m = F.create_map(*[F.lit(x) for j, (i, _, _) in enumerate(items) for x in (j, i)])
        return m[F.col("pair")].alias("seq")

    none = F.lit(None).cast("double")
    parts = []
    if rank_pairs:
        sign = F.when(F.col("r") > 0, "positive").otherwise("negative")
        method = F.when(F.col("pair") < len(numbers), "spearman").otherwise("spearman_time_hour")
        parts.append(stats.spearman_of(found, rank_pairs).select(
            seq([*numbers, *clocks]), "n", method.alias("method"), F.col("r").alias("effect_size"), F.lit("r").alias("test"), F.col("r").alias("statistic"),
            (F.col("n") - 2).cast("double").alias("df1"), none.alias("df2"), sign.alias("direction"),
        ))
    if groups:
        up = F.when(F.col("top_mean") > F.col("bottom_mean"), "positive").otherwise("negative")
        parts.append(stats.anova_of(found, two(groups)).select(
            seq(groups), "n", F.lit("anova_eta2").alias("method"), F.col("effect").alias("effect_size"),
            F.lit("f").alias("test"), F.col("f").alias("statistic"), "df1", "df2",
            F.when(F.col("groups") >= 2, up).alias("direction"),
        ))
    if tables:
        parts.append(stats.cramers_of(found, two(tables)).select(
            seq(tables), F.col("complete").alias("n"), F.lit("cramers_v").alias("method"), F.col("effect").alias("effect_size"),
            F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), F.col("dof").alias("df1"),
            none.alias("df2"), F.lit(None).cast("string").alias("direction"),
        ))
    tested = reduce(DataFrame.unionByName, parts)
    names = df.sparkSession.createDataFrame(
        [(i, *p) for i, p in enumerate(pairs)], "seq int, parent_a string, parent_b string, feature_a string, feature_b string"
    )
    # one row per column pair; a pair without any complete row has none
    joined = names.join(F.broadcast(tested), "seq", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    enough = F.col("n") >= 10
    cause = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    failed = F.when(~enough, "too_few_samples").when(F.col("effect_size").isNull(), F.coalesce(cause[F.col("method")], F.lit("fallback_failed")))
    keep = lambda c: F.when(enough & F.col("effect_size").isNotNull(), F.col(c)).alias(c)
    return joined.withColumn("p_value", p_value_udf("test", "statistic", "df1", "df2")).select(
        "seq", "parent_a", "parent_b", "feature_a", "feature_b", keep("method"), keep("effect_size"), keep("p_value"),
        "n", keep("direction"), failed.alias("notes"),
    )


# --------------------------------------------------------------------- ranking


def _touches(targets) -> Column:
    targets = [t for t in targets if t]
    return F.col("parent_a").isin(targets) | F.col("parent_b").isin(targets) if targets else F.lit(False)


def score(p: Column) -> Column:
    kept = F.lit(1.0) - F.least(F.coalesce(p, F.lit(1.0)), F.lit(1.0))
    return F.abs("effect_size") * (F.lit(1) + F.col("priority_weight")) * kept


def rank(relations: DataFrame, primary: str | None, secondary: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """Weight, best relation per parent pair, FDR and rank score.

    The input has one row per tested column pair, so its windows are small.
    """
    usable = relations.where("notes is null and effect_size is not null")
    weight = F.when(_touches([primary]), 3).otherwise(0) + F.when(_touches(secondary), 2).otherwise(0)
    weighted = usable.withColumn("priority_weight", weight).withColumn("score", score(F.col("p_value")))
    same = Window.partitionBy(F.least("parent_a", "parent_b"), F.greatest("parent_a", "parent_b"))
    best = (
        weighted.withColumn("_r", F.row_number().over(same.orderBy(F.desc("score"), "seq")))
        .where("_r = 1").drop("_r")
    )
    corrected = stats.benjamini_hochberg(best, "p_value", cfg.alpha)
    return corrected.withColumn("rank_score", score(F.col("adjusted_p_value")))


def min_points(n_rows: int) -> int:
    return max(10, int(n_rows * 0.1)) if n_rows < 100 else 50


def quality(ranked: DataFrame, n_rows: int, cfg: Settings = DEFAULTS) -> DataFrame:
    return ranked.where(
        (F.col("n") >= min_points(n_rows)) & F.col("significant_fdr") & (F.abs("effect_size") >= cfg.min_effect)
    )


def relation_cap(primary: str | None, secondary: list[str]) -> int:
    """Most relations to report: 2 with a primary target only, 4 with secondary
    ones, 1 without targets."""
    if not primary:
        return 1
    return 4 if secondary else 2


def select(qualified: DataFrame, primary: str | None, secondary: list[str]) -> list[dict]:
    """Greedy pick by rank score; a pair whose parents are both used is skipped.

    The rows are column pairs, so collecting them is bounded by the table width.
    """
    rows = [r.asDict() for r in qualified.orderBy(F.desc("rank_score"), "seq").collect()]
    cap, used, out = relation_cap(primary, secondary), set(), []
    for r in rows:
        pair = {r["parent_a"], r["parent_b"]}
        if len(out) == cap:
            break
        if pair <= used:
            continue
        out.append(r)
        used |= pair
    return out


# --------------------------------------------------------------------- wording


def strength(effect: Column) -> Column:
    size = F.abs(effect)
    return F.when(effect.isNull(), "no-result").when(size > 0.3, "strong").when(size > 0.1, "moderate").otherwise("weak")


def three_digits(c: Column) -> Column:
    """Shortest text with three significant digits (``%.3g``)."""
    size = F.abs(c)
    e = F.floor(F.log10(size))
    scale = F.pow(F.lit(10.0), F.lit(2) - e)
    carried = F.round(size * scale) >= 1000
    e = F.when(carried, e + 1).otherwise(e)
    scale = F.pow(F.lit(10.0), F.lit(2) - e)
    trim = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    mantissa = trim(F.format_string("%.2f", F.round(size * scale) / 100.0))
    power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    short = F.concat(mantissa, F.lit("e"), F.when(F.abs(e) > 99, F.concat(F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))).otherwise(power))
    plain = trim((F.round(size * scale) / scale).cast("decimal(30,10)").cast("string"))
    body = F.when(c == 0, "0").when((e < -4) | (e >= 3), short).otherwise(plain)
    return F.when(c.isNull(), "nan").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), body))


def sentences(relations: DataFrame) -> DataFrame:
    """Adds ``short``, ``long`` and ``action``.  For an ANOVA the direction has
    no sign: it only says that group means differ."""
    a, b = tx.prettify(F.col("parent_a")), tx.prettify(F.col("parent_b"))
    how = strength(F.col("effect_size"))
    verb = (
        F.when(F.col("direction") == "positive", "increases with")
        .when(F.col("direction") == "negative", "decreases with").otherwise("is associated with")
    )
    e, p = F.col("effect_size"), three_digits(F.col("p_value"))
    found = e.isNotNull()
    named = relations.withColumns({"_a": a, "_b": b, "_s": how, "_v": verb, "_p": p})
    short = F.format_string("%s %s %s (%s, %s, effect=%.2f, p=%s).", "_a", "_v", "_b", "_s", "method", e, "_p")
    long = F.format_string(
        "A %s relationship was found between %s and %s using %s (effect=%.3f, p=%s, n=%d). "
        "This indicates that %s %s %s.", "_s", "_a", "_b", "method", e, "_p", "n", "_a", "_v", "_b")
    action = (
        F.when(~found, "")
        .when(F.col("_s") == "strong", F.format_string(
            "Consider prioritizing %s and %s for interventions or further testing.", "_a", "_b"))
        .when(F.col("_s") == "moderate", F.format_string(
            "Investigate %s vs %s further — they show a moderate relationship.", "_a", "_b"))
        .otherwise("Relationship weak — likely not a primary driver.")
    )
    return named.withColumns({
        "short": F.when(found, short).otherwise(
            F.format_string("No clear relation found between %s and %s.", "_a", "_b")),
        "long": F.when(found, long).otherwise(
            F.format_string("No statistically meaningful relation was detected between %s and %s.", "_a", "_b")),
        "action": action,
    }).drop("_a", "_b", "_s", "_v", "_p")


def summary_lines(relations: DataFrame) -> DataFrame:
    """(ord, line) of the selected relations, best first; at most a handful."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rank_score"), "seq")
    numbered = relations.withColumn("ord", F.row_number().over(order)).withColumns({
        "_a": tx.prettify(F.col("feature_a")), "_b": tx.prettify(F.col("feature_b")),
        "_p": three_digits(F.col("p_value")), "_q": three_digits(F.col("adjusted_p_value")),
    })
    line = F.format_string(
        "%d. %s ↔ %s | method=%s | effect=%.3f | p=%s | adj_p=%s",
        "ord", "_a", "_b", "method", "effect_size", "_p", "_q")
    return numbered.select("ord", line.alias("line"))


# What stands before and after the lines of a summary.
SUMMARY_HEAD = "Top relations (final selected):"
SUMMARY_NOTES = (
    "- Only high-quality relations (effect >= {effect:.2f}, adj_p <= {alpha:.2f}, min_points = {points}) are plotted.",
    "- Parent-level reporting: engineered columns are used for calculation but outputs reference original CSV column names.",
    "- Plots labels use prettified parent names (underscores removed, Title Case).",
)


def summary_document(relations: DataFrame, n_rows: int, cfg: Settings = DEFAULTS) -> DataFrame:
    """(ord, line) of the whole summary: a heading (0), the relations, a blank line, and notes on the thresholds."""
    body = summary_lines(relations)
    notes = [n.format(effect=cfg.min_effect, alpha=cfg.alpha, points=min_points(n_rows)) for n in SUMMARY_NOTES]
    frame = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(line).alias("line")) for i, line in enumerate([SUMMARY_HEAD, "", "Notes:", *notes])])
    # a single row, also where there is no relation
    last = relations.agg(F.count(F.lit(1)).cast("int").alias("n")).select("n", F.inline(frame))
    return body.unionByName(last.select(F.when(F.col("at") == 0, 0).otherwise(F.col("n") + F.col("at")).alias("ord"), "line"))
