"""Feature engineering: numeric, categorical, text, datetime and row features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import text as tx
from tabloom.operators.cleaning import drop_constant
from tabloom.operators.facts import column_facts, physical_class, physical_classes
from tabloom.operators.ranking import lookup, number, quoted_col
from tabloom.operators.selection import quantiles
from tabloom.session import written
from tabloom.settings import DEFAULTS, Settings

TEXT_PARTS = ("word_count", "unique_ratio", "has_url", "has_emoji", "upper_ratio")
DATE_PARTS = ("year", "month", "day", "hour", "weekday", "is_weekend")
SKETCH_SLACK = 0.3  # six standard errors of a sketch
SENTIMENT_NUMERIC = ("_sentiment_num", "_sentiment_confidence")

# ------------------------------------------------------------------- routing


def routing_rule() -> Column:
    """Kind of a column without a profile tag, over a facts row."""
    short = (F.coalesce("avg_words", F.lit(0.0)) < 3) & (F.col("n_unique") <= 30)
    return (
        F.when(F.col("physical").isin("numeric", "boolean"), "numeric")
        .when(F.col("physical") == "datetime", "datetime")
        .when(short, "categorical")
        .otherwise("text")
    )


def classify(df: DataFrame, tags: dict[str, str] | None = None) -> dict[str, str]:
    """Column -> numeric | categorical | text | datetime.  Profile tags first."""
    tags = tags or {}
    open_columns = [c for c in df.columns if c not in tags]
    found = {}
    if open_columns:
        rows = column_facts(df, open_columns).select("column", routing_rule().alias("kind")).collect()
        found = {r["column"]: r["kind"] for r in rows}
    return {c: tags.get(c) or found[c] for c in df.columns}


# ------------------------------------------------------------------- numeric


def to_number(df: DataFrame, c: str) -> Column:
    kind = physical_class(df.schema[c].dataType)
    if kind == "numeric":
        return number(quoted_col(c))
    if kind == "boolean":
        return quoted_col(c).cast("int").cast("double")
    return tx.as_number(quoted_col(c).cast("string"))


def median_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaN become the exact median.

    Columns without nulls cost nothing beyond the one counting action; the medians
    of all others are found together, by a radix descent.
    """
    if not columns:
        return df
    coerced = df.withColumns({c: to_number(df, c) for c in columns})
    row = coerced.agg(F.count(F.lit(1)).alias("rows"), *[F.count(quoted_col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    holey = [c for i, c in enumerate(columns) if 0 < row[f"n{i}"] < row["rows"]]
    if not holey:
        return coerced
    cells = coerced.select(F.inline(F.array(*[F.struct(F.lit(i).alias("slot"), quoted_col(c).alias("v")) for i, c in enumerate(holey)])))
    found = {r["slot"]: r["q0"] for r in quantiles(cells, "v", [0.5], ["slot"]).collect()}
    return coerced.withColumns({c: F.coalesce(quoted_col(c), F.lit(found[i])) for i, c in enumerate(holey)})


def moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Decision action: mean, population and sample deviation of each column."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        x = number(quoted_col(c))
        # a merged variance of equal values can differ from zero by rounding
        varies = F.min(x) < F.max(x)
        aggs += [F.avg(x).alias(f"m{i}"), F.when(varies, F.stddev_pop(x)).otherwise(0.0).alias(f"p{i}"),
                 F.when(varies, F.stddev_samp(x)).otherwise(0.0).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: {"mean": row[f"m{i}"], "pop": row[f"p{i}"], "std": row[f"s{i}"]} for i, c in enumerate(columns)}


def zscores(df: DataFrame, columns: list[str], stats: dict[str, dict] | None = None) -> DataFrame:
    """``<c>_z`` with the population deviation; a constant column gives zeros."""
    stats = stats or moments(df, columns)
    out = {}
    for c in columns:
        s = stats[c]
        if s["mean"] is None or not s["pop"]:
            out[f"{c}_z"] = F.when(number(quoted_col(c)).isNotNull(), F.lit(0.0))
        else:
            out[f"{c}_z"] = (number(quoted_col(c)) - F.lit(s["mean"])) / F.lit(s["pop"])
    return df.withColumns(out) if out else df


def numeric_meta(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std) with the sample deviation; one aggregation, then a
    one-row unpivot."""
    aggs, pairs = [], []
    for i, c in enumerate(columns):
        x = number(quoted_col(c))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
        pairs.append(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")))
    return df.agg(*aggs).select(F.inline(F.array(*pairs)))


# --------------------------------------------------------------- categorical


def as_category(c: str, cfg: Settings = DEFAULTS) -> Column:
    return F.coalesce(quoted_col(c).cast("string"), F.lit(cfg.null_category))


def label_mapping(df: DataFrame, columns: list[str], cfg: Settings = DEFAULTS) -> dict[str, list[str] | None]:
    """Sorted class list per column, or None above 30 classes.

    A sketch rules out the columns that clearly have more; its error is far below
    the factor of two left between 30 and the limit, so the exact class sets of
    the others stay small.
    """
    if not columns:
        return {}
    sketch = df.agg(*[F.approx_count_distinct(as_category(c, cfg)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    small = [c for i, c in enumerate(columns) if sketch[f"d{i}"] <= 2 * cfg.label_encode_max]
    out: dict[str, list[str] | None] = {c: None for c in columns}
    if small:
        row = df.agg(*[F.collect_set(as_category(c, cfg)).alias(f"s{i}") for i, c in enumerate(small)]).first()
        found = {c: sorted(row[f"s{i}"]) for i, c in enumerate(small)}
        out.update({c: classes for c, classes in found.items() if len(classes) <= cfg.label_encode_max})
    return out


def label_encode(df: DataFrame, mapping: dict[str, list[str]], cfg: Settings = DEFAULTS) -> DataFrame:
    """``<c>_encoded``: at most 30 codes per column, applied as a literal map."""
    out = {}
    for c, classes in mapping.items():
        if not classes:
            continue
        codes = F.create_map(*[F.lit(x) for i, v in enumerate(classes) for x in (v, i)])
        out[f"{c}_encoded"] = codes[as_category(c, cfg)]
    return df.withColumns(out) if out else df


def frequencies(df: DataFrame, columns: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """(slot, v, n, freq), written: share of rows per value of each column, null counted as a value of its own; one scan."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("slot"), as_category(c, cfg).alias("v")) for i, c in enumerate(columns)])))
    counts = written(cells.groupBy("slot", "v").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    rows = counts.where("slot = 0").agg(F.sum("n")).first()[0]
    return counts.withColumn("freq", F.col("n") / F.lit(rows))


def frequency_encode(df: DataFrame, columns: list[str], cfg: Settings = DEFAULTS, table: DataFrame | None = None) -> DataFrame:
    """``<c>_freq``: share of the row's value, looked up by value.  ``table`` as from ``frequencies`` of these columns."""
    if not columns:
        return df
    table = frequencies(df, columns, cfg) if table is None else table
    sizes = mapping_sizes(table, columns)
    rows = table.where("slot = 0").agg(F.sum("n")).first()[0] or 0
    out = df
    for i, c in enumerate(columns):
        own = table.where(F.col("slot") == i).select(F.col("v").alias("_key"), F.col("freq").alias("_freq"), "n")
        keyed = out.withColumn("_key", as_category(c, cfg))
        found = lookup(keyed, own, ["_key"], ["_freq"], rows, sizes[c])
        out = found.withColumnRenamed("_freq", f"{c}_freq").drop("_key")
    return out


def mapping_sizes(table: DataFrame, columns: list[str]) -> dict[str, int]:
    """How many values each column of a table of frequencies has."""
    found = {r["slot"]: r["count"] for r in table.groupBy("slot").count().collect()}
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


# ------------------------------------------------- text, sentiment, datetime


def text_features(df: DataFrame, columns: list[str]) -> DataFrame:
    out = {}
    for c in columns:
        t = quoted_col(c).cast("string")
        out[f"{c}_word_count"] = tx.word_count(t)
        out[f"{c}_unique_ratio"] = tx.unique_word_ratio(t)
        out[f"{c}_has_url"] = tx.url_flag(t)
        out[f"{c}_has_emoji"] = tx.emoji_flag(t)
        out[f"{c}_upper_ratio"] = tx.upper_ratio(t)
    return df.withColumns(out) if out else df


def row_mean(columns: list[str]) -> Column:
    """Mean of the non-null values of a row."""
    zero = F.lit(0.0)
    total = reduce(lambda a, b: a + b, [F.coalesce(number(quoted_col(c)), zero) for c in columns])
    known = reduce(lambda a, b: a + b, [number(quoted_col(c)).isNotNull().cast("int") for c in columns])
    return F.when(known > 0, total / known)


def average_sentiment(df: DataFrame) -> DataFrame:
    found = [c for c in df.columns if c.endswith("_sentiment_num")]
    return df.withColumn("avg_sentiment_all_textcols", row_mean(found)) if found else df


def datetime_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    out = {}
    for c in columns:
        t = quoted_col(c)
        if physical_class(df.schema[c].dataType) == "string":
            t = tx.as_timestamp(c)
            out[c] = t
        out[f"{c}_year"] = F.year(t)
        out[f"{c}_month"] = F.month(t)
        out[f"{c}_day"] = F.dayofmonth(t)
        out[f"{c}_hour"] = F.hour(t)
        out[f"{c}_weekday"] = F.weekday(t)
        out[f"{c}_is_weekend"] = F.coalesce(F.weekday(t) >= 5, F.lit(False)).cast("int")
    return df.withColumns(out) if out else df


def row_meta(df: DataFrame, text_columns: list[str]) -> DataFrame:
    """n_missing over all columns so far, non-null text columns, any URL flag."""
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    flags = [c for c in df.columns if "_has_url" in c]
    return df.withColumns({
        "n_missing": add([quoted_col(c).isNull().cast("int") for c in df.columns]),
        "n_text_cols_nonempty": add([quoted_col(c).isNotNull().cast("int") for c in text_columns])
        if text_columns else F.lit(0),
        "has_urls": (F.greatest(*[quoted_col(c) for c in flags]) if len(flags) > 1 else quoted_col(flags[0]))
        if flags else F.lit(0),
    })


# ------------------------------------------------------------------ redundancy


def _comparable(df: DataFrame, c: str) -> tuple[str, Column]:
    """Value under which columns are compared: numbers by value whatever their
    width, text and timestamps only with their own kind."""
    kind = physical_class(df.schema[c].dataType)
    if kind in ("numeric", "boolean"):
        x = quoted_col(c)
        x = x.cast("int").cast("double") if kind == "boolean" else x.cast("double")
        return "number", F.when(~F.isnan(x), x + F.lit(0.0))
    if kind == "datetime":
        return "time", quoted_col(c).cast("timestamp_ntz")
    return "text", quoted_col(c).cast("string")


def duplicate_columns(df: DataFrame, protected: set[str] = frozenset()) -> list[tuple[str, str]]:
    """(later, earlier) pairs of columns equal in every row.

    One aggregation gives each column an order-independent fingerprint, so only
    columns that agree on it are compared exactly, in a second aggregation.
    """
    whole_row = F.xxhash64(*[quoted_col(c) for c in df.columns])
    hashed = df.select(
        *[F.xxhash64(whole_row, _comparable(df, c)[1]).alias(f"h{i}") for i, c in enumerate(df.columns)]
    )
    prints = hashed.agg(*[
        F.struct(F.bit_xor(f"h{i}").alias("x"), F.sum(F.col(f"h{i}").bitwiseAND(0xFFFFFF)).alias("s")).alias(f"p{i}")
        for i in range(len(df.columns))
    ]).first()
    groups: dict[tuple, list[str]] = {}
    for i, c in enumerate(df.columns):
        mark = (_comparable(df, c)[0], prints[f"p{i}"]["x"], prints[f"p{i}"]["s"])
        groups.setdefault(mark, []).append(c)
    pairs = [(later, names[0]) for names in groups.values() for later in names[1:]]
    if not pairs:
        return []
    row = df.agg(*[
        F.max((~_comparable(df, a)[1].eqNullSafe(_comparable(df, b)[1])).cast("int")).alias(f"d{i}")
        for i, (a, b) in enumerate(pairs)
    ]).first()
    return [p for i, p in enumerate(pairs) if row[f"d{i}"] == 0 and p[0] not in protected]


def recoded_columns(df: DataFrame, columns: list[str] | None = None, limit: int = 1 << 20) -> list[tuple[str, str]]:
    """(later, earlier) pairs of columns that say the same in other values: each value of one stands for one of the other.

    That is so if and only if both have as many distinct values as distinct pairs of values; null counts as a value.  Sketches of
    each column rule out pairs whose numbers differ by more than their error, and a sketch of each remaining pair those that
    have more pairs than values; only what is left is counted exactly, all in one shuffle.  Constant columns, and those of more
    than ``limit`` values (row keys are a recoding of each other in any table), are not compared.
    """
    columns = columns or df.columns
    value = lambda c: F.coalesce(F.concat(F.lit("="), tx.value_key(quoted_col(c).cast("string"))), F.lit(""))
    sizes = df.agg(*[F.approx_count_distinct(value(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    size = {c: sizes[f"d{i}"] for i, c in enumerate(columns)}
    near = lambda a, b: abs(a - b) <= 1 + SKETCH_SLACK * max(a, b)
    pairs = [(b, a) for i, a in enumerate(columns) for b in columns[i + 1:] if 1 < min(size[a], size[b]) and max(size[a], size[b]) <= limit and near(size[a], size[b])]
    if not pairs:
        return []
    both = df.agg(*[F.approx_count_distinct(F.struct(value(a), value(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    pairs = [p for i, p in enumerate(pairs) if near(both[f"p{i}"], max(size[p[0]], size[p[1]]))]
    if not pairs:
        return []
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("pair"), value(a).alias("x"), value(b).alias("y")) for i, (a, b) in enumerate(pairs)])))
    seen = written(cells.distinct(), "recoding")
    # a value that meets two others shows twice here
    sides = seen.select("pair", F.inline(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("v")), F.struct(F.lit("y").alias("side"), F.col("y").alias("v")))))
    twice = {r["pair"] for r in sides.groupBy("pair", "side", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pair").distinct().collect()}
    return [p for i, p in enumerate(pairs) if i not in twice]


def drop_duplicate_columns(df: DataFrame, protected: set[str] = frozenset()) -> DataFrame:
    return df.drop(*[later for later, _ in duplicate_columns(df, protected)])


# --------------------------------------------------------------------- lineage


def lineage(columns: list[str], kinds: dict[str, str]) -> list[tuple[str, str, int]]:
    """(parent, derived, position) of every engineered column that survived."""
    present = set(columns)
    found: dict[str, list[str]] = {}

    def add(parent, derived):
        if derived in present and derived not in found.setdefault(parent, []):
            found[parent].append(derived)

    by_kind = lambda kind: [c for c, k in kinds.items() if k == kind]
    suffixes = (
        ("text", TEXT_PARTS), ("numeric", ("z",)), ("categorical", ("encoded", "freq")), ("datetime", DATE_PARTS)
    )
    for kind, parts in suffixes:
        for c in by_kind(kind):
            for part in parts:
                add(c, f"{c}_{part}")
    for c in columns:
        for suffix in ("_sentiment", *SENTIMENT_NUMERIC):
            if c.endswith(suffix):
                add(c[: -len(suffix)], c)
    return [(p, d, i) for p, ds in found.items() for i, d in enumerate(ds)]


LINEAGE_SCHEMA = T.StructType([
    T.StructField("parent", T.StringType()), T.StructField("derived", T.StringType()),
    T.StructField("pos", T.IntegerType()),
])


def engineer(df: DataFrame, tags: dict[str, str], targets: list[str], cfg: Settings = DEFAULTS):
    """Whole feature stage: (feature table, metadata).

    Decision actions: routing facts, column bounds, moments, class lists and the
    redundancy checks.  Everything else is one projection chain.
    """
    original = list(df.columns)
    tags = {c: t for c, t in tags.items() if c in original}
    # a tag that no longer fits the physical type is ignored
    for c, k in physical_classes(df).items():
        if tags.get(c) == "datetime" and k == "numeric":
            tags[c] = "numeric"
        elif k == "datetime":
            tags[c] = "datetime"
    kinds = {c: k for c, k in classify(df, tags).items() if c not in targets}
    of = lambda kind: [c for c, k in kinds.items() if k == kind]
    numeric = [c for c in of("numeric") if not c.endswith(SENTIMENT_NUMERIC)]
    categorical = [c for c in of("categorical") if not c.endswith("_sentiment")]

    out = median_fill(df, numeric)
    stats = moments(out, numeric)
    out = zscores(out, numeric, stats)
    mapping = label_mapping(out, categorical, cfg)
    out = label_encode(out, {c: m for c, m in mapping.items() if m is not None}, cfg)
    many = [c for c, m in mapping.items() if m is None]
    shares = frequencies(out, many, cfg) if many else None
    sizes = mapping_sizes(shares, many) if many else {}
    out = frequency_encode(out, many, cfg, shares)
    out = text_features(out, of("text"))
    out = average_sentiment(out)
    out = datetime_parts(out, of("datetime"))
    out = row_meta(out, of("text"))
    return out, {
        "numeric": {c: {"mean": s["mean"], "std": s["std"], "filled": True} for c, s in stats.items()},
        "categorical": {
            c: {"type": "label", "mapping": {v: i for i, v in enumerate(m)}} if m is not None
            else {"type": "freq", "mapping_size": sizes[c]}
            for c, m in mapping.items()
        },
        "text_columns": of("text"),
        "datetime_columns": of("datetime"),
        "targets": targets,
        "kinds": kinds,
        "original_columns": original,
        "sentiment_columns": [c for c in out.columns if c.endswith("_sentiment_num")],
    }


def prune(df: DataFrame, meta: dict, targets: list[str]) -> tuple[DataFrame, dict]:
    """Drops constant and duplicate columns of the *written* feature table and
    completes the metadata with the lineage of what is left."""
    out = drop_constant(df, nulls_count=True, protected=set(targets))
    out = drop_duplicate_columns(out, set(targets))
    links = lineage(out.columns, meta["kinds"])
    return out, {
        **meta,
        "lineage": links,
        "feature_columns": [c for c in out.columns if c not in meta["original_columns"]],
    }
