"""Cleaning and validation of a table and its targets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text as tx
from tabloom.functions.sampling import sample_per_column
from tabloom.operators.facts import column_facts, constant_columns, physical_classes, unpivoted
from tabloom.operators.layouts import to_timestamps
from tabloom.operators.ranking import lookup, ordered_counts, quoted_col
from tabloom.session import written
from tabloom.settings import DEFAULTS, ID_NAME, IDENTITY_NAME, PROSE_WORDS, TIME_NAME, Settings

# ---------------------------------------------------------------- type repair


def digit_strings(df: DataFrame, columns: list[str], threshold: float = 0.8) -> list[str]:
    """Of the columns tagged datetime, those that are really numbers.

    The share is over all rows, so nulls count against it.
    """
    if not columns:
        return []
    aggs = [
        F.avg(F.coalesce(quoted_col(c).cast("string"), F.lit("nan")).rlike(tx.PLAIN_DECIMAL).cast("int")).alias(f"s{i}")
        for i, c in enumerate(columns)
    ]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(columns) if (row[f"s{i}"] or 0.0) > threshold]


def repair_datetime_numeric(df: DataFrame, tagged_datetime: list[str]) -> DataFrame:
    fixes = {c: tx.as_number(quoted_col(c).cast("string")) for c in digit_strings(df, tagged_datetime)}
    return df.withColumns(fixes) if fixes else df


_PER_SECOND = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}
_EPOCH_LIMIT_S = 9_223_372_036  # what fits in 64-bit nanoseconds


def epoch_timestamp(c: Column, unit: str) -> Column:
    """Timestamp (no zone) of an epoch number, null outside the 64-bit ns range."""
    scale = _PER_SECOND[unit]
    micros = (c.cast("decimal(38,6)") * 1_000_000 / scale).cast("long")
    inside = F.abs(c.cast("double") / scale) <= _EPOCH_LIMIT_S
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(inside, epoch + F.make_dt_interval(secs=F.when(inside, micros).cast("decimal(18,0)") / 1_000_000))


def repair_numeric_datetime(df: DataFrame, epoch_units: dict[str, str], threshold: float = 0.95) -> DataFrame:
    """Numeric columns the caller declares as epochs become timestamps when over
    95 % of all rows convert."""
    if not epoch_units:
        return df
    items = list(epoch_units.items())
    row = df.agg(*[
        F.avg(epoch_timestamp(quoted_col(c), u).isNotNull().cast("int")).alias(f"s{i}")
        for i, (c, u) in enumerate(items)
    ]).first()
    fixes = {c: epoch_timestamp(quoted_col(c), u) for i, (c, u) in enumerate(items) if (row[f"s{i}"] or 0) > threshold}
    return df.withColumns(fixes) if fixes else df


# ------------------------------------------------------------- column dropping


def prose_signal(df: DataFrame, keys: list[str], columns: list[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """(column, has_words) from a seeded sample of the non-null values."""
    safe = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[quoted_col(k).alias(s) for k, s in zip(keys, safe)])
    cells = unpivoted(keyed, columns, safe).where("value is not null")
    word = r"\b(" + "|".join(PROSE_WORDS) + r")\b"
    sampled = sample_per_column(cells, cfg.id_sample_rows, safe, cfg.id_sample_seed)
    return sampled.groupBy("column").agg(F.max(F.lower("value").rlike(word)).alias("has_words"))


def id_scores(df: DataFrame, keys: list[str], columns: list[str] | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Identifier evidence per column; ``is_id`` is the verdict."""
    columns = columns or df.columns
    textual = [c for c in columns if physical_classes(df)[c] == "string"]
    facts = column_facts(df, columns)
    if textual:
        facts = facts.join(F.broadcast(prose_signal(df, keys, textual, cfg)), "column", "left")
    else:
        facts = facts.withColumn("has_words", F.lit(False))
    point = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    text_like = F.coalesce("has_words", F.lit(False)) | F.coalesce(F.col("space_frac") > 0.05, F.lit(False))
    scored = facts.select(
        "*",
        point(F.lower("column").rlike(ID_NAME)).alias("name_score"),
        point(F.col("len_std") < 2).alias("uniform_score"),
        point(F.col("alnum_frac") > 0.7).alias("alnum_score"),
        point((F.col("avg_len") >= 8) & (F.col("avg_len") <= 40)).alias("length_score"),
        text_like.alias("text_like"),
    )
    total = F.col("name_score") + F.col("uniform_score") + F.col("alnum_score") + F.col("length_score")
    numeric_id = F.col("n_unique") / F.col("non_null") > 0.95
    verdict = (
        F.when(F.col("non_null") == 0, F.lit(False))
        .when(F.col("physical") == "numeric", numeric_id)
        .when(F.col("physical") == "string", (total >= 3) & ~F.col("text_like"))
        .otherwise(F.lit(False))
    )
    return scored.withColumn("score", total).withColumn("is_id", verdict)


def decide_drops(facts: list, protected: set[str], cfg: Settings = DEFAULTS) -> dict[str, str]:
    """Column -> reason, from collected id_scores rows (one per column)."""
    out = {}
    for f in facts:
        name = f["column"]
        if cfg.protect_targets and name in protected:
            continue
        parsed = (f["ts_frac"] or 0.0) * (f["non_null"] / f["n_rows"] if f["n_rows"] else 0.0)
        if f["physical"] == "datetime":
            parsed = f["non_null"] / f["n_rows"] if f["n_rows"] else 0.0
        dated = parsed > 0.8
        if f["n_unique"] <= 1:
            out[name] = "constant"
        elif f["is_id"] and not (cfg.exempt_dates_from_ids and dated):
            out[name] = "identifier"
        elif re.search(IDENTITY_NAME, name.lower()):
            out[name] = "identity name"
        elif (
            f["physical"] in ("string", "datetime") and re.search(TIME_NAME, name.lower())
            and dated and f["first_day"] == f["last_day"]
        ):
            out[name] = "single day"
    return out


def datetime_columns(facts: list, dropped: dict[str, str]) -> list[str]:
    """String columns with a time-like name that become timestamps."""
    keep = []
    for f in facts:
        parsed = (f["ts_frac"] or 0.0) * (f["non_null"] / f["n_rows"] if f["n_rows"] else 0.0)
        if f["physical"] == "string" and f["column"] not in dropped and re.search(TIME_NAME, f["column"].lower()):
            if parsed > 0.8:
                keep.append(f["column"])
    return keep


def drop_constant(df: DataFrame, nulls_count: bool = False, protected: set[str] = frozenset()) -> DataFrame:
    """Drop columns with at most one distinct value.

    ``nulls_count`` treats null as a value (the rule after feature building).
    """
    gone = [c for c in constant_columns(df, nulls_count=nulls_count) if c not in protected]
    return df.drop(*gone)


def drop_identity_names(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(IDENTITY_NAME, c.lower())])


def normalize_datetimes(df: DataFrame) -> DataFrame:
    """Time-named columns are parsed in the layout of most of their cells, or dropped when they hold a single day."""
    named = [c for c, k in physical_classes(df).items() if k != "numeric" and re.search(TIME_NAME, c.lower())]
    if not named:
        return df
    facts = [{**r.asDict(), "is_id": False} for r in column_facts(df, named).collect()]
    dropped = {c: why for c, why in decide_drops(facts, set()).items() if why in ("single day",)}
    out = df.drop(*dropped)
    return to_timestamps(out, datetime_columns(facts, dropped), 0.0)


# -------------------------------------------------------------------- targets


def validate_targets(columns: list[str], primary: str, secondary, task: str) -> list[str]:
    """Raises before any job runs; returns the secondary list, at most two."""
    secondary = [secondary] if isinstance(secondary, str) else list(secondary or [])
    secondary = secondary[:2]
    if task not in ("classification", "regression"):
        raise ValueError(f"task must be classification or regression, not {task!r}")
    unknown = [c for c in [primary, *secondary] if c not in columns]
    if unknown:
        raise ValueError(f"unknown target columns: {unknown}")
    if primary in secondary:
        raise ValueError("the primary target cannot also be secondary")
    return secondary


def targets_record(file: str, primary: str, secondary, task: str) -> dict:
    secondary = [secondary] if isinstance(secondary, str) else list(secondary or [])
    return {
        "file": f"{file}.csv", "primary": primary, "secondary": secondary[:2], "type": task,
        "auto_changes": [], "needs_review": False,
    }


def top_classes(df: DataFrame, column: str, keep: int) -> DataFrame:
    """The most frequent values; ties by value ascending."""
    return (
        df.groupBy(quoted_col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("v")).limit(keep)
    )


def collapse_rare_classes(df: DataFrame, column: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """Over 50 classes: keep the 10 most frequent, the rest becomes one class.

    The decision needs the class count; the ten kept values are collected and
    become literals, so the rewrite is a projection without a join.
    """
    n_classes = df.agg(F.count_distinct(quoted_col(column))).first()[0]
    if n_classes <= cfg.max_classes:
        return df
    kept = [r["v"] for r in top_classes(df, column, cfg.kept_classes).collect()]
    stays = quoted_col(column).isin([v for v in kept if v is not None])
    if any(v is None for v in kept):
        stays = stays | quoted_col(column).isNull()
    value = quoted_col(column).cast("string")
    return df.withColumn(column, F.when(F.coalesce(stays, F.lit(False)), value).otherwise(F.lit(cfg.other_class)))


def encode_first_seen(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Text target to integer codes in order of first appearance; null stays null.

    Codes are positions in the order of each value's first row key, found by
    ranges of that key instead of one global sort.
    """
    # a single key keeps the aggregation hash based
    first = quoted_col(keys[0]) if len(keys) == 1 else F.struct(*[quoted_col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    firsts = (
        df.where(quoted_col(column).isNotNull())
        .groupBy(quoted_col(column).alias("_v"))
        .agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("n", F.lit(1))
    )
    # ranges of the first keys themselves, of any type; written, since both sides of a later join must see the same ranges
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(firsts.repartitionByRange(ranges, "_first").withColumn("_bucket", F.spark_partition_id()), "first-seen")
    placed = ordered_counts(ranged, "_first")
    sizes = ranged.agg(F.sum("_rows"), F.count(F.lit(1))).first()
    codes = placed.select(F.col("_v").alias(column), F.col("before").alias("_code"), "_rows")
    joined = lookup(df, codes, [column], ["_code"], sizes[0] or 0, sizes[1], weight="_rows")
    return joined.select(*[
        (F.col("_code") if c == column else quoted_col(c)).alias(c) for c in df.columns
    ])


def clean(df: DataFrame, keys: list[str], file: str, primary: str, secondary, task: str,
          epoch_units: dict[str, str] | None = None, tagged_datetime: list[str] | None = None,
          cfg: Settings = DEFAULTS):
    """Whole cleaning stage: (cleaned table, dropped columns, targets record)."""
    secondary = validate_targets(df.columns, primary, secondary, task)
    record = targets_record(file, primary, secondary, task)
    df = repair_datetime_numeric(df, tagged_datetime or [])
    df = repair_numeric_datetime(df, epoch_units or {})
    facts = [r.asDict() for r in id_scores(df, keys, cfg=cfg).collect()]
    dropped = decide_drops(facts, {primary, *secondary}, cfg)
    dates = datetime_columns(facts, dropped)
    # which layout a column has is decided over all of its cells
    df = to_timestamps(df, dates, 0.0)
    row_keys = [k for k in keys if k in dropped]
    out = df.drop(*[c for c in dropped if c not in row_keys])
    by_name = {f["column"]: f for f in facts}
    if primary in dropped:
        record["needs_review"] = True
    elif task == "classification":
        if by_name[primary]["n_unique"] > cfg.max_classes:
            out = collapse_rare_classes(out, primary, cfg)
            record["auto_changes"].append("collapsed to top 10 classes")
            record["needs_review"] = True
    elif by_name[primary]["physical"] != "numeric":
        out = encode_first_seen(out, primary, keys)
        record["auto_changes"].append("label-encoded to numeric")
        record["needs_review"] = True
    return out, dropped, record
