"""Column facts: one unpivot and one shuffle answer every per-column question.

Cells become (column, value) pairs, are counted per distinct value and then
reduced to one row per column.  Map-side combining collapses repeated values,
so a hot value or an all-null column costs one row per task.  Long texts are
shuffled as a 65-character key, never whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import text as tx
from tabloom.operators.ranking import quoted_col


def physical_class(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "string"


def physical_classes(df: DataFrame) -> dict[str, str]:
    return {f.name: physical_class(f.dataType) for f in df.schema.fields}


def _slotted(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., slot, value): every cell as a string with its column number."""
    keys = keys or []
    wide = df.select(
        *[quoted_col(k).alias(k) for k in keys],
        *[quoted_col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(columns)],
    )
    pairs = ", ".join(f"{i}, _c{i}" for i in range(len(columns)))
    return wide.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(columns)}, {pairs}) AS (slot, value)")


def unpivoted(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys..., column, value) with every cell as a string; nulls kept."""
    long = _slotted(df, columns, keys)
    names = F.array(*[F.lit(c) for c in columns])[F.col("slot")]
    return long.select(*(keys or []), names.alias("column"), "value")


def column_facts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column.

    column, physical, n_rows, non_null, n_unique, avg_len, len_std, avg_words,
    ts_frac, number_frac (of non-null), digits_frac (of all rows, null counts as
    no), alnum_frac, space_frac, first_day, last_day.
    """
    columns = columns or df.columns
    kinds = physical_classes(df)
    number = {c: i for i, c in enumerate(columns)}
    numbers = lambda wanted: ", ".join(str(number[c]) for c in columns if kinds[c] in wanted) or "-1"

    def measures(x: str) -> dict[str, str]:
        """SQL text: one call per expression keeps plan building cheap."""
        text = f"slot IN ({numbers(('string',))}) AND {x} IS NOT NULL"
        stamp = tx.timestamp_sql(x)
        return {
            "len": f"length({x})",
            "words": rf"CASE WHEN {text} THEN size(array_remove(split({x}, r'\s+'), '')) END",
            "day": f"CASE WHEN slot IN ({numbers(('string', 'datetime'))}) THEN to_date({stamp}) END",
            "ts": f"CASE WHEN {text} THEN CAST({stamp} IS NOT NULL AS INT) END",
            "number": f"CASE WHEN {text} THEN CAST({x} RLIKE r'{tx.NUMBER}' AS INT) END",
            "digits": f"CAST({x} RLIKE r'{tx.PLAIN_DECIMAL}' AS INT)",
            "alnum": f"CASE WHEN {text} THEN CAST({x} RLIKE '^[A-Za-z0-9_-]+$' AS INT) END",
            "space": rf"CASE WHEN {text} THEN CAST({x} RLIKE r'\s' AS INT) END",
        }

    # a short value is its own key and is measured once, after equal ones have met; a long one before it becomes a digest
    cells = _slotted(df, columns).selectExpr("slot", "value", "length(value) > 64 AS long").selectExpr(
        "slot", "long", "CASE WHEN long THEN sha2(value, 256) ELSE value END AS key",
        *[f"CASE WHEN long THEN {e} END AS {m}" for m, e in measures("value").items()])
    met = cells.groupBy("slot", "long", "key").agg(F.count(F.lit(1)).alias("n"), *[F.max(m).alias(m) for m in measures("value")])
    per_value = met.selectExpr("slot", "n", "key", *[f"CASE WHEN long THEN {m} ELSE {e} END AS {m}" for m, e in measures("key").items()])

    def weighted(m):
        """Mean over the rows where the measure is known."""
        return f"sum(CAST(n AS DOUBLE) * {m}) / sum(CASE WHEN {m} IS NOT NULL THEN CAST(n AS DOUBLE) END)"

    non_null = "sum(CASE WHEN key IS NOT NULL THEN n ELSE 0 END)"
    square_gap = f"sum(CAST(n AS DOUBLE) * len * len) - sum(CAST(n AS DOUBLE) * len) * ({weighted('len')})"
    facts = per_value.groupBy("slot").agg(*[F.expr(f"{e} AS {a}") for a, e in {
        "n_rows": "sum(n)",
        "non_null": non_null,
        "n_unique": "count(key)",
        "avg_len": weighted("len"),
        "len_std": f"CASE WHEN {non_null} > 1 THEN sqrt(greatest({square_gap}, 0.0D) / ({non_null} - 1)) END",
        "avg_words": weighted("words"),
        "ts_frac": weighted("ts"),
        "number_frac": weighted("number"),
        "digits_frac": "coalesce(sum(CAST(n AS DOUBLE) * digits), 0.0D) / sum(n)",
        "alnum_frac": weighted("alnum"),
        "space_frac": weighted("space"),
        "first_day": "min(day)",
        "last_day": "max(day)",
    }.items()])
    # slots are numbers inside the shuffle and become names here
    names = F.array(*[F.lit(c) for c in columns])[F.col("slot")]
    physical = F.array(*[F.lit(kinds[c]) for c in columns])[F.col("slot")]
    return facts.withColumns({"column": names, "physical": physical}).drop("slot")


def unique_fraction() -> "F.Column":
    return F.when(F.col("non_null") > 0, F.col("n_unique") / F.col("non_null")).otherwise(F.lit(0.0))


def constant_columns(df: DataFrame, columns: list[str] | None = None, nulls_count: bool = False) -> list[str]:
    """Columns with at most one distinct value; ``nulls_count`` treats null as one.

    Minimum, maximum and counts in one aggregation settle it: no shuffle of
    values, no distinct count.  Strings are compared by hash first, and only
    those with a single hash are then compared as text.
    """
    columns = columns or df.columns
    kinds = physical_classes(df)
    shown = lambda c: F.when(quoted_col(c).isNotNull(), F.xxhash64(quoted_col(c))) if kinds[c] == "string" else quoted_col(c)
    found = _single_valued(df, {c: shown(c) for c in columns}, nulls_count)
    doubtful = [c for c in found if kinds[c] == "string"]
    if doubtful:
        sure = set(_single_valued(df, {c: quoted_col(c) for c in doubtful}, nulls_count))
        found = [c for c in found if c not in doubtful or c in sure]
    return found


def _single_valued(df: DataFrame, shown: dict, nulls_count: bool) -> list[str]:
    aggs = []
    for i, x in enumerate(shown.values()):
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.count(x).alias(f"n{i}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    out = []
    for i, c in enumerate(shown):
        n = row[f"n{i}"]
        holes = nulls_count and n < row["rows"]
        if n == 0 or (row[f"lo{i}"] == row[f"hi{i}"] and not holes):
            out.append(c)
    return out
