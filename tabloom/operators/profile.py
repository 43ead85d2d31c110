"""Profiling: shape, semantic types, samples, schema sentences, domains, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions.domains import DOMAIN_KEYWORDS, DEFAULT_DOMAIN, TITLE_RULES, DEFAULT_TITLE
from tabloom.functions.keywords import first_match
from tabloom.operators.facts import column_facts, physical_classes, unique_fraction, unpivoted
from tabloom.operators.ranking import quoted_col
from tabloom.session import written


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def semantic_type() -> Column:
    """Rule over a facts row.  Physical types win; parse tests are for strings."""
    few = (unique_fraction() < 0.05) | (F.col("n_unique") <= 30)
    return (
        F.when(F.col("physical") == "datetime", "datetime")
        .when(F.col("physical").isin("numeric", "boolean"), "numeric")
        .when(F.col("non_null") == 0, "numeric")  # an all-null column reads as a float
        .when(F.col("ts_frac") > 0.95, "datetime")
        .when(few, "categorical")
        .when(F.col("avg_len") > 20, "text")
        .otherwise("categorical")
    )


HEAD_ROWS = 256


def first_values(df: DataFrame, keys: list[str], columns: list[str] | None = None, n: int = 5) -> DataFrame:
    """(column, sample_values): first n non-null values of each column in key order.

    The first ``HEAD_ROWS`` rows, found by a bounded heap in each task, hold them for most columns.  Only columns with
    too few values there are searched in the whole table.
    """
    columns = columns or df.columns
    needed = list(dict.fromkeys([*columns, *keys]))
    key = F.struct(*[quoted_col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    head = written(df.select(*[quoted_col(c) for c in needed]).orderBy(*[quoted_col(k) for k in keys]).limit(HEAD_ROWS), "head")
    facts = head.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last")).first()
    if facts["n"] < HEAD_ROWS:
        return _first_values(head, keys, columns, n)
    # rows that share the last key may be cut off, so only those before it count
    last = F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(f"k{i}") for i, (k, v) in enumerate(zip(keys, facts["last"]))])
    early = head.where(key < last)
    counts = early.agg(*[F.count(quoted_col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    there = [c for i, c in enumerate(columns) if counts[f"n{i}"] >= n]
    rest = [c for c in columns if c not in there]
    parts = [_first_values(early, keys, there, n)] if there else []
    parts += [_first_values(df, keys, rest, n)] if rest else []
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _first_values(df: DataFrame, keys: list[str], columns: list[str], n: int) -> DataFrame:
    safe_keys = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[quoted_col(k).alias(s) for k, s in zip(keys, safe_keys)])
    order = Window.partitionBy("column").orderBy(*safe_keys, "value")
    return (
        unpivoted(keyed, columns, safe_keys)
        .where("value is not null")
        .withColumn("pos", F.row_number().over(order))
        .where(F.col("pos") <= n)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("s"))
        .select("column", F.col("s.value").alias("sample_values"))
    )


def profile(df: DataFrame, keys: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The profile table: column, ordinal, dtype, n_rows, non_null, unique, sample_values."""
    columns = columns or df.columns
    order = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    out = column_facts(df, columns).select(
        "column",
        order[F.col("column")].alias("ordinal"),
        semantic_type().alias("dtype"),
        "n_rows",
        "non_null",
        F.col("n_unique").alias("unique"),
    )
    if keys:
        samples = first_values(df, keys, columns)
        out = out.join(F.broadcast(samples), "column", "left")  # one row per column
        out = out.withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    return out


def preview(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[quoted_col(k) for k in keys]).limit(n)


def schema_sentence(name: str, df: DataFrame) -> DataFrame:
    """One row (table_name, summary); an empty table gives no row."""
    kinds = physical_classes(df)
    numeric = [c for c in df.columns if kinds[c] == "numeric"]
    tail = (
        f"Contains numeric fields such as: {', '.join(numeric)}." if numeric else "No numeric fields detected."
    )
    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .where("n_rows > 0")
        .select(
            F.lit(name).alias("table_name"),
            F.lit(", ".join(df.columns)).alias("columns"),
            F.concat(
                F.lit(f"Columns: {', '.join(df.columns)}. Rows: "), F.col("n_rows").cast("string"), F.lit(f". {tail}")
            ).alias("summary"),
        )
    )


def schema_sentences(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [schema_sentence(name, df) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _with_first(df: DataFrame, column: str, out: str, rules, default: str) -> DataFrame:
    """First rule, in order, whose keyword occurs in the lower-cased text, which is read once; no shuffle."""
    return df.withColumn(out, first_match(F.lower(quoted_col(column)), rules, default))


def with_domain(df: DataFrame, column: str, out: str = "domain", rules=tuple(DOMAIN_KEYWORDS),
                default: str = DEFAULT_DOMAIN) -> DataFrame:
    return _with_first(df, column, out, rules, default)


def with_title(df: DataFrame, column: str = "domain", out: str = "title", rules=tuple(TITLE_RULES),
               default: str = DEFAULT_TITLE) -> DataFrame:
    return _with_first(df, column, out, rules, default)


def title_corpus(tables: dict[str, DataFrame]) -> DataFrame:
    """(csv_data_summary, title) per non-empty table."""
    searched = F.concat_ws(" ", "summary", F.regexp_replace("columns", ", ", " "))
    described = schema_sentences(tables).withColumn("_searched", searched)
    return with_title(with_domain(described, "_searched")).select(F.col("summary").alias("csv_data_summary"), "title")
