"""Tolerant CSV reading and typing of the string table it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import text as tx
from tabloom.operators.ranking import quoted_col

_CORRUPT = "_tabloom_record"


def _kinds(spark: SparkSession, path: str) -> DataFrame:
    """(file, valid, wrapped, header): whether all lines are UTF-8, whether a quoted value may hold a line break, and 128 bits
    of hash that name the first line.  Lines are read in a splittable scan and combined per file; as states are of fixed
    length, no task has to sort its lines for that."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    first = F.when(F.col("block") == 0, F.col("at"))
    return lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.bool_or(quotes % 2 == 1).alias("wrapped"),
        F.min_by(F.xxhash64("value"), first).alias("high"), F.min_by(F.xxhash64(F.lit(1), "value"), first).alias("low"),
    ).select("file", "valid", "wrapped", F.concat_ws("-", "high", "low").alias("header"))


def _header(spark: SparkSession, file: str, encoding: str, sep: str) -> list[str]:
    """Column names; repeated ones get .1, .2, ... and a leading BOM is dropped."""
    first = (
        spark.read.options(header=False, sep=sep, quote='"', escape='"', multiLine=True, encoding=encoding)
        .csv(file).limit(1).first()
    )
    names, seen = [], {}
    for i, raw in enumerate(first):
        name = (raw or "").lstrip("\ufeff") or f"Unnamed: {i}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(name if count == 0 else f"{name}.{count}")
    return names


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None, file_column: str | None = None) -> DataFrame:
    """All cells as strings: long rows dropped, short rows padded, NA words null.

    A row with more fields than the header is skipped even when the extra field
    is empty.  Files are read by encoding and header, and columns are aligned by
    name, so files may have them in any order.  Files stay splittable unless a
    quoted value holds a line break, which the first scan finds out
    (``multi_line`` decides it instead).  ``file_column`` adds the name of each row's file.
    """
    found = _kinds(spark, path)
    # one row per kind of file, and the names of files only where kinds differ
    kinds = found.groupBy("valid", "header").agg(F.bool_or("wrapped").alias("wrapped"), F.min("file").alias("file")).collect()
    if not kinds:
        raise ValueError(f"no CSV files under {path}")
    parts = []
    for kind in sorted(kinds, key=lambda k: (not k["valid"], k["file"])):
        encoding = "UTF-8" if kind["valid"] else "ISO-8859-1"
        files = [path] if len(kinds) == 1 else [
            r["file"] for r in found.where(F.col("valid") == kind["valid"]).where(F.col("header").eqNullSafe(kind["header"])).select("file").collect()]
        wrapped = kind["wrapped"] if multi_line is None else multi_line
        names = _header(spark, kind["file"], encoding, sep)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
        raw = (
            spark.read.schema(schema)
            .options(header=True, enforceSchema=True, sep=sep, quote='"', escape='"', multiLine=wrapped,
                     encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT, columnPruning=False)
            .csv(files)
        )
        # pairs of quotes hold what no separator in it counts for; a doubled quote is two such pairs side by side
        unquoted = F.regexp_replace(F.col(_CORRUPT), '"[^"]*"', "")
        separators = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit("")))
        # the first column is named too: the record alone cannot be asked for, as a count would
        too_long = F.coalesce((separators >= len(names)) & (F.length(F.coalesce(quoted_col(names[0]), F.lit(""))) >= 0), F.lit(False))
        cells = [
            F.when(~F.coalesce(quoted_col(n), F.lit("")).isin(*tx.NA_TOKENS), quoted_col(n)).alias(n) for n in names
        ]
        if file_column:
            cells.append(F.col("_metadata.file_path").alias(file_column))
        parts.append(raw.where(~too_long).select(*cells))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def type_states(df: DataFrame, part: str | None = None) -> DataFrame:
    """(part, column, rows, cells, numbers, whole, flags): what decides the type of each string column, per part.

    A part is a file, a batch, or the whole table.  The states of parts add up to the state of all of them, so they can be stored,
    and a folder that grows is typed by scanning new files only.  One aggregation of one row per part.
    """
    columns = [c for c in df.columns if c != part]
    aggs = []
    for i, c in enumerate(columns):
        v = quoted_col(c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count(tx.as_number(v)).alias(f"d{i}"),
            F.count(F.when(v.rlike(tx.INTEGER), F.trim(v).try_cast("bigint"))).alias(f"l{i}"),
            F.count(F.when(v.isin("True", "False", "TRUE", "FALSE", "true", "false"), 1)).alias(f"b{i}"),
        ]
    rows = df.groupBy((F.lit("") if part is None else quoted_col(part)).alias("part")).agg(F.count(F.lit(1)).alias("rows"), *aggs)
    items = [
        F.struct(F.lit(c).alias("column"), F.col("rows"), *[F.col(f"{k}{i}").alias(a) for k, a in zip("ndlb", ("cells", "numbers", "whole", "flags"))])
        for i, c in enumerate(columns)
    ]
    return rows.select("part", F.inline(F.array(*items)))


def type_rule() -> Column:
    """Type that follows from a state: the least one in the order long, double, boolean, string that takes every cell.

    Whole numbers with a missing value are double, an all-null column is double, a true/false column with nulls stays a string.
    """
    n, rows = F.col("cells"), F.col("rows")
    return (
        F.when(n == 0, "double")
        .when((F.col("whole") == n) & (n == rows), "long")
        .when(F.col("numbers") == n, "double")
        .when((F.col("flags") == n) & (n == rows), "boolean")
        .otherwise("string")
    )


def merged_states(states: DataFrame) -> DataFrame:
    """States of all parts together.  A part without a column has only missing cells in it."""
    total = states.groupBy("part").agg(F.max("rows").alias("rows")).agg(F.sum("rows").alias("rows"))
    sums = states.groupBy("column").agg(*[F.sum(c).alias(c) for c in ("cells", "numbers", "whole", "flags")])
    return sums.join(F.broadcast(total))  # one row


def column_types(df: DataFrame) -> DataFrame:
    """(column, type): long, double, boolean or string for each string column; one aggregation."""
    return type_states(df).select("column", type_rule().alias("type"))


def infer_types(df: DataFrame) -> DataFrame:
    """Casts the string columns of ``df`` by :func:`column_types`."""
    kinds = {r["column"]: r["type"] for r in column_types(df).collect()}
    cast = {
        "double": tx.as_number,
        "long": lambda v: F.trim(v).try_cast("bigint"),
        "boolean": lambda v: F.lower(v).try_cast("boolean"),
        "string": lambda v: v,
    }
    return df.select(*[cast[kinds[c]](quoted_col(c)).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', encoding="UTF-8").csv(path)
