"""Registered queries and, next to each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Word lists that occur in the driver's texts (the default lists do not).
TEST_POSITIVE = ("the", "with", "and")
TEST_NEGATIVE = (
    "idiot", "moron", "stupid", "trash", "worthless", "pathetic", "disgusting", "scum", "clown", "la", "que", "der",
)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def words_sql(t: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({t}, ''), '\s+'), lambda w: w <> '')"


def hits_sql(t: str, vocabulary) -> str:
    """Number of listed tokens of a text."""
    tokens = rf"list_transform(regexp_split_to_array(lower(coalesce({t}, '')), '\s+'), lambda w: trim(w, '.,!?''\"'))"
    return f"len(list_filter({tokens}, lambda w: w IN ({sql_list(vocabulary)})))"


def clean_sql(t: str) -> str:
    plain = rf"regexp_replace(regexp_replace(coalesce({t}, ''), 'http\S+|www\S+', '', 'g'), '[^a-zA-Z0-9\s.,?!\-''\"]+', ' ', 'g')"
    return rf"trim(regexp_replace({plain}, '\s+', ' ', 'g'))"


def iso_sql(t: str) -> str:
    return (
        rf"(regexp_matches({t}, '^\s*[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([T ].*)?$') "
        rf"AND try_cast({t} AS TIMESTAMP) IS NOT NULL)"
    )
