"""Text responses: split into summary and recommendations, tidy, report facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text as tx
from tabloom.functions.sampling import sample_per_column
from tabloom.operators.facts import unpivoted
from tabloom.operators.ranking import quoted_col

# The section marks tried in this order, and heading patterns.
SECTION_MARKS = (
    "\nrecommendations", "\nrecommendation", "\n- recommendations", "\nRecommendations", "\nRecommendation",
)
STARRED_HEADING = r"(?imd)^\s*(\*{0,2}\s*final summary\s*\*{0,2}\s*[:\-]*\s*)"
HASHED_HEADING = r"(?imd)^\s*(#{1,3}\s*final summary\s*)"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, LINE_BREAK), tx.strip), lambda s: s != "")


def _section_item(line: Column) -> Column:
    """A line of a recommendation section without its bullet or number."""
    numbered = line.rlike(r"^[0-9][.)]")
    after_dot = tx.strip(F.regexp_replace(line, r"(?s)^[^.]*\.", ""))
    return (
        F.when(line.rlike(r"^[-*]"), tx.strip(F.regexp_replace(line, r"^[-* ]+", "")))
        .when(numbered & line.contains("."), after_dot)
        .otherwise(line)
    )


def split_response(c: Column) -> Column:
    """struct(summary, recommendations) of one response text.

    With a recommendation heading the text is cut there.  Otherwise the first
    four sentences are the summary and bullet or numbered lines (or, failing
    those, the remaining lines) are the recommendations.
    """
    text = tx.strip(F.coalesce(c, F.lit("")))
    mark = F.lit(None).cast("string")
    for m in reversed(SECTION_MARKS):
        mark = F.when(text.contains(m), F.lit(m)).otherwise(mark)
    at = F.position(mark, text)
    head = tx.strip(F.substr(text, F.lit(1), at - 1))
    tail = tx.strip(F.substr(text, at + F.length(mark)))
    sectioned = F.struct(head.alias("summary"), F.transform(_lines(tail), _section_item).alias("recommendations"))

    parts = F.split(text, r"\. ")
    bullet = F.filter(F.transform(F.split(text, LINE_BREAK), tx.strip), lambda s: s.rlike(r"^([-*] |[0-9])"))
    bare = F.transform(bullet, lambda s: tx.strip(F.regexp_replace(s, r"^[-*0-9. )]+", "")))
    rest = _lines(F.array_join(F.slice(parts, 5, 1 << 30), ". "))
    whole = F.struct(text.alias("summary"), F.array().cast("array<string>").alias("recommendations"))
    guessed = F.struct(
        tx.strip(F.array_join(F.slice(parts, 1, 4), ". ")).alias("summary"),
        F.when(F.size(bare) > 0, bare).otherwise(rest).alias("recommendations"),
    )
    return F.when(mark.isNotNull(), sectioned).when(F.size(parts) <= 4, whole).otherwise(guessed)


def split_responses(df: DataFrame, column: str) -> DataFrame:
    """Adds ``summary`` and ``recommendations``."""
    done = df.withColumn("_split", split_response(quoted_col(column)))
    return done.select("*", "_split.summary", "_split.recommendations").drop("_split")


def sanitize_summary(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    text = F.regexp_replace(text, STARRED_HEADING, "")
    text = F.regexp_replace(text, HASHED_HEADING, "")
    text = F.replace(F.replace(text, F.lit("**FINAL SUMMARY**"), F.lit("")), F.lit("FINAL SUMMARY"), F.lit(""))
    return tx.strip(text)


def column_samples(df: DataFrame, keys: list[str], columns: list[str], n: int = 6, profile: DataFrame | None = None,
                   seed: int = 1) -> DataFrame:
    """(column, samples): up to n values per column, from the profile where it has
    the column, else a seeded sample of the table."""
    safe = [f"_k{i}" for i in range(len(keys))]
    known = [] if profile is None else [
        r["column"] for r in profile.where(F.size("sample_values") > 0).select("column").collect()]
    rest = [c for c in columns if c not in known]
    parts = []
    if profile is not None:
        chosen = profile.where(F.col("column").isin(columns) & (F.size("sample_values") > 0))
        parts.append(chosen.select("column", F.slice("sample_values", 1, n).alias("samples")))
    if rest:
        keyed = df.select("*", *[quoted_col(k).alias(s) for k, s in zip(keys, safe)])
        cells = unpivoted(keyed, rest, safe).where("value is not null")
        sampled = sample_per_column(cells, n, safe, seed)
        parts.append(sampled.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("samples")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def report_facts(profile: DataFrame, sentiment: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """(section, ord, text): the content of a report in reading order.

    All inputs have one row per column, label or selected relation.
    """
    overview = profile.agg(F.max("n_rows").alias("rows"), F.count(F.lit(1)).alias("columns")).select(
        F.inline(F.array(
            F.struct(F.lit("overview").alias("section"), F.lit(1).alias("ord"),
                     F.format_string("Rows: %d", "rows").alias("text")),
            F.struct(F.lit("overview").alias("section"), F.lit(2).alias("ord"),
                     F.format_string("Columns: %d", "columns").alias("text")),
        ))
    )
    sample = F.coalesce(F.try_element_at("sample_values", F.lit(1)), F.lit("-"))
    columns = profile.select(
        F.lit("columns").alias("section"), (F.col("ordinal") + 1).alias("ord"),
        F.format_string("%s (%s): %s", "column", "dtype", sample).alias("text"),
    )
    out = overview.unionByName(columns)
    if sentiment is not None:
        line = F.format_string("%s: %d", "label", "n")
        ordered = sentiment.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "label", line.alias("text")))).alias("s"))
        out = out.unionByName(
            ordered.select(F.posexplode("s").alias("i", "r")).select(
                F.lit("sentiment").alias("section"), (F.col("i") + 1).alias("ord"), F.col("r.text").alias("text"))
        )
    if relations is not None:
        ordered = relations.agg(F.sort_array(F.collect_list(
            F.struct((-F.col("rank_score")).alias("m"), "seq", F.col("long").alias("text")))).alias("s"))
        out = out.unionByName(
            ordered.select(F.posexplode("s").alias("i", "r")).select(
                F.lit("relations").alias("section"), (F.col("i") + 1).alias("ord"), F.col("r.text").alias("text"))
        )
    return out
