"""Text expressions.  All are built-in Columns, so they stay in the JVM.

Whitespace is ASCII (``\\s`` without the Unicode flag): a non-breaking space is
part of a word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the text cleaner and of the flags.
URL_RUN = r"http\S+|www\S+"
NOT_PLAIN_RUN = r"[^a-zA-Z0-9\s.,?!\-'\"]+"
URL_FLAG = "http|www"
EMOJI_FLAG = r"[\x{1F600}-\x{1F64F}]"

# What counts as a missing cell when a CSV is read.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
PLAIN_DECIMAL = r"^[0-9]+(\.[0-9]+)?$"
ISO_DATE = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?$"

# Non-ISO layouts tried in this order, each behind its own guard pattern.
OTHER_DATES = (
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "d MMM yyyy"),
    (r"^[0-9]{1,2} [A-Za-z]{4,9} [0-9]{4}$", "d MMMM yyyy"),
)

EDGE_SPACE = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def words(c: Column) -> Column:
    """Whitespace-separated words; null text has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"\s+"), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def clean_text(c: Column) -> Column:
    """Drop URLs, blank out symbols, squeeze whitespace; null gives ''."""
    no_urls = F.regexp_replace(F.coalesce(c, F.lit("")), URL_RUN, "")
    plain = F.regexp_replace(no_urls, NOT_PLAIN_RUN, " ")
    return strip(F.regexp_replace(plain, r"\s+", " "))


def unique_word_ratio(c: Column) -> Column:
    w = words(c)
    return F.size(F.array_distinct(w)) / F.greatest(F.lit(1), F.size(w))


def url_flag(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(URL_FLAG).cast("int")


def emoji_flag(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(EMOJI_FLAG).cast("int")


def upper_ratio(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    return capitals / F.greatest(F.lit(1), F.length(text))


def token_hits(c: Column, vocabulary) -> Column:
    """How many tokens of the text, stripped of edge punctuation, are listed.

    One regular expression instead of split/transform/filter: a token is a run
    between whitespace, and the look-arounds pin both of its ends.
    """
    if not vocabulary:
        return F.lit(0)
    listed = "|".join(sorted({quote(w.lower()) for w in vocabulary}))
    token = rf"(?<!\S)[.,!?'\"]*(?:{listed})[.,!?'\"]*(?!\S)"
    return F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(token))


def quote(word: str) -> str:
    """The word as a literal inside a regular expression."""
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in word)


def as_number(c: Column) -> Column:
    """Number of a string cell, or null.  The guard keeps Java-only spellings
    such as ``1d`` out."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def timestamp_sql(x: str) -> str:
    """SQL expression: timestamp (without zone) of a string cell, or null."""
    literal = lambda t: "r'" + t + "'"
    tried = [f"CASE WHEN {x} RLIKE {literal(ISO_DATE)} THEN try_cast(trim({x}) AS TIMESTAMP_NTZ) END"]
    for guard, layout in OTHER_DATES:
        tried.append(
            f"CASE WHEN {x} RLIKE {literal(guard)} THEN CAST(try_to_timestamp({x}, '{layout}') AS TIMESTAMP_NTZ) END")
    return f"coalesce({', '.join(tried)})"


def as_timestamp(name: str) -> Column:
    """Timestamp of the named string column, or null."""
    return F.expr(timestamp_sql("`" + name.replace("`", "``") + "`"))


def value_key(c: Column) -> Column:
    """A short stand-in for a long string: itself up to 64 characters, else its
    SHA-256.  Lets distinct counts and joins shuffle 64 bytes per text."""
    return F.when(F.length(c) > 64, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)


def prettify(c: Column) -> Column:
    """Underscores to spaces, then a capital after every non-letter."""
    spaced = strip(F.regexp_replace(c, "_", " "))
    runs = F.regexp_extract_all(spaced, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    titled = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))))
    return F.array_join(titled, "")
