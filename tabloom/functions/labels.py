"""Sentiment label vocabulary and its numeric codes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings recognised by the three label mappings.
EXISTING_LABEL = "^(positive|negative|neutral|pos|neg|neu)$"
NORMALIZE = {
    "positive": ("positive", "pos", "+", "+1"),
    "neutral": ("neutral", "neu", "n", "0"),
    "negative": ("negative", "neg", "-", "-1"),
}
CANONICAL = {
    "positive": ("positive", "pos", "p", "+", "+1", "label_2", "2"),
    "neutral": ("neutral", "neu", "n", "0", "label_1", "1"),
    "negative": ("negative", "neg", "-", "-1", "label_0", "0"),
}
CODES = {"negative": 0, "neutral": 1, "positive": 2}
DISPLAY = {
    "0": "Negative", "1": "Neutral", "2": "Positive",
    "negative": "Negative", "neutral": "Neutral", "positive": "Positive",
}


def _folded(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def _first_match(key: Column, table: dict) -> Column:
    out = F.lit(None).cast("string")
    for label, spellings in reversed(list(table.items())):
        out = F.when(key.isin(*spellings), F.lit(label)).otherwise(out)
    return out


def is_label(c: Column) -> Column:
    return _folded(c).rlike(EXISTING_LABEL)


def canonical_label(c: Column) -> Column:
    """Canonical label or null.  '0' is neutral because neutral is listed first."""
    return _first_match(_folded(c), CANONICAL)


def normalize_label(c: Column) -> Column:
    return F.coalesce(_first_match(_folded(c), NORMALIZE), F.lit("neutral"))


def label_code(label: Column) -> Column:
    out = F.lit(1)
    for name, code in CODES.items():
        out = F.when(label == name, F.lit(code)).otherwise(out)
    return out


def existing_label_code(c: Column) -> Column:
    """0/1/2 for an existing label column; anything unknown is neutral."""
    key = _folded(c)
    return (
        F.when(key.isin("positive", "pos"), 2)
        .when(key.isin("negative", "neg"), 0)
        .otherwise(1)
    )


def display_label(c: Column) -> Column:
    key = c.cast("string")
    out = key
    for raw, shown in DISPLAY.items():
        out = F.when(key == raw, F.lit(shown)).otherwise(out)
    return out
