"""Date layouts decided for a whole column.

A cell such as 03/04/2024 does not tell day from month, but its column usually does: somewhere a day is above 12.  So every
layout is tried on all cells in one scan, and the one that fits most cells parses the whole column; a cell that does not
fit it becomes null instead of being read in another layout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text as tx
from tabloom.operators.ranking import quoted_col

# Name, shape of the date, and layout; earlier ones win where as many cells fit (month before day).
LAYOUTS = (
    ("iso", tx.ISO_DATE, None),
    ("year/month/day", r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "yyyy/M/d"),
    ("month/day/year", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "M/d/yyyy"),
    ("day/month/year", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "d/M/yyyy"),
    ("month-day-year", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "M-d-yyyy"),
    ("day-month-year", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "d-M-yyyy"),
    ("day.month.year", r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", "d.M.yyyy"),
    ("day mon year", r"^[0-9]{1,2}[ -][A-Za-z]{3}[ -][0-9]{4}", "d MMM yyyy"),
    ("day month year", r"^[0-9]{1,2}[ -][A-Za-z]{3,9}[ -][0-9]{4}", "d MMMM yyyy"),
    ("mon day year", r"^[A-Za-z]{3} [0-9]{1,2},? [0-9]{4}", "MMM d yyyy"),
    ("month day year", r"^[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4}", "MMMM d yyyy"),
    ("compact", r"^(19|20)[0-9]{6}$", "yyyyMMdd"),
)
_NAMED = {name: (shape, layout) for name, shape, layout in LAYOUTS}
TIME = r"([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?\s*$"
# Endings of ordinal numbers.
ORDINAL = r"(?i)^(\D*[0-9]{1,2})(st|nd|rd|th)\b"


def parsed(c: Column, name: str) -> Column:
    """Timestamp (without zone) of a string cell in one layout, or null."""
    shape, layout = _NAMED[name]
    if layout is None:
        return F.when(c.rlike(shape), F.trim(c).try_cast("timestamp_ntz"))
    tidy = F.regexp_replace(F.trim(c), ORDINAL, "$1")
    if "MMM" in layout:  # months by name come with blanks, hyphens or a comma
        tidy = F.regexp_replace(F.regexp_replace(tidy, ",", ""), r"^([0-9]{1,2})-([A-Za-z]+)-", "$1 $2 ")
    shape = shape.replace(",?", "")
    fits = tidy.rlike(shape if shape.endswith("$") else shape + TIME)
    stamp = F.try_to_timestamp(F.regexp_replace(tidy, "(?<=[0-9])T(?=[0-9])", " "), F.lit(layout if shape.endswith("$") else layout + "[ H:mm[:ss]]"))
    return F.when(fits, stamp.cast("timestamp_ntz"))


@dataclass(frozen=True)
class Election:
    layout: str | None  # None: no cell fits any layout
    fitting: int
    non_null: int

    @property
    def share(self) -> float:
        return self.fitting / self.non_null if self.non_null else 0.0


def elect(df: DataFrame, columns: list[str]) -> dict[str, Election]:
    """The layout of each string column; all columns and layouts in one scan, one row comes back."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        x = quoted_col(c)
        aggs += [F.count(x).alias(f"n{i}"), *[F.count(parsed(x, name)).alias(f"f{i}_{k}") for k, (name, _, _) in enumerate(LAYOUTS)]]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        counts = [row[f"f{i}_{k}"] for k in range(len(LAYOUTS))]
        best = max(counts)
        out[c] = Election(LAYOUTS[counts.index(best)][0] if best else None, best, row[f"n{i}"])
    return out


def to_timestamps(df: DataFrame, columns: list[str], threshold: float = 0.8) -> DataFrame:
    """Columns of which over ``threshold`` of the cells fit one layout become timestamps; the others stay."""
    found = elect(df, columns)
    fixes = {c: parsed(quoted_col(c), e.layout) for c, e in found.items() if e.layout and e.share > threshold}
    return df.withColumns(fixes) if fixes else df
