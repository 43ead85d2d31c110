"""Keyword automaton, date layouts, stored sketches, recoded columns."""

import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions.keywords import first_match
from tabloom.operators import features as ft
from tabloom.operators import layouts as ly
from tabloom.operators import sketches as sk


def plain_first(text, rules, default):
    return next((a for k, a in rules if k in (text or "")), default)


def test_first_match_against_plain_search(spark):
    """Overlapping keywords, prefixes of each other in both orders, repeated ones, and characters with a meaning in patterns."""
    r = random.Random(6)
    words = ["ab", "abc", "b", "bca", "cab", "a.b", "a*", "[x]", "é", "été", "\U0001F600", "日本", "日", "ca", "aaa", "ab", "x-y", "^", "]", "\\"]
    texts = ["".join(r.choices(["a", "b", "c", ".", "*", "[x]", "é", "t", "\U0001F600", "日", "本", "x-y", "\n", "^", "]", "\\"], k=r.randint(0, 8))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for _ in range(8):
        rules = [(w, f"{w}!{k}") for k, w in enumerate(r.sample(words, 12))]
        got = {x["i"]: x["a"] for x in df.select("i", first_match(F.col("t"), rules, "none").alias("a")).collect()}
        assert got == {i: plain_first(t, rules, "none") for i, t in enumerate(texts)}
    rules = [("zz", "1"), ("", "2"), ("a", "3")]
    assert {x["a"] for x in df.select(first_match(F.col("t"), rules, "none").alias("a")).collect()} == {"2"}
    assert df.select(first_match(F.col("t"), [], "none").alias("a")).first()["a"] == "none"


@pytest.mark.parametrize("cells, layout, first", [
    (["03/04/2024", "13/04/2024", "01/02/2023"], "day/month/year", "2024-04-03 00:00:00"),
    (["03/04/2024", "04/13/2024", "01/02/2023"], "month/day/year", "2024-03-04 00:00:00"),
    (["03/04/2024", "01/02/2023"], "month/day/year", "2024-03-04 00:00:00"),
    (["22nd September 2024", "1st May 2023", "3rd March 2024"], "day month year", "2024-09-22 00:00:00"),
    (["Sep 2, 2024 13:05", "May 1 2023"], "mon day year", "2024-09-02 13:05:00"),
    (["2-Jan-2024", "3-Feb-2023"], "day mon year", "2024-01-02 00:00:00"),
    (["20240131", "20231201"], "compact", "2024-01-31 00:00:00"),
    (["1.2.2024T01:02:03", "3.4.2024"], "day.month.year", "2024-02-01 01:02:03"),
    (["2024-01-31T10:00:00", "2024-02-01"], "iso", "2024-01-31 10:00:00"),
])
def test_layout_of_a_column(spark, cells, layout, first):
    df = spark.createDataFrame([(c,) for c in [*cells, None, "n/a"]], "`a.b` string")
    found = ly.elect(df, ["a.b"])["a.b"]
    assert (found.layout, found.fitting, found.non_null) == (layout, len(cells), len(cells) + 1)
    got = ly.to_timestamps(df, ["a.b"], 0.5)
    assert [str(r[0]) for r in got.collect()][0] == first and got.where("`a.b` is null").count() == 2


def test_columns_that_are_no_dates_stay(spark):
    df = spark.createDataFrame([("x", None), ("13/13/2024", None), ("1", None)], "a string, b string")
    assert ly.elect(df, ["a", "b"]) == {"a": ly.Election(None, 0, 3), "b": ly.Election(None, 0, 0)}
    assert ly.to_timestamps(df, ["a", "b"]).dtypes == df.dtypes and ly.elect(df, []) == {}


def test_sketches_of_parts_stand_for_the_table(spark):
    df = spark.range(30_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 9000).cast("string").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    stored = sk.column_sketches(df, ["a", "b"], F.col("day"))
    assert stored.count() == 14
    got = {r["column"]: r for r in sk.estimated(sk.merged(stored)).collect()}
    assert got["a"]["n_unique"] == pytest.approx(9000, rel=sk.ERROR) and got["b"]["n_unique"] == pytest.approx(15_000, rel=sk.ERROR)
    assert (got["a"]["non_null"], got["b"]["non_null"], got["a"]["n_rows"]) == (30_000, 15_000, 30_000)
    whole = {r["column"]: r["n_unique"] for r in sk.estimated(sk.column_sketches(df, ["a", "b"])).collect()}
    assert whole == pytest.approx({c: r["n_unique"] for c, r in got.items()}, rel=0.02)
    assert sk.estimated(sk.merged(stored, ["part"])).count() == 14


def test_recoded_columns(spark):
    rows = [(i, f"g{i % 5}", i % 5 * 10, i % 5 // 4, None if i % 5 == 2 else str(i % 5), 1, None) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, label string, code int, coarse int, holey string, flat int, nothing string")
    assert set(ft.recoded_columns(df)) == {("code", "label"), ("holey", "label"), ("holey", "code")}
    # one row that breaks the mapping is seen
    odd = df.union(spark.createDataFrame([(999, "g0", 10, 0, "0", 1, None)], df.schema))
    assert set(ft.recoded_columns(odd)) == {("holey", "label")}
    assert ft.recoded_columns(df, ["k", "label"], limit=100) == []
