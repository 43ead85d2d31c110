import pytest
from pyspark.sql import functions as F

from tabloom.operators import charts as ch
from tabloom.operators import responses as rs

TEXTS = {
    "section": "All fine.\nRecommendations:\n- do this\n* and that\n1. number one\n2) two. done\nplain\n\n",
    "lower": "Sum.\nrecommendations\n1) no dot here",
    "mentioned": "I recommend nothing. B. C. D",
    "loose": "One. Two. Three. Four. Five\n- bullet a\n3. third",
    "rest": "One. Two. Three. Four. Five left\nmore",
    "short": "Only one. Two",
    "empty": "",
    "null": None,
}


def test_split(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "k string, t string")
    got = {r["k"]: (r["summary"], r["recommendations"]) for r in rs.split_responses(df, "t").collect()}
    assert got["section"] == ("All fine.", [":", "do this", "and that", "number one", "done", "plain"])
    assert got["lower"] == ("Sum.", ["1) no dot here"])
    assert got["mentioned"] == ("I recommend nothing. B. C. D", [])
    assert got["loose"] == ("One. Two. Three. Four", ["bullet a", "third"])
    assert got["rest"] == ("One. Two. Three. Four", ["Five left", "more"])
    assert got["short"] == ("Only one. Two", [])
    assert got["empty"] == ("", []) and got["null"] == ("", [])


@pytest.mark.parametrize("raw, want", [
    ("**Final Summary**: text", "text"), ("## final summary\ntext", "text"), ("text FINAL SUMMARY end", "text  end"),
    ("intro\n  final summary - x", "intro\nx"), (None, ""), ("summary only", "summary only")])
def test_sanitize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(rs.sanitize_summary(F.col("t"))).first()[0] == want


def test_daily_gap_days(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", 1.0), ("2024-01-01 11:00:00", 3.0), ("2024-01-04 00:00:00", 5.0), (None, 9.0)],
                               "t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = [(str(r["day"]), r["mean"]) for r in ch.daily_mean(df, "t", "v").orderBy("day").collect()]
    assert got == [("2024-01-01", 2.0), ("2024-01-02", None), ("2024-01-03", None), ("2024-01-04", 5.0)]


def test_box_whiskers_ignore_outliers(spark):
    df = spark.createDataFrame([(float(v), "g") for v in (1, 2, 3, 4, 100)] + [(7.0, None)], "v double, c string")
    got = {r["label"]: r for r in ch.box_stats(df, "v", "c").collect()}
    assert (got["g"]["low_whisker"], got["g"]["median"], got["g"]["high_whisker"], got["g"]["n"]) == (1.0, 3.0, 4.0, 5)
    assert got["__MISSING__"]["median"] == 7.0


def test_heatmap_limit(spark):
    df = spark.createDataFrame([(f"a{i:02d}", f"b{i % 2}") for i in range(40)], "a string, b string")
    assert ch.crosstab_heatmap(df, "a", "b").count() == 30
