import pytest
from pyspark.sql import functions as F

from tabloom.operators import features as ft


def test_zscore_and_median(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (None, 3.0), (9.0, 3.0)], "`a.b` double, n double")
    filled = ft.median_fill(df, ["a.b", "n"])
    assert sorted(r[0] for r in filled.collect()) == [1.0, 2.0, 2.0, 9.0]
    out = ft.zscores(filled, ["a.b", "n"])
    row = out.agg(F.avg("`a.b_z`").alias("m"), F.stddev_pop("`a.b_z`").alias("s"), F.max("n_z").alias("z")).first()
    assert row["m"] == pytest.approx(0) and row["s"] == pytest.approx(1) and row["z"] == 0.0


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "g string")
    mapping = ft.label_mapping(df, ["g"])
    assert mapping == {"g": ["a", "b", "nan"]}
    assert sorted((r["g"] or "~", r["g_encoded"]) for r in ft.label_encode(df, mapping).collect()) == [
        ("a", 0), ("b", 1), ("b", 1), ("~", 2)]
    freq = {r["g"]: r["g_freq"] for r in ft.frequency_encode(df, ["g"]).collect()}
    assert freq == {"b": 0.5, "a": 0.25, None: 0.25}
    many = spark.range(31).select(F.col("id").cast("string").alias("g"))
    assert ft.label_mapping(many, ["g"]) == {"g": None}


def test_duplicates_compare_by_value(spark):
    df = spark.createDataFrame([(1, 1.0, "1", 1, 2), (2, 2.0, "2", 2, 3), (None, None, None, None, 4)],
                               "a int, b double, c string, d long, e int")
    assert ft.duplicate_columns(df) == [("b", "a"), ("d", "a")]
    assert ft.duplicate_columns(df, {"d"}) == [("b", "a")]
    assert ft.drop_duplicate_columns(df).columns == ["a", "c", "e"]


def test_datetime_edges(spark):
    df = spark.createDataFrame([("2024-01-06 00:00:00",), ("2024-01-07 23:59:59",), ("2024-01-08",), (None,)], "t string")
    rows = ft.datetime_parts(df, ["t"]).collect()
    assert [r["t_is_weekend"] for r in rows] == [1, 1, 0, 0]
    assert [r["t_weekday"] for r in rows] == [5, 6, 0, None]
    assert [r["t_hour"] for r in rows] == [0, 23, 0, None]


def test_row_meta_counts_features(spark):
    df = spark.createDataFrame([("http x", None), (None, "y")], "a string, b string")
    out = ft.row_meta(ft.text_features(df, ["a", "b"]), ["a", "b"]).collect()
    assert [(r["n_missing"], r["n_text_cols_nonempty"], r["has_urls"]) for r in out] == [(1, 1, 1), (1, 1, 0)]


def test_average_sentiment_skips_nulls(spark):
    df = spark.createDataFrame([(2, None), (0, 1), (None, None)], "a_sentiment_num int, b_sentiment_num int")
    assert [r[2] for r in ft.average_sentiment(df).collect()] == [2.0, 0.5, None]


def test_lineage_order():
    kinds = {"t": "text", "x": "numeric", "g": "categorical", "d": "datetime"}
    columns = ["t", "x", "g", "d", "x_z", "g_freq", "d_year", "d_hour", "t_word_count", "t_sentiment", "t_sentiment_num"]
    assert ft.lineage(columns, kinds) == [
        ("t", "t_word_count", 0), ("t", "t_sentiment", 1), ("t", "t_sentiment_num", 2), ("x", "x_z", 0),
        ("g", "g_freq", 0), ("d", "d_year", 0), ("d", "d_hour", 1)]


def test_engineer_keeps_rows_and_targets(spark):
    df = spark.createDataFrame(
        [(i, f"g{i % 3}", f"text number {i} here" + " and" * (i % 4), i % 2) for i in range(40)], "x int, g string, t string, y int")
    out, meta = ft.engineer(df, {"x": "numeric", "g": "categorical", "t": "text"}, ["y"])
    assert out.count() == 40 and not any(c.startswith("y_") for c in out.columns)
    kept, meta = ft.prune(out, meta, ["y"])
    assert "t_has_url" not in kept.columns and "has_urls" not in kept.columns  # constant
    assert {p for p, _, _ in meta["lineage"]} == {"x", "g", "t"}
