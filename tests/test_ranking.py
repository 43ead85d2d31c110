import pytest
from pyspark.sql import functions as F

from tabloom.functions.sampling import sample_per_column, seeded_sample
from tabloom.operators import ranking as rk


@pytest.mark.parametrize("distinct", [10, None])
def test_lookup_with_hot_key(spark, distinct):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 700}") for i in range(5000)] + [(9999, None), (10000, "absent")]
    df = spark.createDataFrame(rows, "i int, k string")
    table = df.where("k is not null and k <> 'absent'").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    got = {r["i"]: r["top"] for r in rk.lookup(df, table, ["k"], ["top"], 5002, distinct).collect()}
    want = {r["k"]: r["top"] for r in table.collect()}
    assert len(got) == 5002
    assert all(got[i] == want.get(k) for i, k in rows)


def test_sample_is_exact_and_layout_independent(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    a = [r["k"] for r in seeded_sample(df.repartition(7), 50, ["k"], 1).collect()]
    b = [r["k"] for r in seeded_sample(df.coalesce(1), 50, ["k"], 1).collect()]
    want = [r["k"] for r in df.orderBy(F.md5(F.concat(F.lit("1:"), F.col("k").cast("string"))), "k").limit(50).collect()]
    assert a == b == want
    assert seeded_sample(df.limit(20), 50, ["k"], 1).count() == 20


def test_sample_with_repeated_keys_keeps_its_size(spark):
    df = spark.createDataFrame([(1, i) for i in range(2000)], "k int, i int")
    assert seeded_sample(df, 50, ["k"], 1).count() == 50
    long = df.select(F.lit("c").alias("column"), "k", F.col("i").cast("string").alias("value"))
    assert sample_per_column(long, 50, ["k"], 1).count() == 50


def records_read(spark, df):
    """Rows that each task of the last join reads."""
    return [len(rows) for rows in df.rdd.glom().collect()]


def test_lookup_spreads_hot_and_null_keys(spark, monkeypatch):
    """A third of the rows under one key and a third without a key: no task of the join gets much more than its share."""
    monkeypatch.setattr(rk, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(rk, "HOT_SHARE", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(i, ["hot", None, f"k{i}"][i % 3]) for i in range(12000)]
        df = spark.createDataFrame(rows, "i int, k string")
        table = df.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
        out = rk.lookup(df, table, ["k"], ["top"], 12000, None)
        sizes = records_read(spark, out)
        assert sum(sizes) == 12000 and max(sizes) <= 2 * 12000 / len(sizes)
        got = {r["i"]: r["top"] for r in out.collect()}
        assert all(got[i] == {"hot": 11997, None: None}.get(k, i) for i, k in rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
