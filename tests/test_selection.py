import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from tabloom.operators import classify, ranking, selection
from tabloom.operators import charts as ch


def doubles(n=400, seed=3):
    """All sizes of numbers, whole ones, powers of two with their neighbours, and the smallest ones."""
    r = random.Random(seed)
    out = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, 1.0, -1.0]
    while len(out) < n:
        x = struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0]
        out += [x] if math.isfinite(x) else []
        p = 2.0 ** r.randint(-1070, 1020)
        out += [p, math.nextafter(p, math.inf), math.nextafter(p, -math.inf), float(r.randint(-10**6, 10**6))]
    return out


def test_images_keep_the_order(spark):
    xs = doubles()
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r["x"]: r["i"] for r in selection.with_image(df, "x", "i").collect()}
    order = sorted(set(xs))
    images = [got[x] for x in order]
    assert images == sorted(set(images)), "images must grow with the values"
    # neighbours that differ in their last bit have images that differ by one
    assert got[math.nextafter(1.0, 2.0)] - got[1.0] == 1 if math.nextafter(1.0, 2.0) in got else True


def skewed(n=3000, seed=3):
    r = random.Random(seed)
    return [5.0 if r.random() < 0.34 else (round(r.gauss(5, 3), 1) if r.random() < 0.5 else r.gauss(5, 30)) for _ in range(n)]


@pytest.mark.parametrize("bits, limit", [(10, 200_000), (4, 0), (10, 40)])
def test_quantiles(spark, monkeypatch, bits, limit):
    """Also with digits of four bits, so that the descent is deep, and with intervals joined by a shuffle."""
    monkeypatch.setattr(selection, "DIGIT_BITS", bits)
    monkeypatch.setattr(selection, "FEW_ROWS", limit // 2)
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", limit)
    xs = skewed(999)
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)] * 5 + [(float("nan"),)], "n double")
    row = selection.quantiles(df, "n", [0.25, 0.5, 0.75]).first()
    assert [row["q0"], row["q1"], row["q2"]] == pytest.approx(statistics.quantiles(xs, n=4, method="inclusive"), abs=1e-12)
    assert row["n"] == 999


def test_quantiles_over_all_sizes_of_numbers(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW_ROWS", 0)
    xs = [x for x in doubles(300) if math.isfinite(x)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(3)
    row = selection.quantiles(df, "x", [0.0, 0.5, 1.0]).first()
    assert row["q0"] == min(xs) and row["q2"] == max(xs) and row["q1"] == pytest.approx(statistics.median(xs))


def test_quantiles_per_group(spark):
    rows = [("a.b", float(i)) for i in range(11)] + [("z", 1.0), ("z", 2.0), ("none", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "`g.x` string, v double")
    got = {r["g.x"]: (r["n"], r["q0"]) for r in selection.quantiles(df, "v", [0.5], ["g.x"]).collect()}
    assert got == {"a.b": (11, 5.0), "z": (2, 1.5)}
    assert selection.quantiles(df.limit(0), "v", [0.5], ["g.x"]).count() == 0


def test_what_a_pass_shuffles_does_not_depend_on_the_values(spark):
    """Two tables of one size, one of few and one of all distinct values, in as many digits."""
    def digits(expr):
        rows = spark.range(200_000).select(F.lit(0).alias("g"), F.expr(expr).cast("double").alias("v"))
        rows = selection.with_image(rows, "v", "i")
        ends = selection.ends(rows, ["g"], "i", "v").withColumns({"rank": F.lit(77), "left": F.lit(77)})
        met = rows.join(F.broadcast(ends.select("g", "lo", "hi")), "g").select(selection._digit("i").alias("d"))
        return met.distinct().count()

    assert digits("1 + id") <= 1 << selection.DIGIT_BITS
    assert digits("1 + id % 1000000 / 7") <= 1 << selection.DIGIT_BITS


@pytest.mark.parametrize("limit", [200_000, 0])
def test_box_of_a_hot_category(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", limit)
    xs = {"hot": skewed(900), "x": [1.0, 2.0, 3.0, 100.0], "flat": [4.0] * 9}
    df = spark.createDataFrame([(k, v) for k, vs in xs.items() for v in vs], "c string, v double").repartition(4)
    for r in ch.box_stats(df, "v", "c").collect():
        vs = sorted(xs[r["label"]])
        q = statistics.quantiles(vs, n=4, method="inclusive")
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx(q) and r["n"] == len(vs)
        inside = [v for v in vs if q[0] - 1.5 * (q[2] - q[0]) <= v <= q[2] + 1.5 * (q[2] - q[0])]
        assert r["low_whisker"] == pytest.approx(min(inside[0], q[0])) and r["high_whisker"] == pytest.approx(max(inside[-1], q[2]))


@pytest.mark.parametrize("bits", [10, 6])
def test_split_deepens_where_a_class_is_large(spark, monkeypatch, bits):
    """Digits of six bits force ten passes; the parts are those of a full sort."""
    monkeypatch.setattr(selection, "DIGIT_BITS", bits)
    monkeypatch.setattr(selection, "FEW_ROWS", 100 - 10 * bits)
    rows = [(i, "hot" if i % 10 else "rare") for i in range(1500)] + [(5000, "one"), (5001, None)]
    df = spark.createDataFrame(rows, "k int, y string").repartition(5)
    got = classify.stratified_split(df, "y", ["k"])
    parts = {r["k"]: r["part"] for r in got.collect()}
    import hashlib

    for y in ("hot", "rare", "one"):
        keys = sorted((hashlib.md5(f"42:{k}".encode()).hexdigest(), k) for k, v in rows if v == y)
        want = {k for _, k in keys[:int(len(keys) * 0.2 + 0.5)]}
        assert {k for _, k in keys if parts[k] == "test"} == want
    assert parts[5001] is None


def test_split_of_repeated_keys(spark):
    """Rows of one key fall on one side together."""
    df = spark.createDataFrame([(i % 3, "a") for i in range(300)], "k int, y string")
    got = classify.stratified_split(df, "y", ["k"]).groupBy("k").agg(F.count_distinct("part").alias("n")).collect()
    assert [r["n"] for r in got] == [1, 1, 1]
