import math
import random

import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from tabloom.operators import relations as rl
from tabloom.operators import stats


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        g = "hot" if r.random() < 0.4 else f"g{r.randrange(6)}"
        x = r.gauss(0, 1) + (2 if g == "hot" else 0)
        rows.append((i, x, math.exp(x), 2024.0, g, "u" if x > 1 else "v", None if r.random() < 0.2 else x))
    return spark.createDataFrame(rows, "k int, x double, up double, flat double, g string, h string, holey double")


def test_spearman_is_rank_based(spark, frame):
    got = {(r["a"], r["b"]): r for r in stats.spearman(frame, [("x", "up"), ("x", "flat"), ("holey", "up")]).collect()}
    assert got[("x", "up")]["r"] == pytest.approx(1.0)
    assert got[("x", "flat")]["r"] is None
    assert got[("holey", "up")]["r"] == pytest.approx(1.0) and got[("holey", "up")]["n"] < 400


def average_ranks(xs):
    order, first, last = sorted(xs), {}, {}
    for i, v in enumerate(order, 1):
        first.setdefault(v, i)
        last[v] = i
    return [(first[v] + last[v]) / 2 for v in xs]


def plain_spearman(rows, a, b):
    both = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None and r[a] == r[a] and r[b] == r[b]]
    x, y = average_ranks([p[0] for p in both]), average_ranks([p[1] for p in both])
    mx, my = sum(x) / len(x), sum(y) / len(y)
    cov = sum((p - mx) * (q - my) for p, q in zip(x, y))
    return len(both), cov / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))


@pytest.mark.parametrize("limit", [200_000, 100, 0])
def test_ranks_of_all_columns_by_broadcast_and_by_cells(spark, monkeypatch, limit):
    """Three patterns of missing values, a value that a third of the rows hold, ties, NaN, and infinite values."""
    monkeypatch.setattr(stats, "BROADCAST_ROWS", limit)
    r = random.Random(9)
    rows = []
    for i in range(900):
        x = 5.0 if i % 3 == 0 else r.gauss(0, 9)
        rows.append({"a": x, "b": round(x + r.gauss(0, 5)), "c": None if i % 4 == 0 else x * r.random(), "d": float("nan") if i % 5 == 0 else r.random(),
                     "e.f": math.inf if i % 50 == 0 else -x})
    one_large = [("b", "a")]
    df = spark.createDataFrame([tuple(v.values()) for v in rows], "a double, b int, c double, d double, `e.f` double").repartition(4)
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("a", "d"), ("a", "e.f")]
    got = {(x["a"], x["b"]): (x["n"], x["r"]) for x in stats.spearman(df, pairs).collect()}
    for p in pairs:
        n, rho = plain_spearman(rows, *p)
        assert got[p][0] == n and got[p][1] == pytest.approx(rho, abs=1e-12), p
    # of two columns, one may have too many values for a broadcast
    assert stats.spearman(df, one_large).first()["r"] == pytest.approx(plain_spearman(rows, "b", "a")[1], abs=1e-12)


def test_all_families_share_one_pass(spark, frame):
    """One exchange counts the cells of all families; ranks come back to the rows without another one."""
    found = stats.measure(frame, [("x", "up"), ("holey", "x")], [("x", "g"), ("up", "h")], [("g", "h")])
    assert len(found.slots) == 4
    assert stats.spearman_of(found, [("x", "up"), ("holey", "x")])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0
    assert {r["pair"] for r in stats.anova_of(found, [("x", "g"), ("up", "h")]).collect()} == {0, 1}
    assert stats.cramers_of(found, [("g", "h")]).first()["complete"] == 400


def test_pearson_constant_is_null(spark, frame):
    rows = {(r["a"], r["b"]): r["r"] for r in stats.pearson(frame, [("x", "flat"), ("x", "up")]).collect()}
    assert rows[("x", "flat")] is None and 0 < rows[("x", "up")] < 1


def test_cramers_matches_ml_test(spark, frame):
    row = stats.cramers_v(frame, [("g", "h")]).first()
    coded = StringIndexer(inputCols=["g", "h"], outputCols=["gi", "hi"]).fit(frame).transform(frame)
    ml = ChiSquareTest.test(VectorAssembler(inputCols=["gi"], outputCol="f").transform(coded), "f", "hi").first()
    assert row["chi2"] == pytest.approx(ml["statistics"][0])
    assert row["dof"] == ml["degreesOfFreedom"][0]
    assert (row["r_levels"], row["c_levels"]) == (7, 2)
    assert row["effect"] == pytest.approx(math.sqrt(row["chi2"] / 400))
    computed = rl.compute(frame, [("g", "h", "g", "h")], {"g": "categorical", "h": "categorical"}).first()
    assert computed["p_value"] == pytest.approx(ml["pValues"][0], rel=1e-9)


def test_anova_against_definition(spark, frame):
    rows = [(r["g"], r["x"]) for r in frame.collect()]
    mean = sum(x for _, x in rows) / len(rows)
    groups = {}
    for g, x in rows:
        groups.setdefault(g, []).append(x)
    between = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in groups.values())
    total = sum((x - mean) ** 2 for _, x in rows)
    row = stats.anova(frame, [("x", "g")]).first()
    assert row["effect"] == pytest.approx(between / total)
    assert row["groups"] == 7 and row["df1"] == 6 and row["df2"] == 393


def test_anova_every_row_its_own_group(spark):
    df = spark.createDataFrame([(float(i), f"g{i}") for i in range(20)], "y double, g string")
    row = stats.anova(df, [("y", "g")]).first()
    assert row["effect"] == pytest.approx(1.0) and row["f"] is None


def test_null_is_a_level(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")] * 10, "p string, q string")
    row = stats.cramers_v(df, [("p", "q")]).first()
    assert row["effect"] == pytest.approx(1.0) and row["c_levels"] == 2


def test_bh_properties(spark):
    ps = [0.01, 0.04, 0.03, None, 0.03, 1.0, 0.0, 0.6]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p_value double")
    got = {r["i"]: (r["adjusted_p_value"], r["significant_fdr"]) for r in stats.benjamini_hochberg(df).collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    m, best, want = len(known), 1.0, {}
    for rank in range(m, 0, -1):
        p, i = known[rank - 1]
        best = min(best, p * m / rank)
        want[i] = best
    assert got[3] == (None, False)
    for i, adj in want.items():
        assert got[i][0] == pytest.approx(adj) and got[i][0] >= ps[i] and got[i][1] == (adj <= 0.05)


def test_hour_needs_ten_rows(spark):
    df = spark.range(9).select(F.col("id").cast("double").alias("v"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, id)").alias("t"))
    assert stats.spearman_time_hour(df, [("v", "t")]).first()["r"] is None
    more = spark.range(12).select(F.col("id").cast("double").alias("v"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, id)").alias("t"))
    assert stats.spearman_time_hour(more, [("v", "t")]).first()["r"] == pytest.approx(1.0)
