import math

import pytest
from pyspark.sql import functions as F

from tabloom.functions import labels as lb
from tabloom.functions import special as sp
from tabloom.functions import text as tx
from tabloom.operators import relations as rl


def values(spark, rows, expr, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], schema).select(expr).collect()]


def test_text_edges(spark):
    rows = [None, "", "   ", "a a b", "HELLO", "see http://x.y and www", "smile \U0001F600", "ÀÉ b", "one two three"]
    c = F.col("v")
    assert values(spark, rows, tx.word_count(c)) == [0, 0, 0, 3, 1, 4, 2, 2, 2]
    assert values(spark, rows, tx.unique_word_ratio(c))[3] == pytest.approx(2 / 3)
    assert values(spark, rows, tx.url_flag(c)) == [0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert values(spark, rows, tx.emoji_flag(c)) == [0, 0, 0, 0, 0, 0, 1, 0, 0]
    upper = values(spark, rows, tx.upper_ratio(c))
    assert upper[:2] == [0, 0] and upper[4] == 1 and upper[7] == pytest.approx(0.5)
    assert values(spark, rows, tx.clean_text(c)) == [
        "", "", "", "a a b", "HELLO", "see and www", "smile", "b", "one two three"]


def test_numbers_and_dates(spark):
    assert values(spark, ["1", "1d", " 2.5 ", "1e3", "x", None, ".5", "-3"], tx.as_number(F.col("v"))) == [
        1.0, None, 2.5, 1000.0, None, None, 0.5, -3.0]
    found = values(spark, ["2024-01-05", "2024-13-01", "12345", "01/31/2024", "31/01/2024", "5 Mar 2024", "noise"],
                   tx.as_timestamp("v").cast("string"))
    assert found == ["2024-01-05 00:00:00", None, None, "2024-01-31 00:00:00", "2024-01-31 00:00:00", "2024-03-05 00:00:00", None]


def test_labels(spark):
    rows = [" Positive ", "+1", "1", "0", "LABEL_0", "-", "meh", None, "neu"]
    assert values(spark, rows, lb.canonical_label(F.col("v"))) == [
        "positive", "positive", "neutral", "neutral", "negative", "negative", None, None, "neutral"]
    assert values(spark, rows, lb.normalize_label(F.col("v"))) == [
        "positive", "positive", "neutral", "neutral", "neutral", "negative", "neutral", "neutral", "neutral"]
    assert values(spark, ["POS", "neg", " positive ", "x", None], lb.existing_label_code(F.col("v"))) == [2, 0, 2, 1, 1]


def test_token_hits_match_python(spark):
    vocabulary = ("good", "bad")
    rows = ["good, bad! (good)", "'Good' goodness bad?!", "good\nbad good", "", None, "good.bad", "...good..."]

    def slow(t):
        tokens = [w.lower().strip(".,!?'\"") for w in (t or "").split()]
        return sum(w in vocabulary for w in tokens)

    assert values(spark, rows, tx.token_hits(F.col("v"), vocabulary)) == [slow(t) for t in rows]


def test_prettify(spark):
    rows = ["review_rating", "Ratings(10)", "a-b", "o'neil", "_x_", "ALL CAPS 3d"]
    assert values(spark, rows, tx.prettify(F.col("v"))) == [r.replace("_", " ").strip().title() for r in rows]


def test_three_digits(spark):
    rows = [0.0, 1e-5, 0.0001234, 0.04996, 0.5, 0.9996, 1.0, 3.2e-120, 9.996e-6, 0.1, 1e-4]
    got = values(spark, rows, rl.three_digits(F.col("v")), "v double")
    assert got == [f"{r:.3g}" for r in rows]


def test_tail_probabilities():
    # textbook critical values
    assert sp.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert sp.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert sp.f_upper(4.103, 2, 10) == pytest.approx(0.05, abs=1e-4)
    assert sp.f_upper(2.711, 5, 20) == pytest.approx(0.05, abs=1e-4)
    assert sp.chi2_upper(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert sp.chi2_upper(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    # the large-sample forms join smoothly
    assert sp.t_two_sided(1.5, 9.9e6) == pytest.approx(sp.t_two_sided(1.5, 1.1e7), rel=1e-5)
    assert sp.f_upper(2.0, 3, 9.9e6) == pytest.approx(sp.f_upper(2.0, 3, 1.1e7), rel=1e-5)


def test_chi2_against_numeric_integration():
    def density(x, k):
        return math.exp((k / 2 - 1) * math.log(x) - x / 2 - math.lgamma(k / 2) - k / 2 * math.log(2))

    for k, x in ((3, 2.5), (8, 3.9316), (20, 31.4)):
        step = 0.0005
        tail = sum(density(x + (i + 0.5) * step, k) * step for i in range(int(200 / step)))
        assert sp.chi2_upper(x, k) == pytest.approx(tail, rel=1e-4)


def test_p_values_of_degenerate_tests():
    assert sp.p_value("r", 1.0, 10, None) == 0.0
    assert sp.p_value("r", None, 10, None) is None
    assert sp.p_value("f", math.inf, 2, 5) == 0.0
    assert sp.p_value("f", 1.0, 2, 0) is None
    assert sp.p_value("chi2", 0.0, 0, None) == 1.0


def test_tails_far_out():
    for a in (1e5, 1e7, 5e9, 5e11, 1e12):
        assert abs(sp.gamma_upper(a, a) - 0.5) < 0.5 / math.sqrt(a)
    assert sp.gamma_upper(99_999.0, 100_300.0) == pytest.approx(sp.gamma_upper(100_001.0, 100_302.0), rel=1e-4)
    for df in (1e5, 1e7, 1.001e7, 1e9):
        assert sp.t_two_sided(30.0, df) == pytest.approx(sp.f_upper(900.0, 1.0, df), rel=1e-6)
    assert sp.t_two_sided(30.0, 1e7) == pytest.approx(sp.t_two_sided(30.0, 1.001e7), rel=1e-4)
    assert sp.f_upper(3.0, 2.0, 57.0) == pytest.approx((1 + 6 / 57) ** -28.5, rel=1e-12)
    assert sp.f_upper(1.0, 1e6, 1e6) == pytest.approx(0.5, abs=1e-6)


def test_capitals_beyond_ascii(spark):
    df = spark.createDataFrame([("café_élève",), ("übung 2x_straße",)], "s string")
    assert [r[0] for r in df.select(tx.prettify(F.col("s"))).collect()] == ["Café Élève", "Übung 2X Straße"]
