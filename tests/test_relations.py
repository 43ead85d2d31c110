import pytest

from tabloom.operators import relations as rl

SCHEMA = ("seq int, parent_a string, parent_b string, feature_a string, feature_b string, method string, "
          "effect_size double, p_value double, n long, direction string, notes string")


def relation(seq, a, b, effect, p=0.0, n=1000, method="spearman", notes=None):
    return (seq, a, b, a + "_z", b + "_z", method, effect, p, n, "positive" if effect and effect > 0 else "negative", notes)


def test_published_scores(spark):
    """A relation with the primary scores effect * 4, with a secondary only effect * 3."""
    df = spark.createDataFrame([
        relation(0, "Depression", "Suicidal", 0.546281), relation(1, "CGPA", "Age", 0.4), relation(2, "x", "y", 0.5)], SCHEMA)
    got = {r["seq"]: (r["priority_weight"], r["rank_score"]) for r in rl.rank(df, "Depression", ["CGPA"]).collect()}
    assert got[0] == (3, pytest.approx(2.185124)) and got[1] == (2, pytest.approx(1.2)) and got[2] == (0, pytest.approx(0.5))


def test_null_p_does_not_poison_the_rest(spark):
    df = spark.createDataFrame([relation(0, "a", "b", 0.9, None), relation(1, "a", "c", 0.5, 0.001)], SCHEMA)
    got = {r["seq"]: r for r in rl.rank(df, "a", []).collect()}
    assert got[0]["adjusted_p_value"] is None and got[0]["rank_score"] == 0 and not got[0]["significant_fdr"]
    assert got[1]["adjusted_p_value"] == pytest.approx(0.001) and got[1]["significant_fdr"]


def test_swapped_parents_collapse(spark):
    df = spark.createDataFrame([relation(0, "a", "b", 0.3), relation(1, "b", "a", -0.6), relation(2, "a", "c", 0.2, notes="too_few_samples")], SCHEMA)
    assert [r["seq"] for r in rl.rank(df, None, []).collect()] == [1]


def test_quality_edges(spark):
    df = spark.createDataFrame([
        relation(0, "a", "b", 0.15, n=50), relation(1, "a", "c", 0.1499), relation(2, "a", "d", 0.9, n=49), relation(3, "a", "e", -0.9, p=0.2)], SCHEMA)
    assert [r["seq"] for r in rl.quality(rl.rank(df, "a", []), 1000).collect()] == [0]
    assert (rl.min_points(99), rl.min_points(100), rl.min_points(500), rl.min_points(40)) == (10, 50, 50, 10)


def test_greedy_selection(spark):
    rows = [relation(i, a, b, e) for i, (a, b, e) in enumerate([
        ("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.7), ("c", "d", 0.6), ("e", "f", 0.5), ("g", "h", 0.4)])]
    ranked = rl.rank(spark.createDataFrame(rows, SCHEMA), None, [])
    pick = lambda primary, secondary: [r["seq"] for r in rl.select(ranked, primary, secondary)]
    assert pick("q", ["s"]) == [0, 1, 3, 4]   # a-c is skipped: both parents are used
    assert pick("q", []) == [0, 1] and pick(None, []) == [0]
    assert rl.relation_cap("q", ["s", "t"]) == 4


def test_representative_preferences():
    kinds = {"x": "numeric", "x_z": "numeric", "t": "text", "t_word_count": "numeric", "t_sentiment_num": "numeric",
             "d": "datetime", "d_year": "numeric", "d_hour": "numeric", "plain": "categorical"}
    links = [("x", "x_z", 0), ("t", "t_word_count", 0), ("t", "t_sentiment_num", 1), ("d", "d_year", 0), ("d", "d_hour", 1)]
    reps = rl.representatives(list(kinds), kinds, links)
    assert reps == {"d": "d_year", "plain": "plain", "t": "t_sentiment_num", "x": "x_z"}
    assert rl.representatives(list(kinds), kinds, links, hour_first=True)["d"] == "d_hour"
    existing = [{"column": "plain", "numeric_version": "plain_num"}]
    assert rl.parent_map(links, existing)["plain_num"] == "plain"


def test_pair_plan(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), "a", i % 3) for i in range(30)], "x double, y double, flat string, t int")
    facts = rl.type_facts(df)
    reps = rl.representatives(df.columns, {f["column"]: f["kind"] for f in facts}, [])
    pairs = [(a, b) for a, b, _, _ in rl.plan_pairs(df, reps, facts, "t", ["y"], {"x", "y", "t"})]
    assert pairs == [("t", "x"), ("t", "y"), ("y", "x")]   # the constant is skipped, no pair twice


def test_small_samples_are_noted(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(9)], "x double, y double")
    row = rl.compute(df, [("x", "y", "x", "y")], {"x": "numeric", "y": "numeric"}).first()
    assert row["notes"] == "too_few_samples" and row["effect_size"] is None and row["n"] == 9


def test_wording(spark):
    df = spark.createDataFrame([relation(0, "review_rating", "Ratings(10)", 0.31234, 1.5e-7, 120),
                                relation(1, "a", "b", -0.12, 0.04), relation(2, "a", "b", None, None)], SCHEMA)
    got = {r["seq"]: r for r in rl.sentences(df).collect()}
    assert got[0]["short"] == "Review Rating increases with Ratings(10) (strong, spearman, effect=0.31, p=1.5e-07)."
    assert "effect=0.312, p=1.5e-07, n=120" in got[0]["long"]
    assert got[1]["action"].startswith("Investigate A vs B further")
    assert got[2]["short"] == "No clear relation found between A and B." and got[2]["action"] == ""
