import random

from tabloom.plans.analysis import ROW, analyze, analyze_csv
from tabloom.sources import csv


def test_reviews_end_to_end(spark, tmp_path):
    """A table shaped like an app review export: id, name, text, rating, time."""
    r = random.Random(1)
    words = {5: "great game love it", 4: "nice and good", 3: "a game", 2: "bad update", 1: "awful, worst ever"}
    rows = []
    for i in range(300):
        score = r.choice([1, 2, 3, 4, 5])
        rows.append((f"{i:08x}-abcd", f"name {i}", words[score] + f" {i % 17}", score,
                     f"2024-0{1 + i % 6}-{1 + i % 28:02d} {i % 24:02d}:00:00", "same"))
    df = spark.createDataFrame(rows, "reviewId string, userName string, content string, score int, at string, store string")
    args = dict(keys=["reviewId"], primary="score", task="classification", name="reviews", out=str(tmp_path / "r"))
    got = analyze(df, **args)
    assert got["profile"].count() == 6
    assert "store" not in got["cleaned"].columns and "userName" not in got["cleaned"].columns
    assert {"content_sentiment", "content_sentiment_num"} <= set(got["enriched"].columns)
    assert "reviewId" not in got["features"].columns and got["features"].count() == 300
    top = got["selected"].orderBy("seq").collect()
    best = max(top, key=lambda x: x["rank_score"])
    assert {best["parent_a"], best["parent_b"]} == {"score", "content"}
    assert best["feature_b"] == "content_sentiment_num" and best["effect_size"] > 0.8 and best["method"] == "spearman"
    assert abs(best["rank_score"] - best["effect_size"] * 4) < 1e-6
    lines = [r["line"] for r in got["summary"].orderBy("ord").collect()]
    assert lines[0] == "Top relations (final selected):" and lines[1].startswith("1. ") and len(top) <= 2
    assert lines[len(top) + 1:len(top) + 3] == ["", "Notes:"] and "(effect >= 0.15, adj_p <= 0.05, min_points = 50)" in lines[len(top) + 3] and len(lines) == len(top) + 6
    sections = {x["section"] for x in got["report"].collect()}
    assert sections == {"overview", "columns", "sentiment", "relations"}
    # a second run reads the finished stages back, whatever the order of rows; another input does not
    before = sorted(str(p) for p in (tmp_path / "r").rglob("_SUCCESS"))
    again = analyze(df.repartition(3), **args)
    assert sorted(str(p) for p in (tmp_path / "r").rglob("_SUCCESS")) == before
    assert again["relations"].count() == got["relations"].count()
    assert analyze(df.limit(120), **args)["cleaned"].count() == 120


def test_a_changed_target_changes_what_follows(spark, tmp_path):
    rows = [(i, ["low", "mid", "high"][i % 3], float(i % 3) + (i % 5) / 100, i % 7 + 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, grade string, points double, other double")
    out = str(tmp_path / "g")
    first = analyze(df, ["k"], "points", ["grade"], "regression", "grades", out)
    stages = lambda name: len(list((tmp_path / "g" / name).iterdir()))
    assert stages("profile") == stages("cleaned") == stages("relations") == 1
    second = analyze(df, ["k"], "other", ["points"], "regression", "grades", out)
    assert stages("profile") == 1 and stages("cleaned") == stages("relations") == 2
    touched = lambda got: {c for r in got["relations"].where("priority_weight >= 3").collect() for c in (r["parent_a"], r["parent_b"])}
    assert "points" in touched(first) and "other" in touched(second)


def test_regression_on_text_target(spark, tmp_path):
    rows = [(i, ["low", "mid", "high"][i % 3], float(i % 3) + (i % 5) / 100, None) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, grade string, points double, nothing string")
    got = analyze(df, ["k"], "grade", ["points"], "regression", "grades", str(tmp_path / "g"),
                  response="Fine.\nRecommendations\n- more")
    assert {r[0] for r in got["cleaned"].select("grade").distinct().collect()} == {0, 1, 2}
    assert got["selected"].count() == 1
    assert got["response"].first()["recommendations"] == ["more"]


def test_csv_with_awkward_names(spark, tmp_path):
    """Names with dots, brackets and blanks; a bad row; n/a cells; existing labels."""
    lines = ["Ratings(10),seat.type,Recommended ?,mood,n,score"]
    for i in range(100):
        good = i % 3 != 0
        rating = 8 + i % 3 if good else 1 + i % 2
        lines.append(f"{rating if i % 20 else 'n/a'},{'Economy' if i % 2 else 'Business'},{'yes' if good else 'no'},"
                     f"{'Positive' if good else 'NEG'},{i % 9},{i % 5}")
    lines.insert(5, "1,Economy,yes,pos,1,2,surplus")
    path = tmp_path / "air.csv"
    path.write_text("\n".join(lines), encoding="latin-1")
    got = analyze_csv(spark, str(path), "Recommended ?", ["seat.type"], name="air", out=str(tmp_path / "o"), export=str(tmp_path / "csv"))
    profile = {r["column"]: r for r in got["profile"].collect()}
    assert ROW not in profile and profile["Ratings(10)"]["non_null"] == 95 and profile["Ratings(10)"]["n_rows"] == 100
    assert profile["Ratings(10)"]["sample_values"][0] == "9.0"
    assert "mood_num" in got["enriched"].columns and ROW not in got["features"].columns
    back = csv.read_csv(spark, str(tmp_path / "csv" / "enriched"))
    assert back.count() == 100 and back.columns == got["enriched"].columns
    best = got["selected"].orderBy("seq").collect()
    pairs = {frozenset((r["parent_a"], r["parent_b"])) for r in best}
    assert frozenset(("Recommended ?", "Ratings(10)")) in pairs
    assert {r["section"] for r in got["report"].collect()} == {"overview", "columns", "sentiment", "relations"}
