from pyspark.sql import functions as F

from tabloom.operators import classify as cf
from tabloom.operators import sentiment as st

SCORER = st.LexiconScorer()


class PerTextScorer:
    """Same answers as the lexicon, but scored once per distinct text."""

    columnar = False
    seen = []

    def score(self, texts, column):
        PerTextScorer.seen.append(texts.count())
        return SCORER.score(texts, column)

    opinion = SCORER.opinion


def reviews(spark):
    rows = [(i, ["good great!", "bad, awful", "a table", "", None, "good bad"][i % 6], i % 5) for i in range(120)]
    return spark.createDataFrame(rows, "k int, review string, score int")


def test_annotation_and_dedup_agree(spark):
    df = reviews(spark)
    one = {tuple(r) for r in st.annotate(df, ["review"], SCORER).collect()}
    two = {tuple(r) for r in st.annotate(df, ["review"], PerTextScorer()).collect()}
    assert one == two and len(one) == 120
    assert PerTextScorer.seen == [5]  # null and "" are one text
    got = {r["review"]: (r["review_sentiment"], r["review_sentiment_num"], r["review_sentiment_confidence"], r["score"] is not None)
           for r in st.annotate(df, ["review"], SCORER).collect()}
    assert got["good great!"] == ("positive", 2, 1.0, True)
    assert got["bad, awful"] == ("negative", 0, 1.0, True)
    assert got["good bad"] == ("neutral", 1, 0.0, True)
    assert got[None] == ("neutral", 1, 0.0, True)


def test_existing_label_thresholds(spark):
    def check(labels, noise=0):
        df = spark.createDataFrame([(v,) for v in labels + ["?"] * noise], "s string")
        return st.existing_label_facts(df).first()["is_existing"]

    assert not check(["pos"] * 29 + [None] * 5)
    assert check([" Positive ", "NEG", "neu"] * 10)
    assert check(["pos"] * 45, noise=5) and not check(["pos"] * 44, noise=6)


def test_enrich_paths(spark):
    df = reviews(spark)
    out, meta, record = st.enrich(df, ["k"], {"primary": "score", "secondary": []}, SCORER)
    assert [a["column"] for a in meta["analyzed"]] == ["review"]
    assert "review_sentiment_num" in out.columns
    labelled = df.withColumn("mood", F.lit("pos"))
    out, meta, record = st.enrich(labelled, ["k"], {"primary": "score", "secondary": ["a", "b"]}, SCORER)
    assert record["secondary"] == ["a", "b", "mood"] and meta["note"] == "existing_sentiment_used"
    assert "mood_num" in out.columns and "review_sentiment" not in out.columns


def test_gate_skips_dull_columns(spark):
    df = spark.createDataFrame([(i, f"plain words number {i}") for i in range(50)], "k int, t string")
    out, meta, _ = st.enrich(df, ["k"], {"primary": "k", "secondary": []}, SCORER)
    assert [s["column"] for s in meta["skipped"]] == ["t"] and out.columns == ["k", "t"]


def test_resolution_order():
    columns = ["x", "a_sentiment", "b_sentiment_num"]
    assert st.resolve_sentiment_column(columns) == "b_sentiment_num"
    assert st.resolve_sentiment_column(columns, [{"column": "x", "numeric_version": "x_num"}]) == "x"
    assert st.resolve_sentiment_column(columns, [], ["a_sentiment"]) == "a_sentiment"
    assert st.resolve_sentiment_column(["sentiment", "y"]) == "sentiment"
    assert st.resolve_sentiment_column(["y"]) is None


def test_split_is_exact_per_class(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(330)], "k int, y string")
    got = {(r["y"], r["part"]): r["count"] for r in cf.stratified_split(df, "y", ["k"]).groupBy("y", "part").count().collect()}
    assert got == {("a", "test"): 59, ("a", "train"): 238, ("b", "test"): 7, ("b", "train"): 26}


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (2, 2)], "y int, p int")
    m = cf.metrics(df, "y", "p").first()
    assert m["accuracy"] == 0.75 and m["n"] == 4
    assert abs(m["precision"] - (2 / 3 + 0 + 1) / 3) < 1e-12 and abs(m["recall"] - 2 / 3) < 1e-12


def test_model_scorer(spark):
    rows = [(i, "good great fine" if i % 2 else "bad awful poor", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t string, y int")
    model = cf.train(df, "t", "y")
    scorer = cf.ModelScorer(model, "t", {0: "negative", 1: "positive"})
    out = st.annotate(df.withColumnRenamed("t", "review"), ["review"], scorer)
    assert out.where("(y = 1) <> (review_sentiment = 'positive')").count() == 0
    best = cf.compare([cf.train_and_score(cf.written_split(df, "y", ["k"]), "t", "y", "naive_bayes")] * 2)
    assert [r["model"] for r in best.collect()] == ["naive_bayes"]
