"""Training, evaluating and comparing text classifiers with Spark ML."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions import text as tx
from tabloom.functions.sampling import order_hash
from tabloom.operators.ranking import lookup, quoted_col
from tabloom.operators.selection import ends, selected
from tabloom.session import scratch_path, written
from tabloom.settings import DEFAULTS, Settings

FEATURES = 1 << 16


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n) over the rows without any null."""
    return df.dropna().groupBy(quoted_col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def stratified_split(df: DataFrame, label: str, keys: list[str], test_share: float = 0.2,
                     cfg: Settings = DEFAULTS) -> DataFrame:
    """Adds ``part``: exactly round(share * class size) rows per class are 'test'.

    A radix descent over the leading 60 bits of the hashes finds each class's threshold: counts of digits, no ordering of
    rows, however large a class is.  The rows are then marked by comparison, so texts never move.  Keys that share those bits are
    told apart by the whole hash; rows with equal keys fall on one side together.
    """
    h = order_hash(cfg.split_seed, *[quoted_col(k) for k in keys])
    narrow = df.select(quoted_col(label).alias("_label"), h.alias("_h")).where("_label is not null").withColumn(
        "_image", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"))
    whole = ends(narrow, ["_label"], "_image", "_h")
    last = (F.round(F.col("n") * F.lit(test_share)) - 1).cast("long")
    edges = selected(narrow, ["_label"], "_image", "_h", whole.withColumn("rank", last).where("rank >= 0"))
    sizes = whole.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    # the keys at each threshold: one for each class, but for hashes that begin alike
    near = lookup(narrow, edges.select("_label", F.col("image").alias("_edge_image"), "left", "n"), ["_label"], ["_edge_image", "left"],
                  sizes["rows"] or 0, sizes["classes"])
    tied = near.where(F.col("_image") == F.col("_edge_image")).groupBy("_label", "_h", "left").agg(F.count(F.lit(1)).alias("_rows"))
    up_to = F.sum("_rows").over(Window.partitionBy("_label").orderBy("_h"))
    found = tied.withColumn("_upto", up_to).where(F.col("_upto") > F.col("left")).groupBy("_label").agg(F.min("_h").alias("_edge"))
    edges = found.join(whole.select("_label", "n"), "_label")
    marked = lookup(df.withColumns({"_label": quoted_col(label), "_h": h}), edges, ["_label"], ["_edge"],
                    sizes["rows"] or 0, sizes["classes"])
    part = F.when(quoted_col("_label").isNull(), None).when(F.col("_h") <= F.col("_edge"), "test").otherwise("train")
    return marked.withColumn("part", part).drop("_label", "_h", "_edge")


def written_split(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """The split as a written table: training reads it many times, and a filter
    on ``part`` prunes the other part's files."""
    path = scratch_path(df.sparkSession, "split")
    stratified_split(df, label, keys).where("part is not null").write.partitionBy("part").parquet(path)
    return df.sparkSession.read.parquet(path)


def text_pipeline(kind: str, text: str, label: str) -> Pipeline:
    steps = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=FEATURES),
    ]
    if kind == "logistic_regression":
        steps += [
            IDF(inputCol="_tf", outputCol="_tfidf"),
            LogisticRegression(featuresCol="_tfidf", labelCol=label, predictionCol="prediction", maxIter=20, regParam=0.01),
        ]
    elif kind == "naive_bayes":
        steps += [NaiveBayes(featuresCol="_tf", labelCol=label, predictionCol="prediction")]
    else:
        raise ValueError(f"unknown model {kind!r}")
    return Pipeline(stages=steps)


def train(train_rows: DataFrame, text: str, label: str, kind: str = "logistic_regression") -> PipelineModel:
    return text_pipeline(kind, text, label).fit(train_rows)


def predict(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    return model.transform(rows).select(*[quoted_col(c) for c in keep], "prediction", "probability")


class ModelScorer:
    """Sentiment scorer over a trained pipeline; sees each distinct text once."""

    columnar = False

    def __init__(self, model: PipelineModel, text: str, names: dict[float, str], opinion_labels=("positive",)):
        self.model, self.text, self.names, self.opinion_labels = model, text, names, tuple(opinion_labels)

    def _top(self, texts: DataFrame, column: str) -> DataFrame:
        shown = F.create_map(*[F.lit(x) for k, v in self.names.items() for x in (float(k), v)])
        scored = self.model.transform(texts.withColumn(self.text, F.coalesce(quoted_col(column), F.lit(""))))
        return scored.select(
            *[quoted_col(c) for c in texts.columns], shown[F.col("prediction")].alias("_raw_label"),
            F.array_max(vector_to_array("probability")).alias("_raw_score"),
        )

    def score(self, texts: DataFrame, column: str) -> DataFrame:
        return self._top(texts, column)

    def opinion(self, texts: DataFrame, column: str) -> DataFrame:
        top = self._top(texts, column)
        return top.withColumns({
            "_is_opinion": F.col("_raw_label").isin(*self.opinion_labels).cast("int"), "_opinion_score": F.col("_raw_score"),
        }).drop("_raw_label", "_raw_score")


def class_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, actual, predicted, hit, precision, recall, f1); 0 on division by zero.

    The rows are counted per (label, prediction) first, so everything after the
    first shuffle has classes-squared rows.
    """
    cells = df.groupBy(
        quoted_col(label).cast("string").alias("l"), quoted_col(prediction).cast("string").alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("actual"), zero.alias("predicted"),
                 F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(zero).alias("hit")),
        F.struct(F.col("p").alias("class"), zero.alias("actual"), F.col("n").alias("predicted"), zero.alias("hit")),
    )))
    per_class = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hit")])
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    scored = per_class.withColumns({
        "precision": ratio(F.col("hit"), F.col("predicted")), "recall": ratio(F.col("hit"), F.col("actual")),
    })
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def metrics(df: DataFrame, label: str, prediction: str, positive: str | None = None) -> DataFrame:
    """(n, accuracy, precision, recall, f1): of one class, or the macro average."""
    scores = class_scores(df, label, prediction)
    of = (lambda c: F.avg(c)) if positive is None else (lambda c: F.coalesce(F.max(F.when(F.col("class") == positive, F.col(c))), F.lit(0.0)))
    return scores.agg(
        F.sum("actual").alias("n"), (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        *[of(c).alias(c) for c in ("precision", "recall", "f1")],
    )


def word_counts(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(kept columns, w, n): how often each row has each of its words."""
    words = rows.select(*[quoted_col(c) for c in keep], F.explode(tx.words(quoted_col(text))).alias("w"))
    return words.groupBy(*[quoted_col(c) for c in keep], "w").agg(F.count(F.lit(1)).alias("n"))


def exact_bayes(train_rows: DataFrame, test_rows: DataFrame, text: str, label: str, keys: list[str]) -> DataFrame:
    """(keys, label, prediction): multinomial naive Bayes over exact word counts with add-one smoothing.

    No hashing and no limit on the vocabulary: word counts stay a table, and a row's words are looked up in it without
    gathering those of a frequent word in one task.  Words that training never saw are passed over; of equally likely
    classes the first in sort order is predicted.
    """
    classes = {r["label"]: r["n"] for r in train_rows.groupBy(quoted_col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()}
    counts = written(word_counts(train_rows, text, [label]).withColumnRenamed(label, "_label"), "word-counts")
    totals = {r["_label"]: r["n"] for r in counts.groupBy("_label").agg(F.sum("n").alias("n")).collect()}
    # a word of training stands for as many rows as tokens at most
    per_word = counts.groupBy("w").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("_label") == c, F.col("n")).otherwise(0)).alias(f"n{i}") for i, c in enumerate(classes)])
    size = per_word.count()
    logs = [F.log((F.col(f"n{i}") + 1) / F.lit(float(totals.get(c, 0) + size))).alias(f"l{i}") for i, c in enumerate(classes)]
    table = written(per_word.select("w", "n", *logs), "word-logs")
    tokens = written(word_counts(test_rows, text, [*keys, label]).withColumnRenamed("n", "times"), "test-words")
    known = lookup(tokens, table, ["w"], [f"l{i}" for i in range(len(classes))], tokens.count(), size)
    all_rows = sum(classes.values())
    scored = known.groupBy(*[quoted_col(k) for k in keys], quoted_col(label)).agg(
        *[(F.coalesce(F.sum(F.col("times") * F.col(f"l{i}")), F.lit(0.0)) + math.log(n / all_rows)).alias(f"s{i}") for i, n in enumerate(classes.values())])
    best = F.greatest(*[F.round(f"s{i}", 9) for i in range(len(classes))]) if len(classes) > 1 else F.round("s0", 9)
    choice = F.coalesce(*[F.when(F.round(f"s{i}", 9) == best, F.lit(c)) for i, c in enumerate(classes)])
    # rows without words are of the most frequent class
    empty = max(classes, key=lambda c: (classes[c], ), default=None)
    out = test_rows.select(*[quoted_col(k) for k in keys], quoted_col(label))
    return out.join(scored.select(*[quoted_col(k) for k in keys], choice.alias("prediction")), keys, "left").withColumn(
        "prediction", F.coalesce("prediction", F.lit(empty)))


def train_and_score(split: DataFrame, text: str, label: str, kind: str) -> DataFrame:
    """(model, n, accuracy, precision, recall, f1) on the held-out part of a written split."""
    model = train(split.where("part = 'train'"), text, label, kind)
    held_out = predict(model, split.where("part = 'test'"), [label])
    scored = metrics(held_out.withColumn("prediction", F.col("prediction").cast(split.schema[label].dataType)), label, "prediction")
    return scored.withColumn("model", F.lit(kind))


def compare(results: list[DataFrame]) -> DataFrame:
    """One row per model name, best macro F1 first."""
    return reduce(DataFrame.unionByName, results).dropDuplicates(["model"]).orderBy(F.desc("f1"), "model")
