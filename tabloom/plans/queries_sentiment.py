"""Queries: labels, text statistics, opinion gate, scoring, classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import labels as lb
from tabloom.functions import text as tx
from tabloom.functions.sampling import seeded_sample
from tabloom.operators import classify as cf
from tabloom.operators import sentiment as st
from tabloom.operators.charts import shares
from tabloom.operators.features import average_sentiment
from tabloom.plans.queries_cleaning import LABEL_SQL, labelled_events
from tabloom.plans.registry import (
    TEST_NEGATIVE, TEST_POSITIVE, clean_sql, hits_sql, query, r6, table, union_sql, words_sql,
)

SCORER = st.LexiconScorer(TEST_POSITIVE, TEST_NEGATIVE)
VOCABULARY = TEST_POSITIVE + TEST_NEGATIVE


def sample_sql(tbl: str, column: str, key: str, n: int = 500, seed: int = 1) -> str:
    return (f"(SELECT {column} AS t FROM {tbl} WHERE {column} IS NOT NULL "
            f"ORDER BY md5('{seed}:' || {key}), {key} LIMIT {n})")


@query("normalize_sentiment", f"""
SELECT mood, CASE WHEN k IN ('positive', 'pos') THEN 'positive' WHEN k = 'neg' THEN 'negative' ELSE 'neutral' END AS label,
       CASE WHEN k IN ('positive', 'pos') THEN 2 WHEN k = 'neg' THEN 0 ELSE 1 END AS code, count(*) AS n
FROM (SELECT {LABEL_SQL} AS mood, lower(trim({LABEL_SQL})) AS k FROM events) GROUP BY ALL
""")
def normalize_sentiment(spark, sf):
    e = labelled_events(spark, sf).withColumn("label", lb.normalize_label(F.col("mood")))
    return e.groupBy("mood", "label", lb.label_code(F.col("label")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


RAW_SQL = ("CASE event_type WHEN 'purchase' THEN ' P ' WHEN 'error' THEN 'LABEL_0' WHEN 'view' THEN '0' "
           "WHEN 'click' THEN '+1' ELSE 'unknown' END")


@query("canonical_label", f"""
SELECT raw, CASE trim(raw) WHEN 'P' THEN 'positive' WHEN 'LABEL_0' THEN 'negative' WHEN '0' THEN 'neutral'
       WHEN '+1' THEN 'positive' END AS label, count(*) AS n
FROM (SELECT {RAW_SQL} AS raw FROM events) GROUP BY ALL
""")
def canonical_label(spark, sf):
    kind = F.col("event_type")
    raw = (F.when(kind == "purchase", " P ").when(kind == "error", "LABEL_0").when(kind == "view", "0")
           .when(kind == "click", "+1").otherwise("unknown"))
    e = table(spark, sf, "events").select(raw.alias("raw"))
    return e.groupBy("raw", lb.canonical_label(F.col("raw")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("sentiment_num_existing", f"""
SELECT mood, CASE WHEN k IN ('positive', 'pos') THEN 2 WHEN k IN ('neg', 'negative') THEN 0 ELSE 1 END AS mood_num, count(*) AS n
FROM (SELECT {LABEL_SQL} AS mood, lower(trim({LABEL_SQL})) AS k FROM events) GROUP BY ALL
""")
def sentiment_num_existing(spark, sf):
    """The existing-label path of the whole stage: no scorer runs."""
    out, _, _ = st.enrich(labelled_events(spark, sf), ["event_id"], {"primary": "value", "secondary": []}, SCORER)
    return out.groupBy("mood", "mood_num").agg(F.count(F.lit(1)).alias("n"))


@query("clean_text", f"SELECT doc_id, md5({clean_sql('text')}) AS h, length({clean_sql('text')}) AS len FROM documents")
def clean_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cleaned = docs.withColumn("clean", tx.clean_text(F.col("text")))
    return cleaned.select("doc_id", F.md5("clean").alias("h"), F.length("clean").cast("long").alias("len"))


def _text_facts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return st.sampled_text_facts(st.text_sample(docs, ["doc_id"], ["text"]), VOCABULARY)


_SAMPLE = sample_sql("documents", "text", "doc_id")


@query("avg_word_count", f"SELECT round(avg(len({words_sql('t')})), 6) AS avg_words FROM {_SAMPLE}")
def avg_word_count(spark, sf):
    return _text_facts(spark, sf).select(r6("avg_words").alias("avg_words"))


def _ratio_sql(sample: str) -> str:
    return f"(SELECT count(DISTINCT w) * 1.0 / count(w) FROM (SELECT unnest({words_sql('t')}) AS w FROM {sample}))"


@query("unique_word_ratio", f"SELECT round({_ratio_sql(_SAMPLE)}, 6) AS unique_word_ratio")
def unique_word_ratio(spark, sf):
    return _text_facts(spark, sf).select(r6("unique_word_ratio").alias("unique_word_ratio"))


@query("sentiment_keyword_signal", f"""
SELECT avg(CASE WHEN {hits_sql('t', VOCABULARY)} > 0 THEN 1.0 ELSE 0 END) > 0.01 AS keyword_signal FROM {_SAMPLE}
""")
def sentiment_keyword_signal(spark, sf):
    return _text_facts(spark, sf).select("keyword_signal")


_CANDIDATES = [
    (t, c, k) for t, k, cs in (
        ("part", "p_partkey", ("p_name", "p_brand", "p_type")), ("customer", "c_custkey", ("c_name", "c_mktsegment")),
        ("documents", "doc_id", ("text", "lang", "source")))
    for c in cs
]


@query("sentiment_candidates", union_sql([f"""
SELECT '{c}' AS "column", round(aw, 6) AS avg_words, round(ur, 6) AS unique_word_ratio, kw AS keyword_signal, (SELECT count({c}) FROM {t}) AS non_null_count,
       NOT (aw < 1.5 AND ur > 0.9) AND (aw >= 2 OR kw) AS is_candidate
FROM (SELECT avg(len({words_sql('t')})) AS aw, {_ratio_sql(sample_sql(t, c, k))} AS ur,
             avg(CASE WHEN {hits_sql('t', VOCABULARY)} > 0 THEN 1.0 ELSE 0 END) > 0.01 AS kw FROM {sample_sql(t, c, k)})
""" for t, c, k in _CANDIDATES]))
def sentiment_candidates(spark, sf):
    parts = [
        st.candidates(table(spark, sf, t), [k], VOCABULARY)
        for t, k in (("part", "p_partkey"), ("customer", "c_custkey"), ("documents", "doc_id"))
    ]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.withColumns({c: r6(c) for c in ("avg_words", "unique_word_ratio")})


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 500")
def seeded_sample_query(spark, sf):
    return seeded_sample(table(spark, sf, "documents").select("doc_id", "lang"), 500, ["doc_id"], 7)


def _gate_sql(tbl: str, key: str) -> str:
    p, q = hits_sql("t", TEST_POSITIVE), hits_sql("t", TEST_NEGATIVE)
    return f"""
    SELECT '{tbl}' AS table_name, round(avg(CASE WHEN p + q > 0 THEN 1.0 ELSE 0 END), 6) AS opinion_frac,
           round(coalesce(avg(CASE WHEN p + q > 0 THEN abs(p - q) * 1.0 / (p + q) END), 0), 6) AS mean_conf,
           avg(CASE WHEN p + q > 0 THEN 1.0 ELSE 0 END) >= 0.25 AS passes
    FROM (SELECT {p} AS p, {q} AS q FROM {sample_sql(tbl, 'text', key)})"""


@query("opinion_gate", union_sql([
    _gate_sql("documents", "doc_id"), _gate_sql("conversations", "conv_id || ',' || turn").replace(
        ", conv_id || ',' || turn LIMIT", ", conv_id, turn LIMIT")]))
def opinion_gate(spark, sf):
    parts = []
    for t, keys in (("documents", ["doc_id"]), ("conversations", ["conv_id", "turn"])):
        gate = st.opinion_gate(st.text_sample(table(spark, sf, t).select(*keys, "text"), keys, ["text"]), SCORER)
        parts.append(gate.select(F.lit(t).alias("table_name"), r6("opinion_frac").alias("opinion_frac"),
                                 r6("mean_conf").alias("mean_conf"), "passes"))
    return parts[0].unionByName(parts[1])


def scored_sql(t: str, extra: str, source: str) -> str:
    """(extra, p, q) counts of the cleaned text, then label and score."""
    return f"""
    SELECT {extra}, CASE WHEN p > q THEN 'positive' WHEN q > p THEN 'negative' ELSE 'neutral' END AS raw_label,
           CASE WHEN p + q > 0 THEN abs(p - q) * 1.0 / (p + q) ELSE 0 END AS score
    FROM (SELECT *, {hits_sql('c', TEST_POSITIVE)} AS p, {hits_sql('c', TEST_NEGATIVE)} AS q
          FROM (SELECT *, {clean_sql(t)} AS c FROM {source}))"""


@query("sentiment_score_dedup", f"""
SELECT md5(c) AS h, raw_label, round(score, 6) AS score, count(*) AS n FROM ({scored_sql('text', 'c', 'documents')})
GROUP BY ALL
""")
def sentiment_score_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = st.score_distinct(docs, ["text"], SCORER)
    return scored.select(F.md5("clean").alias("h"), F.col("_raw_label").alias("raw_label"), r6("_raw_score").alias("score"), "n")


_ANNOTATED = f"""
SELECT conv_id, turn, label AS text_sentiment,
       CASE label WHEN 'positive' THEN 2 WHEN 'negative' THEN 0 ELSE 1 END AS text_sentiment_num, score AS text_sentiment_confidence
FROM (SELECT *, CASE WHEN score < 0.5 THEN 'neutral' ELSE raw_label END AS label
      FROM ({scored_sql('text', 'conv_id, turn', 'conversations')}))
"""


def annotated(spark, sf):
    return st.annotate(table(spark, sf, "conversations"), ["text"], SCORER)


@query("sentiment_annotate", f"""
SELECT conv_id, turn, text_sentiment, text_sentiment_num, round(text_sentiment_confidence, 6) AS text_sentiment_confidence
FROM ({_ANNOTATED})
""")
def sentiment_annotate(spark, sf):
    out = annotated(spark, sf).withColumn("text_sentiment_confidence", r6("text_sentiment_confidence"))
    return out.select("conv_id", "turn", "text_sentiment", "text_sentiment_num", "text_sentiment_confidence")


@query("sentiment_distribution", f"""
SELECT text_sentiment AS label, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share
FROM ({_ANNOTATED}) GROUP BY 1
""")
def sentiment_distribution(spark, sf):
    return st.distribution(annotated(spark, sf), "text_sentiment").withColumn("share", r6("share"))


@query("sentiment_shares", f"""
SELECT CASE text_sentiment_num WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS label, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM ({_ANNOTATED}) GROUP BY text_sentiment_num
""")
def sentiment_shares(spark, sf):
    return shares(annotated(spark, sf), "text_sentiment_num").withColumn("pct", r6("pct"))


@query("resolve_sentiment_col", f"""
SELECT 'text_sentiment_num' AS "column", CAST(text_sentiment_num AS VARCHAR) AS label, count(*) AS n
FROM ({_ANNOTATED}) GROUP BY text_sentiment_num
""")
def resolve_sentiment_col(spark, sf):
    out = annotated(spark, sf)
    chosen = st.resolve_sentiment_column(out.columns)
    return st.distribution(out, chosen).select(F.lit(chosen).alias("column"), "label", "n")


@query("avg_sentiment", f"""
SELECT conv_id, turn, CASE WHEN turn = 0 THEN CAST(text_sentiment_num AS DOUBLE)
       ELSE (text_sentiment_num + (CASE role WHEN 'user' THEN 2 ELSE 0 END)) / 2.0 END AS avg_sentiment_all_textcols
FROM ({_ANNOTATED}) JOIN conversations USING (conv_id, turn)
""")
def avg_sentiment(spark, sf):
    second = F.when(F.col("turn") > 0, F.when(F.col("role") == "user", 2).otherwise(0))
    out = average_sentiment(annotated(spark, sf).withColumn("role_sentiment_num", second))
    return out.select("conv_id", "turn", "avg_sentiment_all_textcols")


@query("label_counts", """
SELECT quality AS label, count(*) AS n FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1
""")
def label_counts(spark, sf):
    return cf.label_counts(table(spark, sf, "labels"), "quality")


@query("stratified_split", """
SELECT doc_id, quality, CASE WHEN rn <= round(0.2 * size) THEN 'test' ELSE 'train' END AS part FROM (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id)) AS rn,
         count(*) OVER (PARTITION BY quality) AS size FROM labels)
""")
def stratified_split(spark, sf):
    return cf.stratified_split(table(spark, sf, "labels"), "quality", ["doc_id"]).select("doc_id", "quality", "part")


@query("classification_metrics", """
WITH c AS (SELECT unnest([0, 1]) AS class),
s AS (SELECT class, (SELECT count(*) FROM labels WHERE quality = class) AS actual,
             (SELECT count(*) FROM labels WHERE toxic = class) AS predicted,
             (SELECT count(*) FROM labels WHERE quality = class AND toxic = class) AS hit FROM c),
m AS (SELECT *, CASE WHEN predicted > 0 THEN hit * 1.0 / predicted ELSE 0 END AS p, CASE WHEN actual > 0 THEN hit * 1.0 / actual ELSE 0 END AS r FROM s),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m)
SELECT 'macro' AS average, CAST(sum(actual) AS BIGINT) AS n, round(sum(hit) * 1.0 / sum(actual), 6) AS accuracy, round(avg(p), 6) AS precision,
       round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM f
UNION ALL
SELECT 'binary', CAST(sum(actual) AS BIGINT), round(sum(hit) * 1.0 / sum(actual), 6), round(max(CASE WHEN class = 1 THEN p END), 6),
       round(max(CASE WHEN class = 1 THEN r END), 6), round(max(CASE WHEN class = 1 THEN f END), 6) FROM f
""")
def classification_metrics(spark, sf):
    labels = table(spark, sf, "labels")
    parts = [
        cf.metrics(labels, "quality", "toxic", positive).withColumn("average", F.lit(name))
        for name, positive in (("macro", None), ("binary", "1"))
    ]
    out = parts[0].unionByName(parts[1])
    return out.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1")})


def _training_rows(spark, sf):
    """Labelled documents with a label of three classes."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    mood = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("junk")
    return docs.join(table(spark, sf, "labels"), "doc_id").withColumn("mood", mood)


def _bayes_sql(label: str) -> str:
    """Multinomial naive Bayes over word counts: (doc_id, label, prediction) of the held-out part."""
    return f"""
    WITH rows AS (SELECT doc_id, text, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'clean' ELSE 'junk' END AS mood, quality
                  FROM documents JOIN labels USING (doc_id)),
    split AS (SELECT doc_id, text, {label} AS label, row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || doc_id)) <= round(0.2 * count(*) OVER (PARTITION BY {label})) AS test FROM rows),
    w AS (SELECT doc_id, label, test, unnest({words_sql('text')}) AS w FROM split),
    c AS (SELECT label, count(*) AS n FROM split WHERE NOT test GROUP BY 1),
    t AS (SELECT w, label, count(*) AS n FROM w WHERE NOT test GROUP BY ALL),
    v AS (SELECT count(DISTINCT w) AS v FROM t),
    tot AS (SELECT label, sum(n) AS n FROM t GROUP BY 1),
    d AS (SELECT doc_id, w, count(*) AS n FROM w WHERE test AND w IN (SELECT w FROM t) GROUP BY ALL),
    s AS (SELECT d.doc_id, c.label, sum(d.n * ln((coalesce(t.n, 0) + 1) / (tot.n + v.v))) AS s
          FROM d CROSS JOIN v CROSS JOIN c JOIN tot ON tot.label = c.label LEFT JOIN t ON t.w = d.w AND t.label = c.label GROUP BY ALL),
    p AS (SELECT doc_id, c.label, round(s + ln(c.n * 1.0 / (SELECT sum(n) FROM c)), 9) AS s FROM s JOIN c ON c.label = s.label),
    best AS (SELECT doc_id, arg_min(label, (-s, label)) AS prediction FROM p GROUP BY 1)
    SELECT split.doc_id, split.label, coalesce(prediction, (SELECT label FROM c ORDER BY n DESC, label LIMIT 1)) AS prediction FROM split LEFT JOIN best ON split.doc_id = best.doc_id WHERE test"""


@query("train_text_classifier", f"SELECT doc_id, label AS quality, prediction FROM ({_bayes_sql('quality')})")
def train_text_classifier(spark, sf):
    """Two classes, word counts."""
    rows = cf.written_split(_training_rows(spark, sf), "quality", ["doc_id"])
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    return cf.exact_bayes(train, test, "text", "quality", ["doc_id"]).select("doc_id", "quality", "prediction")


@query("train_three_classes", f"SELECT doc_id, label AS mood, prediction FROM ({_bayes_sql('mood')})")
def train_three_classes(spark, sf):
    """Three classes, word counts."""
    rows = cf.written_split(_training_rows(spark, sf), "mood", ["doc_id"])
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    return cf.exact_bayes(train, test, "text", "mood", ["doc_id"]).select("doc_id", "mood", "prediction")


@query("compare_models", f"""
WITH r AS ({_bayes_sql('quality')}), n AS (SELECT count(*) AS n FROM r),
k AS (SELECT unnest([0, 1]) AS class),
s AS (SELECT class, (SELECT count(*) FROM r WHERE label = class) AS actual, (SELECT count(*) FROM r WHERE prediction = class) AS predicted,
             (SELECT count(*) FROM r WHERE label = class AND prediction = class) AS hit FROM k),
m AS (SELECT *, CASE WHEN predicted > 0 THEN hit * 1.0 / predicted ELSE 0 END AS p, CASE WHEN actual > 0 THEN hit * 1.0 / actual ELSE 0 END AS r FROM s),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m)
SELECT 'exact_bayes' AS model, CAST(sum(actual) AS BIGINT) AS n, round(sum(hit) * 1.0 / sum(actual), 6) AS accuracy, round(avg(f), 6) AS f1,
       sum(hit) * 1.0 / sum(actual) >= max(actual) * 1.0 / sum(actual) AS beats_majority FROM f
UNION ALL SELECT 'logistic_regression', n, NULL, NULL, true FROM n
""")
def compare_models(spark, sf):
    """Exact figures of the word-count model; the iterative one has to do no worse than the majority class."""
    split = cf.written_split(_training_rows(spark, sf), "quality", ["doc_id"])
    test = split.where("part = 'test'")
    majority = test.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n") / F.sum("n")).first()[0]
    exact = cf.exact_bayes(split.where("part = 'train'"), test, "text", "quality", ["doc_id"])
    exact = cf.metrics(exact, "quality", "prediction").withColumn("model", F.lit("exact_bayes"))
    both = cf.compare([exact, cf.train_and_score(split, "text", "quality", "logistic_regression")])
    own = lambda c: F.when(F.col("model") == "exact_bayes", r6(c))
    return both.select("model", "n", own("accuracy").alias("accuracy"), own("f1").alias("f1"), (F.col("accuracy") >= majority).alias("beats_majority"))
