"""Queries: feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import text as tx
from tabloom.operators import features as ft
from tabloom.plans.queries_cleaning import LINE_EXTRA, kept_sql, column_rows, with_constants
from tabloom.plans.registry import query, r6, table, union_sql, words_sql


@query("classify_columns", union_sql([
    f"""SELECT '{c}' AS "column", CASE WHEN avg(len({words_sql(c)})) < 3 AND count(DISTINCT {c}) <= 30
        THEN 'categorical' ELSE 'text' END AS kind FROM part""" for c in ("p_name", "p_brand", "p_type")
] + [f"SELECT DISTINCT '{c}', 'numeric' FROM part" for c in ("p_partkey", "p_size", "p_retailprice")]))
def classify_columns(spark, sf):
    part = table(spark, sf, "part")
    kinds = ft.classify(part)
    return spark.createDataFrame(list(kinds.items()), "column string, kind string")


HOLES = "CASE WHEN c_mktsegment = 'BUILDING' OR c_nationkey = 3 THEN NULL ELSE c_acctbal END"


def _holey(spark, sf):
    """With nulls and, which count as missing too, NaN."""
    some = F.when(F.col("c_nationkey") == 3, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return table(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_mktsegment") != "BUILDING", some))


@query("median_fill", f"""
SELECT c_custkey, round(coalesce({HOLES}, (SELECT median({HOLES}) FROM customer)), 6) AS c_acctbal FROM customer
""")
def median_fill(spark, sf):
    out = ft.median_fill(_holey(spark, sf), ["c_acctbal"])
    return out.select("c_custkey", r6("c_acctbal").alias("c_acctbal"))


@query("zscore", f"""
SELECT c_custkey, round(({HOLES} - m) / s, 6) AS c_acctbal_z, CAST(0 AS DOUBLE) AS flat_z
FROM customer, (SELECT avg({HOLES}) AS m, stddev_pop({HOLES}) AS s FROM customer)
""")
def zscore(spark, sf):
    c = _holey(spark, sf).withColumn("flat", F.lit(3.0))
    out = ft.zscores(c, ["c_acctbal", "flat"])
    return out.select("c_custkey", r6("c_acctbal_z").alias("c_acctbal_z"), "flat_z")


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("numeric_meta", union_sql([
    f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std "
    "FROM (SELECT * REPLACE (CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS l_tax) FROM lineitem)" for c in _NUMERIC]))
def numeric_meta(spark, sf):
    tax = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    out = ft.numeric_meta(table(spark, sf, "lineitem").withColumn("l_tax", tax), _NUMERIC)
    return out.select("column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("label_encode", """
WITH t AS (SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'nan') AS v FROM orders)
SELECT v AS level, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code, n
FROM (SELECT v, count(*) AS n FROM t GROUP BY v)
""")
def label_encode(spark, sf):
    """Null priorities are the class "nan"."""
    o = table(spark, sf, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("level"))
    out = ft.label_encode(o, ft.label_mapping(o, ["level"]))
    return out.groupBy(F.coalesce("level", F.lit("nan")).alias("level"), F.col("level_encoded").alias("code")).agg(
        F.count(F.lit(1)).alias("n"))


@query("frequency_encode", """
SELECT o_orderkey, round(count(*) OVER (PARTITION BY o_custkey) * 1.0 / count(*) OVER (), 6) AS o_custkey_freq FROM orders
""")
def frequency_encode(spark, sf):
    out = ft.frequency_encode(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])
    return out.select("o_orderkey", r6("o_custkey_freq").alias("o_custkey_freq"))


@query("text_features", rf"""
SELECT doc_id, len(w) AS text_word_count, round(len(list_distinct(w)) * 1.0 / greatest(1, len(w)), 6) AS text_unique_ratio,
       CASE WHEN regexp_matches(text, 'http|www') THEN 1 ELSE 0 END AS text_has_url,
       CASE WHEN regexp_matches(text, '[\x{{1F600}}-\x{{1F64F}}]') THEN 1 ELSE 0 END AS text_has_emoji,
       round(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) * 1.0 / greatest(1, length(text)), 6) AS text_upper_ratio
FROM (SELECT doc_id, text, {words_sql('text')} AS w FROM documents)
""")
def text_features(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = ft.text_features(docs, ["text"])
    return out.select(
        "doc_id", F.col("text_word_count").cast("long").alias("text_word_count"), "text_has_url", "text_has_emoji",
        r6("text_unique_ratio").alias("text_unique_ratio"), r6("text_upper_ratio").alias("text_upper_ratio"))


@query("url_flag", """
SELECT page_id, CASE WHEN regexp_matches(html, 'http|www') THEN 1 ELSE 0 END AS html_has_url,
       CASE WHEN regexp_matches(url, 'http|www') THEN 1 ELSE 0 END AS url_has_url FROM pages
""")
def url_flag(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.url_flag(F.col("html")).alias("html_has_url"), tx.url_flag(F.col("url")).alias("url_has_url"))


@query("datetime_parts", """
SELECT event_id, CAST(year(t) AS INTEGER) AS ts_year, CAST(month(t) AS INTEGER) AS ts_month, CAST(day(t) AS INTEGER) AS ts_day,
       CAST(hour(t) AS INTEGER) AS ts_hour, CAST(isodow(t) - 1 AS INTEGER) AS ts_weekday,
       CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END AS ts_is_weekend
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS t FROM events)
""")
def datetime_parts(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))
    return ft.datetime_parts(e, ["ts"]).drop("ts")


@query("row_meta", """
SELECT event_id, (CASE WHEN v IS NULL THEN 1 ELSE 0 END) + (CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS n_missing,
       1 + (CASE WHEN p IS NULL THEN 0 ELSE 1 END) AS n_text_cols_nonempty, 0 AS has_urls
FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS v,
             CASE WHEN user_id < 20 THEN NULL ELSE props END AS p FROM events)
""")
def row_meta(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "event_type", F.when(F.col("event_type") != "click", F.col("value")).alias("value"),
        F.when(F.col("user_id") >= 20, F.col("props")).alias("props"))
    out = ft.row_meta(ft.text_features(e, ["event_type", "props"]), ["event_type", "props"])
    return out.select("event_id", "n_missing", "n_text_cols_nonempty", "has_urls")


@query("drop_constant_features", kept_sql("lineitem", LINE_EXTRA, nulls=True))
def drop_constant_features(spark, sf):
    li = with_constants(spark, sf)
    return column_rows(ft.drop_constant(li, nulls_count=True), li)


_COPIES = {"line_copy": "CAST(l_linenumber AS DOUBLE)", "flag_copy": "l_returnflag", "line_text": "CAST(l_linenumber AS VARCHAR)"}


@query("duplicate_columns", "SELECT later, earlier FROM (" + union_sql([
    f"SELECT '{new}' AS later, '{old}' AS earlier, count(CASE WHEN {expr} IS DISTINCT FROM {old} THEN 1 END) AS differing FROM lineitem"
    for new, old, expr in (("line_copy", "l_linenumber", _COPIES["line_copy"]), ("flag_copy", "l_returnflag", "l_returnflag"),
                           ("l_tax", "l_discount", "l_tax"))
]) + ") WHERE differing = 0")
def duplicate_columns(spark, sf):
    """A number equals its wider copy by value; the same digits as text do not."""
    li = table(spark, sf, "lineitem").withColumns({
        "line_copy": F.col("l_linenumber").cast("double"), "flag_copy": F.col("l_returnflag"),
        "line_text": F.col("l_linenumber").cast("string")})
    return spark.createDataFrame(ft.duplicate_columns(li), "later string, earlier string")


_CODED = {
    "flag_code": "ascii(l_returnflag)", "status_name": "CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'filled' END",
    "line_band": "l_linenumber % 3", "flag_or_null": "CASE WHEN l_returnflag <> 'R' THEN l_returnflag END",
}
_CODED_FROM = ["l_linenumber", "l_returnflag", "l_linestatus"]


@query("recoded_columns", "SELECT later, earlier FROM (" + union_sql([
    f"SELECT '{b}' AS later, '{a}' AS earlier, count(DISTINCT x) AS dx, count(DISTINCT y) AS dy, count(DISTINCT (x, y)) AS dxy FROM "
    f"(SELECT coalesce(CAST({_CODED.get(a, a)} AS VARCHAR), '?') AS x, coalesce(CAST({_CODED.get(b, b)} AS VARCHAR), '?') AS y FROM lineitem)"
    for i, a in enumerate([*_CODED_FROM, *_CODED]) for b in [*_CODED_FROM, *_CODED][i + 1:]
]) + ") WHERE dx = dxy AND dy = dxy AND dxy > 1")
def recoded_columns(spark, sf):
    """Codes and names of flags; a coarser band is no recoding, a flag with one value missing is."""
    li = table(spark, sf, "lineitem").select(*_CODED_FROM).withColumns({
        "flag_code": F.ascii("l_returnflag"), "status_name": F.when(F.col("l_linestatus") == "O", "open").otherwise("filled"),
        "line_band": F.col("l_linenumber") % 3, "flag_or_null": F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))})
    return spark.createDataFrame(ft.recoded_columns(li), "later string, earlier string")


@query("encoders_record", """
SELECT 'o_orderpriority' AS "column", CASE WHEN count(DISTINCT o_orderpriority) <= 30 THEN 'label' ELSE 'freq' END AS type, count(DISTINCT o_orderpriority) AS size FROM orders
UNION ALL SELECT 'clerk', CASE WHEN count(DISTINCT o_custkey) <= 30 THEN 'label' ELSE 'freq' END, count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'day', CASE WHEN count(DISTINCT strftime(o_orderdate, '%m-%d')) + max(CASE WHEN day(o_orderdate) = 1 THEN 0 ELSE 0 END) <= 30 THEN 'label' ELSE 'freq' END,
  count(DISTINCT CASE WHEN day(o_orderdate) = 1 THEN 'nan' ELSE strftime(o_orderdate, '%m-%d') END) FROM orders
""")
def encoders_record(spark, sf):
    """Kind of encoder and number of its classes, missing ones included."""
    o = table(spark, sf, "orders").select(
        "o_orderpriority", F.col("o_custkey").cast("string").alias("clerk"),
        F.when(F.dayofmonth("o_orderdate") != 1, F.date_format("o_orderdate", "MM-dd")).alias("day"))
    _, meta = ft.engineer(o, {c: "categorical" for c in o.columns}, [])
    rows = [(c, m["type"], m["mapping_size"] if m["type"] == "freq" else len(m["mapping"])) for c, m in meta["categorical"].items()]
    return spark.createDataFrame(rows, "column string, type string, size long")


_LINEAGE_TAGS = {
    "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric", "o_orderdate": "datetime",
    "o_orderpriority": "categorical", "clerk": "categorical",
}


@query("feature_lineage", """
SELECT parent, derived, CAST(row_number() OVER (PARTITION BY parent ORDER BY ord) - 1 AS INTEGER) AS pos FROM (
  SELECT 'o_custkey' AS parent, 'o_custkey_z' AS derived, 0 AS ord, count(DISTINCT o_custkey) AS d FROM orders
  UNION ALL SELECT 'o_totalprice', 'o_totalprice_z', 0, count(DISTINCT o_totalprice) FROM orders
  UNION ALL SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) <= 30 THEN 'o_orderstatus_encoded' ELSE 'o_orderstatus_freq' END, 0, 2 FROM orders
  UNION ALL SELECT 'clerk', CASE WHEN count(DISTINCT o_custkey) <= 30 THEN 'clerk_encoded' ELSE 'clerk_freq' END, 0,
     count(DISTINCT n) FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
  UNION ALL SELECT 'o_orderdate', 'o_orderdate_year', 0, count(DISTINCT year(o_orderdate)) FROM orders
  UNION ALL SELECT 'o_orderdate', 'o_orderdate_month', 1, count(DISTINCT month(o_orderdate)) FROM orders
  UNION ALL SELECT 'o_orderdate', 'o_orderdate_day', 2, count(DISTINCT day(o_orderdate)) FROM orders
  UNION ALL SELECT 'o_orderdate', 'o_orderdate_hour', 3, count(DISTINCT hour(o_orderdate)) FROM orders
  UNION ALL SELECT 'o_orderdate', 'o_orderdate_weekday', 4, count(DISTINCT isodow(o_orderdate)) FROM orders
  UNION ALL SELECT 'o_orderdate', 'o_orderdate_is_weekend', 5, count(DISTINCT isodow(o_orderdate) >= 6) FROM orders
) WHERE d > 1
""")
def feature_lineage(spark, sf):
    """Lineage after engineering and pruning of orders, priority as the target."""
    written, meta = engineered_orders(spark, sf)
    _, meta = ft.prune(written, meta, ["o_orderpriority"])
    return spark.createDataFrame(meta["lineage"], ft.LINEAGE_SCHEMA)


def engineered_orders(spark, sf):
    o = table(spark, sf, "orders").withColumn("clerk", F.col("o_custkey").cast("string")).drop("o_orderkey")
    return ft.engineer(o, _LINEAGE_TAGS, ["o_orderpriority"])


