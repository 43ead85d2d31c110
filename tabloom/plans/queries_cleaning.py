"""Queries: cleaning, validation, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import cleaning as cl
from tabloom.operators import layouts as ly
from tabloom.operators.facts import column_facts
from tabloom.operators.sentiment import append_secondary, existing_label_facts
from tabloom.plans.queries_profile import TABLES, TEXTUAL
from tabloom.plans.registry import query, r6, table, union_sql
from tabloom.settings import PROSE_WORDS

LABEL_SQL = "CASE event_type WHEN 'purchase' THEN ' Positive' WHEN 'error' THEN 'NEG ' WHEN 'view' THEN 'neutral' ELSE 'pos' END"


def labelled_events(spark, sf):
    """Events with a label column derived from the event type."""
    kind = F.col("event_type")
    return table(spark, sf, "events").withColumn(
        "mood",
        F.when(kind == "purchase", " Positive").when(kind == "error", "NEG ").when(kind == "view", "neutral").otherwise("pos"),
    )


@query("fix_datetime_numeric", """
SELECT l_returnflag, sum(CAST(l_partkey AS DOUBLE)) AS sum_part, count(*) AS n,
       min(strftime(l_shipdate, '%Y-%m-%d')) AS first_ship
FROM lineitem GROUP BY l_returnflag
""")
def fix_datetime_numeric(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_partkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))
    fixed = cl.repair_datetime_numeric(li, ["l_partkey", "l_shipdate"])
    return fixed.groupBy("l_returnflag").agg(
        F.sum("l_partkey").alias("sum_part"), F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_ship"))


@query("fix_numeric_datetime", """
SELECT event_type, strftime(date_trunc('millisecond', min(ts)), '%Y-%m-%d %H:%M:%S') AS first_ts,
       strftime(date_trunc('millisecond', max(ts)), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n
FROM events GROUP BY event_type
""")
def fix_numeric_datetime(spark, sf):
    """Event times as epoch milliseconds, repaired because the unit is declared."""
    e = table(spark, sf, "events").select(
        "event_type",
        F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("at"))
    fixed = cl.repair_numeric_datetime(e, {"at": "ms"})
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return fixed.groupBy("event_type").agg(
        shown(F.min("at")).alias("first_ts"), shown(F.max("at")).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def kept_sql(tbl, expressions, nulls: bool) -> str:
    extra = "+ (CASE WHEN count(v) < count(*) THEN 1 ELSE 0 END)" if nulls else ""
    return "SELECT \"column\" FROM (" + union_sql([
        f"SELECT '{c}' AS \"column\", count(DISTINCT v) {extra} AS d FROM (SELECT {e} AS v FROM {tbl})"
        for c, e in expressions
    ]) + ") WHERE d > 1"


LINE_EXTRA = [(c, c) for c in TABLES["lineitem"]] + [
    ("one_value", "'x'"), ("nothing", "CAST(NULL AS VARCHAR)"), ("value_or_null", "CASE WHEN l_returnflag = 'R' THEN 'r' END"),
]


def with_constants(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumns({
        "one_value": F.lit("x"), "nothing": F.lit(None).cast("string"),
        "value_or_null": F.when(F.col("l_returnflag") == "R", "r"),
    })


def column_rows(df, source):
    """Column names left, as rows; ``source`` keeps the result tied to the data."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return source.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.explode(names).alias("column"))


@query("drop_constant_cols", kept_sql("lineitem", LINE_EXTRA, nulls=False))
def drop_constant_cols(spark, sf):
    li = with_constants(spark, sf)
    return column_rows(cl.drop_constant(li), li)


def _id_sql(tbl: str, key: str) -> str:
    words = r"\b(" + "|".join(PROSE_WORDS) + r")\b"
    parts = []
    for c in TABLES[tbl]:
        if c in TEXTUAL:
            sample = (
                f"(SELECT coalesce(bool_or(regexp_matches(lower({c}), '{words}')), false) FROM (SELECT {c} FROM {tbl} "
                f"WHERE {c} IS NOT NULL ORDER BY md5('42:' || {key}), {key} LIMIT 200))"
            )
            name = "true" if c.endswith(("id", "uuid", "guid", "hash", "code", "key")) else "false"
            parts.append(f"""
            SELECT '{c}' AS "column", score, (score >= 3 AND NOT text_like) AS is_id FROM (
              SELECT (CASE WHEN {name} THEN 1 ELSE 0 END)
                   + (CASE WHEN stddev_samp(length({c})) < 2 THEN 1 ELSE 0 END)
                   + (CASE WHEN avg(CASE WHEN regexp_matches({c}, '^[A-Za-z0-9_-]+$') THEN 1.0 ELSE 0 END) > 0.7 THEN 1 ELSE 0 END)
                   + (CASE WHEN avg(length({c})) BETWEEN 8 AND 40 THEN 1 ELSE 0 END) AS score,
                   avg(CASE WHEN regexp_matches({c}, '\\s') THEN 1.0 ELSE 0 END) > 0.05 OR {sample} AS text_like
              FROM {tbl} WHERE {c} IS NOT NULL)""")
        elif c != "o_orderdate":
            parts.append(
                f"SELECT '{c}' AS \"column\", CAST(NULL AS INTEGER) AS score, "
                f"count(DISTINCT {c}) * 1.0 / count({c}) > 0.95 AS is_id FROM {tbl}")
    return union_sql(parts)


@query("id_column_score", union_sql([
    _id_sql("customer", "c_custkey"), _id_sql("orders", "o_orderkey"), _id_sql("part", "p_partkey")]))
def id_column_score(spark, sf):
    parts = []
    for t, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey")):
        scored = cl.id_scores(table(spark, sf, t).drop("o_orderdate"), [key])
        shown = F.when(F.col("physical") == "string", F.col("score"))
        parts.append(scored.select("column", shown.alias("score"), "is_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_IDENTITY = {"c_custkey": "c_custkey", "c_username": "c_name", "c_nationkey": "c_nationkey", "Player_Level": "c_acctbal", "c_mktsegment": "c_mktsegment"}


@query("drop_identity_cols", f"""
SELECT name AS "column", n, n_unique FROM ({union_sql([f"SELECT '{c}' AS name, count({e}) AS n, count(DISTINCT {e}) AS n_unique FROM customer" for c, e in _IDENTITY.items()])})
WHERE NOT regexp_matches(lower(name), '(username|user_name|author|profile|player)')
""")
def drop_identity_cols(spark, sf):
    """What is left, with the counts of its values."""
    c = table(spark, sf, "customer").select(*[F.col(e).alias(n) for n, e in _IDENTITY.items()])
    return column_facts(cl.drop_identity_names(c)).select("column", F.col("non_null").alias("n"), "n_unique")


_LAID = {"day_first": "%d/%m/%Y", "month_first": "%m/%d/%Y", "in_words": "%-d %B %Y", "timed": "%d.%m.%Y %H:%M:%S"}


def _election_sql(c: str, form: str) -> str:
    """The layout that more cells fit, of the two that a column could have."""
    other, names = {
        "day_first": ("%m/%d/%Y", ("day/month/year", "month/day/year")), "month_first": ("%d/%m/%Y", ("month/day/year", "day/month/year")),
        "in_words": ("%Y-%m-%d", ("day month year", "iso")), "timed": ("%Y-%m-%d", ("day.month.year", "iso"))}[c]
    fits = lambda f: f"count(try_strptime(x, '{f}'))"
    return f"""SELECT '{c}' AS "column", CASE WHEN {fits(form)} > {fits(other)} THEN '{names[0]}' ELSE '{names[1]}' END AS layout,
      greatest({fits(form)}, {fits(other)}) AS fitting, count(x) AS non_null,
      CAST(sum(day(try_strptime(x, '{form}'))) AS BIGINT) AS days, CAST(sum(month(try_strptime(x, '{form}'))) AS BIGINT) AS months, CAST(sum(hour(try_strptime(x, '{form}'))) AS BIGINT) AS hours
    FROM (SELECT CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_custkey % 10 = 0 THEN 'n/a' ELSE strftime(o_orderdate + INTERVAL 1 HOUR * CAST(o_orderkey % 24 AS INTEGER), '{form}') END AS x FROM orders)"""


@query("datetime_layouts", union_sql([_election_sql(c, f) for c, f in _LAID.items()]))
def datetime_layouts(spark, sf):
    """Dates as text in four layouts, days before and after months, with missing and odd cells: each column's layout, and its parsed parts."""
    stamp = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    forms = {"day_first": "dd/MM/yyyy", "month_first": "MM/dd/yyyy", "in_words": "d MMMM yyyy", "timed": "dd.MM.yyyy HH:mm:ss"}
    cell = lambda f: F.when(F.col("o_custkey") % 9 == 0, None).when(F.col("o_custkey") % 10 == 0, "n/a").otherwise(F.date_format(stamp, f))
    texts = table(spark, sf, "orders").select(*[cell(f).alias(c) for c, f in forms.items()])
    found = ly.elect(texts, list(forms))
    parsed = texts.select(*[ly.parsed(F.col(c), e.layout).alias(c) for c, e in found.items()])
    sums = parsed.agg(*[F.sum(part(c)).cast("long").alias(f"{name}_{c}") for c in forms for name, part in (("days", F.dayofmonth), ("months", F.month), ("hours", F.hour))])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(e.layout).alias("layout"), F.lit(e.fitting).cast("long").alias("fitting"), F.lit(e.non_null).cast("long").alias("non_null"),
                 *[F.col(f"{n}_{c}").alias(n) for n in ("days", "months", "hours")]) for c, e in found.items()])))


@query("normalize_datetime", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, CAST(0 AS BIGINT) AS load_columns
FROM orders GROUP BY 1
""")
def normalize_datetime(spark, sf):
    """Order dates as text become timestamps; a one-day load time is dropped."""
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("string"), "o_totalprice").withColumn(
        "load_time", F.concat(F.lit("2024-01-01 0"), (F.col("o_totalprice").cast("long") % 10).cast("string"), F.lit(":00:00")))
    fixed = cl.normalize_datetimes(o)
    left = sum(c == "load_time" for c in fixed.columns)
    return fixed.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "load_columns", F.lit(left).cast("long"))


@query("targets_meta", """
SELECT 'orders.csv' AS file, 'o_custkey' AS "primary", 'o_totalprice|o_orderstatus' AS secondary, 'classification' AS type,
       CASE WHEN d > 50 THEN 'collapsed to top 10 classes' ELSE '' END AS auto_changes, d > 50 AS needs_review
FROM (SELECT count(DISTINCT o_custkey) AS d FROM orders)
""")
def targets_meta(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    _, _, record = cl.clean(o, ["o_orderkey"], "orders", "o_custkey", ["o_totalprice", "o_orderstatus", "o_orderpriority"],
                            "classification")
    row = [(record["file"], record["primary"], "|".join(record["secondary"]), record["type"],
            "|".join(record["auto_changes"]), record["needs_review"])]
    return spark.createDataFrame(row, "file string, primary string, secondary string, type string, auto_changes string, needs_review boolean")


@query("collapse_rare_classes", """
WITH t AS (SELECT CAST(l_partkey AS VARCHAR) AS v FROM lineitem),
top AS (SELECT v FROM t GROUP BY v ORDER BY count(*) DESC, v LIMIT 10)
SELECT CASE WHEN v IN (SELECT v FROM top) THEN v ELSE '__OTHER__' END AS class, count(*) AS n FROM t GROUP BY 1
""")
def collapse_rare_classes(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("class"))
    return cl.collapse_rare_classes(li, "class").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("encode_target_first_seen", """
WITH codes AS (
  SELECT v, CAST(row_number() OVER (ORDER BY first_row) - 1 AS INTEGER) AS code FROM (
    SELECT CAST(o_custkey AS VARCHAR) AS v, min(o_orderkey) AS first_row FROM orders GROUP BY 1)),
levels AS (
  SELECT v, CAST(row_number() OVER (ORDER BY first_row) - 1 AS INTEGER) AS code FROM (
    SELECT o_orderpriority AS v, min(o_orderkey) AS first_row FROM orders GROUP BY 1))
SELECT o_orderkey, c.code AS cust_code, l.code AS priority_code
FROM orders JOIN codes c ON CAST(o_custkey AS VARCHAR) = c.v JOIN levels l ON o_orderpriority = l.v
""")
def encode_target_first_seen(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("cust_code"), F.col("o_orderpriority").alias("priority_code"))
    once = cl.encode_first_seen(o, "cust_code", ["o_orderkey"])
    return cl.encode_first_seen(once, "priority_code", ["o_orderkey"])


@query("detect_sentiment_cols", f"""
SELECT 'event_type' AS "column", count(event_type) AS non_null, 0.0 AS matched_frac, false AS is_existing FROM events
UNION ALL SELECT 'props', count(props), 0.0, false FROM events
UNION ALL
SELECT 'mood', count(v), round(avg(CASE WHEN regexp_matches(lower(trim(v)), '^(positive|negative|neutral|pos|neg|neu)$') THEN 1.0 ELSE 0 END), 6),
  avg(CASE WHEN regexp_matches(lower(trim(v)), '^(positive|negative|neutral|pos|neg|neu)$') THEN 1.0 ELSE 0 END) >= 0.9 AND count(v) >= 30
FROM (SELECT {LABEL_SQL} AS v FROM events)
""")
def detect_sentiment_cols(spark, sf):
    found = existing_label_facts(labelled_events(spark, sf))
    return found.withColumn("matched_frac", r6("matched_frac"))


@query("targets_append", f"""
SELECT 'value' AS "primary", CASE WHEN ok THEN 'event_type|mood' ELSE 'event_type' END AS secondary FROM (
  SELECT avg(CASE WHEN lower(trim({LABEL_SQL})) IN ('positive', 'negative', 'neutral', 'pos', 'neg', 'neu') THEN 1.0 ELSE 0 END) >= 0.9
         AND count(*) >= 30 AS ok FROM events)
""")
def targets_append(spark, sf):
    found = existing_label_facts(labelled_events(spark, sf)).where("is_existing").select("column").collect()
    record = append_secondary(cl.targets_record("events", "value", ["event_type"], "regression"), [r["column"] for r in found])
    return spark.createDataFrame([(record["primary"], "|".join(record["secondary"]))], "primary string, secondary string")


