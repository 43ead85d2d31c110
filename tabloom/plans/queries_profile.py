"""Queries: sources, profiling, titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.domains import DEFAULT_DOMAIN, DEFAULT_TITLE, DOMAIN_KEYWORDS, TITLE_RULES
from tabloom.operators import cleaning as cl
from tabloom.operators import profile as pf
from tabloom.operators import sketches as sk
from tabloom.operators.facts import column_facts, unique_fraction
from tabloom.plans.registry import iso_sql, query, r6, table, union_sql
from tabloom.session import scratch_path, written
from tabloom.sources import csv, store

TABLES = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
TABLES = {t: cols.split() for t, cols in TABLES.items()}
TEXTUAL = {
    "r_name", "n_name", "c_name", "c_mktsegment", "s_name", "p_name", "p_brand", "p_type", "o_orderstatus",
    "o_orderpriority", "l_returnflag", "l_linestatus", "event_type", "props", "text", "lang", "source", "embedding", "url", "html", "role",
}
DATED = {"o_orderdate", "l_shipdate", "ts"}
CORPUS = list(TABLES)
#: Customers in one messy file: about 50 MB, as every fifth has a field of 60 KB.
FILE_ROWS = 4096


def facts_sql(tbl: str, columns: list[str]) -> str:
    """Facts of string columns, one row per column."""
    return union_sql([
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS n_unique, "
        f"avg(length({c})) AS avg_len, count(*) AS n_rows FROM {tbl}" for c in columns
    ])


def messy_lines(rows: DataFrame, files: int) -> DataFrame:
    """(file, value): customers as messy CSV lines, in files of two headers whose line comes first.

    Rows are dealt and sorted before they become lines, so what is moved and sorted stays short however long a line is.
    """
    segment = F.col("c_mktsegment")
    quoted = F.concat(F.lit('"Doe, ""'), "c_name", F.lit('""\né"'))
    name = F.when(segment == "FURNITURE", quoted).otherwise(F.col("c_name"))
    nation = F.when(segment == "HOUSEHOLD", "n/a").otherwise(F.col("c_nationkey").cast("string"))
    turned = (segment == "FURNITURE") & (F.col("c_custkey") % 2 == 0)
    header = F.when(F.col("turned"), "c_nationkey,c_mktsegment,c_name,c_custkey").otherwise("c_custkey,c_name,c_mktsegment,c_nationkey")
    line = (
        F.when(F.col("ord") == 0, header)
        .when(segment == "MACHINERY", F.concat_ws(",", "c_custkey", name))
        .when(segment == "BUILDING", F.concat_ws(",", "c_custkey", name, segment, nation, F.concat(F.lit('"'), F.repeat(F.lit("more, "), 10_000), F.lit('"'))))
        .when(segment == "AUTOMOBILE", F.concat(F.concat_ws(",", "c_custkey", name, segment, nation), F.lit(",")))
        .when(F.col("turned"), F.concat_ws(",", nation, segment, name, "c_custkey"))
        .otherwise(F.concat_ws(",", "c_custkey", name, segment, nation))
    )
    # a number, not a string: a string that may be null would be sorted once more by the writer, with the lines
    file = 2 * F.pmod(F.xxhash64("c_custkey"), F.lit(files)) + turned.cast("int")
    body = rows.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", turned.alias("turned"), file.alias("file"), F.lit(1).alias("ord"))
    heads = body.select("turned", "file").distinct().withColumn("ord", F.lit(0))
    dealt = body.unionByName(heads, allowMissingColumns=True).repartition(files, "file").sortWithinPartitions("file", "ord")
    return dealt.select("file", line.alias("value"))


@query("csv_tolerant_read", r"""
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Doe, "' || c_name || '"' || chr(10) || 'é' ELSE c_name END AS c_name,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey
FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')
""")
def csv_tolerant_read(spark, sf):
    """Customers written as messy CSV lines, by market segment: extra fields, an
    extra empty field, a very long quoted field, missing fields, quotes and line breaks,
    NA words, and files with another order of columns."""
    rows = table(spark, sf, "customer")
    path = scratch_path(spark, "messy_csv")
    # one folder per file; files grow in number, since one with line breaks in values is read by one task
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // FILE_ROWS)
    messy_lines(rows, files).write.partitionBy("file").text(path, lineSep="\n")
    return csv.read_csv(spark, path)


def _type_sql(c: str) -> str:
    """Type of a string column in SQL, as an aggregate."""
    return f"""CASE
      WHEN count({c}) = 0 THEN 'double'
      WHEN count(CASE WHEN regexp_matches({c}, '^\\s*[+-]?[0-9]+\\s*$') THEN 1 END) = count(*) THEN 'long'
      WHEN count(CASE WHEN regexp_matches({c}, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$') THEN 1 END) = count({c}) THEN 'double'
      WHEN count(CASE WHEN {c} IN ('true', 'false') THEN 1 END) = count(*) THEN 'boolean'
      ELSE 'string' END"""


@query("infer_types", union_sql([
    f"""SELECT '{c}' AS "column", {_type_sql(c)} AS type FROM (SELECT {expr} AS {c} FROM events)"""
    for c, expr in [
        ("event_id", "CAST(event_id AS VARCHAR)"), ("ts", "CAST(ts AS VARCHAR)"), ("user_id", "CAST(user_id AS VARCHAR)"),
        ("event_type", "event_type"), ("value", "CAST(value AS VARCHAR)"), ("props", "props"),
        ("big", "CASE WHEN value > 50 THEN 'true' ELSE 'false' END"),
        ("holey", "CASE WHEN event_type = 'view' THEN NULL ELSE CAST(user_id AS VARCHAR) END"),
    ]
]))
def infer_types(spark, sf):
    e = table(spark, sf, "events")
    strings = e.select([F.col(c).cast("string").alias(c) for c in e.columns])
    strings = strings.withColumns({
        "big": F.when(F.col("value").cast("double") > 50, "true").otherwise("false"),
        "holey": F.when(F.col("event_type") != "view", F.col("user_id")),
    })
    return csv.column_types(strings)


_FILED = {
    "event_id": "CAST(event_id AS VARCHAR)",
    "user_id": "CASE WHEN event_type = 'view' THEN 'u' || user_id ELSE CAST(user_id AS VARCHAR) END",
    "value": "CASE WHEN event_type = 'click' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END",
    "seen": "CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN '1' ELSE 'true' END",
    "kind": "event_type",
}


@query("infer_types_by_file", union_sql([
    f"""SELECT '{c}' AS "column", (SELECT {_type_sql(c)} FROM (SELECT {e} AS {c} FROM events)) AS type, count(*) AS n_files,
      count(CASE WHEN t <> (SELECT {_type_sql(c)} FROM (SELECT {e} AS {c} FROM events)) THEN 1 END) AS n_other
    FROM (SELECT event_type, {_type_sql(c)} AS t FROM (SELECT event_type, {e} AS {c} FROM events) GROUP BY event_type)""" for c, e in _FILED.items()]))
def infer_types_by_file(spark, sf):
    """Events written as one CSV file per kind of event, whose types conflict: states per file are stored and added up."""
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        F.col("event_id").cast("string"), F.when(kind == "view", F.concat(F.lit("u"), "user_id")).otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(kind == "click", F.round("value").cast("long").cast("string")).otherwise(F.col("value").cast("string")).alias("value"),
        F.when(kind == "click", "1").when(kind != "error", "true").alias("seen"), kind.alias("kind"), kind.alias("file"))
    path = scratch_path(spark, "files")
    rows.repartition("file").write.partitionBy("file").option("header", True).csv(path)
    strings = csv.read_csv(spark, path, file_column="_file")
    states = written(csv.type_states(strings, "_file"), "type-states")
    types = csv.merged_states(states).select("column", csv.type_rule().alias("type"))
    own = states.select("column", csv.type_rule().alias("own"))
    return own.join(F.broadcast(types), "column").groupBy("column", "type").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("own") != F.col("type")).alias("n_other"))


@query("profile_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def profile_shape(spark, sf):
    return pf.shape(table(spark, sf, "lineitem"))


@query("profile_counts", union_sql([
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS n_unique FROM orders"
    for c in TABLES["orders"]
]))
def profile_counts(spark, sf):
    return column_facts(table(spark, sf, "orders")).select("column", "non_null", "n_unique")


@query("sketch_counts", union_sql([
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS n_unique, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days, true AS close FROM orders"
    for c in TABLES["orders"]
]))
def sketch_counts(spark, sf):
    """Sketches of each day's orders, stored; a second half of the days is appended, and the union stands for the table.

    ``close``: the estimate is within the stated error of the exact number.
    """
    orders = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    halves = [written(sk.column_sketches(orders.where(F.dayofmonth(day) % 2 == k), part=day), "sketches") for k in (0, 1)]
    stored = halves[0].unionByName(halves[1])
    found = sk.estimated(sk.merged(stored)).withColumnRenamed("n_unique", "estimate").drop("n_rows")
    days = stored.agg(F.count_distinct("part").alias("n_days"))
    exact = column_facts(orders).select("column", "n_unique")
    close = F.abs(F.col("estimate") - F.col("n_unique")) <= F.greatest(F.lit(1.0), sk.ERROR * F.col("n_unique"))
    return found.join(F.broadcast(exact), "column").join(F.broadcast(days)).select("column", "non_null", "n_unique", "n_days", close.alias("close"))


@query("resume_changed_target", """
SELECT run, built, class, n FROM (
  SELECT p_brand AS class, count(*) AS n FROM part GROUP BY 1) t, (SELECT 1 AS run, 'classes,cleaned,profile' AS built UNION ALL SELECT 2, '') r
UNION ALL
SELECT 3, 'classes,cleaned', CASE WHEN rn <= 10 OR m <= 50 THEN class ELSE '__OTHER__' END, CAST(sum(n) AS BIGINT) FROM (
  SELECT *, row_number() OVER (ORDER BY n DESC, class) AS rn, count(*) OVER () AS m FROM (SELECT p_type AS class, count(*) AS n FROM part GROUP BY 1)) GROUP BY ALL
UNION ALL
SELECT 4, 'classes,cleaned,profile', p_brand, count(*) FROM part WHERE p_size > 10 GROUP BY p_brand
""")
def resume_changed_target(spark, sf):
    """Stages of one result folder: a first run, the same again, another target, and another input."""
    part = table(spark, sf, "part")
    folder, results = store.ResultStore(spark, scratch_path(spark, "results")), []
    for run, (rows, target) in enumerate([(part, "p_brand"), (part, "p_brand"), (part, "p_type"), (part.where("p_size > 10"), "p_brand")], 1):
        profiled = folder.stage("profile", lambda: pf.profile(rows), [store.table_digest(rows)])
        cleaned = folder.stage("cleaned", lambda: cl.collapse_rare_classes(rows, target), [profiled], target)
        classes = folder.stage("classes", lambda: cleaned.table.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n")), [cleaned], target)
        built = ",".join(sorted(s.name for s in (profiled, cleaned, classes) if not s.reused))
        results.append(classes.table.select(F.lit(run).alias("run"), F.lit(built).alias("built"), "class", "n"))
    return reduce(DataFrame.unionByName, results)


@query("profile_datetime_frac", union_sql([
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {iso_sql('v')} THEN 1.0 ELSE 0.0 END), 6) AS ts_frac "
    f"FROM (SELECT {expr} AS v FROM orders) WHERE v IS NOT NULL"
    for c, expr in [
        ("o_orderdate", "CAST(o_orderdate AS VARCHAR)"), ("o_orderpriority", "o_orderpriority"),
        ("mixed", "CASE WHEN o_orderstatus = 'O' THEN 'n/a' ELSE CAST(o_orderdate AS VARCHAR) END"),
    ]
]))
def profile_datetime_frac(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("string"), "o_orderpriority", "o_orderstatus")
    o = o.withColumn("mixed", F.when(F.col("o_orderstatus") == "O", "n/a").otherwise(F.col("o_orderdate")))
    return column_facts(o, ["o_orderdate", "o_orderpriority", "mixed"]).select("column", r6("ts_frac").alias("ts_frac"))


def _dtype_sql(tbl: str, columns: list[str]) -> str:
    strings = [c for c in columns if c in TEXTUAL or c in ("text", "lang", "source")]
    rule = ("CASE WHEN n_unique * 1.0 / greatest(non_null, 1) < 0.05 OR n_unique <= 30 THEN 'categorical' "
            "WHEN avg_len > 20 THEN 'text' ELSE 'categorical' END")
    parts = [f"SELECT '{tbl}' AS table_name, \"column\", {rule} AS dtype FROM ({facts_sql(tbl, strings)})"]
    for c in columns:
        if c not in strings:
            kind = "datetime" if c in DATED else "numeric"
            parts.append(f"SELECT DISTINCT '{tbl}', '{c}', '{kind}' FROM {tbl}")
    return union_sql(parts)


@query("profile_dtype", union_sql([
    _dtype_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]), _dtype_sql("customer", TABLES["customer"]),
]))
def profile_dtype(spark, sf):
    parts = [
        column_facts(table(spark, sf, t)).select(F.lit(t).alias("table_name"), "column", pf.semantic_type().alias("dtype"))
        for t in ("documents", "customer")
    ]
    return parts[0].unionByName(parts[1])


@query("profile_samples", union_sql([
    f"SELECT '{c}' AS \"column\", string_agg(CAST({c} AS VARCHAR), '|' ORDER BY p_partkey) AS samples "
    f"FROM (SELECT * FROM part WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 5)" for c in TABLES["part"]
]))
def profile_samples(spark, sf):
    found = pf.first_values(table(spark, sf, "part"), ["p_partkey"])
    return found.select("column", F.array_join("sample_values", "|").alias("samples"))


@query("profile_text_stats", f"""
SELECT "column", round(avg_len, 6) AS avg_len,
       round(CASE WHEN non_null > 0 THEN n_unique * 1.0 / non_null ELSE 0 END, 6) AS uniq_frac
FROM ({facts_sql("documents", ["text", "lang", "source"])})
""")
def profile_text_stats(spark, sf):
    facts = column_facts(table(spark, sf, "documents"), ["text", "lang", "source"])
    return facts.select("column", r6("avg_len").alias("avg_len"), r6(unique_fraction()).alias("uniq_frac"))


def _sentence_sql(tbl: str) -> str:
    columns = TABLES[tbl]
    numeric = [c for c in columns if c not in TEXTUAL and c not in DATED]
    tail = f"Contains numeric fields such as: {', '.join(numeric)}." if numeric else "No numeric fields detected."
    return (
        f"SELECT '{tbl}' AS table_name, 'Columns: {', '.join(columns)}. Rows: ' || count(*) || '. {tail}' AS summary, "
        f"'{' '.join(columns)}' AS names FROM {tbl} HAVING count(*) > 0"
    )


@query("schema_summary", f"SELECT table_name, summary FROM ({union_sql([_sentence_sql(t) for t in CORPUS])})")
def schema_summary(spark, sf):
    tables = {t: table(spark, sf, t) for t in CORPUS}
    return pf.schema_sentences(tables).select("table_name", "summary")


def first_match_sql(text: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN contains({text}, '{k}') THEN '{v}'" for k, v in rules)
    return f"CASE {whens} ELSE '{default}' END"


_DOMAIN = first_match_sql("t", DOMAIN_KEYWORDS, DEFAULT_DOMAIN)
_TITLE = first_match_sql("lower(domain)", TITLE_RULES, DEFAULT_TITLE)


@query("domain_detect", f"SELECT doc_id, {_DOMAIN} AS domain FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def domain_detect(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pf.with_domain(docs, "text").select("doc_id", "domain")


@query("domain_title", f"""
SELECT title, count(*) AS n, count(DISTINCT domain) AS n_domains FROM (
  SELECT domain, {_TITLE} AS title FROM (SELECT {_DOMAIN} AS domain FROM (SELECT lower(text) AS t FROM documents)))
GROUP BY title
""")
def domain_title(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = pf.with_domain(docs, "text").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return pf.with_title(counted).groupBy("title").agg(F.sum("n").alias("n"), F.count("domain").alias("n_domains"))


@query("title_corpus", f"""
SELECT summary AS csv_data_summary, {_TITLE} AS title FROM (
  SELECT summary, {_DOMAIN} AS domain FROM (
    SELECT summary, lower(summary || ' ' || names) AS t FROM ({union_sql([_sentence_sql(t) for t in CORPUS])})))
""")
def title_corpus(spark, sf):
    """Written as JSON lines and read back."""
    path = scratch_path(spark, "title_corpus")
    store.write_corpus(pf.title_corpus({t: table(spark, sf, t) for t in CORPUS}), path)
    return store.read_corpus(spark, path)


@query("preview_rows", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 5")
def preview_rows(spark, sf):
    return pf.preview(table(spark, sf, "nation"), ["n_nationkey"])
