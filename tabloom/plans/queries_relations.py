"""Queries: pairwise statistics, relations, charts, responses, report."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions import text as tx
from tabloom.functions.special import p_value_udf
from tabloom.operators import charts as ch
from tabloom.operators import features as ft
from tabloom.operators import profile as pf
from tabloom.operators import relations as rl
from tabloom.operators import responses as rs
from tabloom.operators import sentiment as st
from tabloom.operators import stats
from tabloom.plans.queries_features import engineered_orders
from tabloom.plans.queries_profile import TABLES, TEXTUAL
from tabloom.plans.registry import query, r6, table, union_sql, words_sql

# ------------------------------------------------------------------ statistics


@query("effective_type", union_sql([
    f"""SELECT '{c}' AS "column", CASE WHEN avg(len({words_sql(c)})) < 3 AND count(DISTINCT {c}) <= 50 THEN 'categorical'
        ELSE 'text' END AS kind FROM {t}""" if c in TEXTUAL else
    f"SELECT DISTINCT '{c}', '{'datetime' if c == 'l_shipdate' else 'numeric'}' FROM {t}"
    for t in ("lineitem", "part") for c in TABLES[t]
]).replace("SELECT DISTINCT 'l_orderkey', 'numeric' FROM", "SELECT DISTINCT 'l_orderkey' AS \"column\", 'numeric' AS kind FROM", 1))
def effective_type(spark, sf):
    rows = [(f["column"], f["kind"]) for t in ("lineitem", "part") for f in rl.type_facts(table(spark, sf, t))]
    return spark.createDataFrame(rows, "column string, kind string")


NUMERIC_PAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"), ("l_quantity", "l_linenumber")]
DISCOUNT_HOLES = "CASE WHEN l_returnflag = 'R' OR l_linenumber = 1 THEN NULL ELSE l_discount END"


def _lineitem(spark, sf):
    """With a column that has nulls and, which counts as missing too, NaN."""
    li = table(spark, sf, "lineitem")
    some = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return li.withColumn("holey", F.when(F.col("l_returnflag") != "R", some))


@query("pair_counts", union_sql([
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n FROM (SELECT *, {DISCOUNT_HOLES} AS holey FROM lineitem) WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in NUMERIC_PAIRS + [("holey", "l_tax")]]))
def pair_counts(spark, sf):
    return stats.pair_counts(_lineitem(spark, sf), NUMERIC_PAIRS + [("holey", "l_tax")]).drop("pair")


@query("pearson", union_sql([
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM (SELECT *, {DISCOUNT_HOLES} AS holey FROM lineitem) WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in NUMERIC_PAIRS + [("holey", "l_tax")]]))
def pearson(spark, sf):
    return stats.pearson(_lineitem(spark, sf), NUMERIC_PAIRS + [("holey", "l_tax")]).select("a", "b", "n", r6("r").alias("r"))


def spearman_sql(a: str, b: str, source: str) -> str:
    """n and rho of the complete pairs, average ranks."""
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return (f"SELECT count(*) AS n, corr(ra, rb) AS rho FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb "
            f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@query("spearman", union_sql([
    f"SELECT '{a}' AS a, '{b}' AS b, n, round(rho, 6) AS r FROM ({spearman_sql(a, b, f'(SELECT *, {DISCOUNT_HOLES} AS holey FROM lineitem)')})"
    for a, b in NUMERIC_PAIRS + [("holey", "l_tax")]]))
def spearman(spark, sf):
    """Shared ranks for the complete columns, own ranks for the pair with nulls."""
    return stats.spearman(_lineitem(spark, sf), NUMERIC_PAIRS + [("holey", "l_tax")]).select("a", "b", "n", r6("r").alias("r"))


def cramers_sql(a: str, b: str, source: str) -> str:
    return f"""
    WITH c AS (SELECT coalesce(CAST({a} AS VARCHAR), '__MISSING__') AS x, coalesce(CAST({b} AS VARCHAR), '__MISSING__') AS y,
                      CAST(count(*) AS DOUBLE) AS o FROM {source} GROUP BY 1, 2),
    m AS (SELECT o, sum(o) OVER (PARTITION BY x) AS r, sum(o) OVER (PARTITION BY y) AS k FROM c),
    t AS (SELECT sum(o) AS n, sum(o * o / (r * k)) AS s FROM m),
    d AS (SELECT least(count(DISTINCT x), count(DISTINCT y)) - 1 AS q, count(DISTINCT x) AS rl, count(DISTINCT y) AS cl FROM c)
    SELECT CAST(n AS BIGINT) AS n, greatest(n * (s - 1), 0) AS chi2,
           sqrt(greatest(n * (s - 1), 0) / (CASE WHEN q > 0 THEN n * q ELSE 1 END)) AS v, rl, cl FROM t, d"""


_CAT_PAIRS = [("o_orderstatus", "o_orderpriority"), ("missing_status", "o_orderpriority"), ("o_custkey", "o_orderstatus")]
_ORDERS_PLUS = "(SELECT *, CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_orderstatus END AS missing_status FROM orders)"


@query("cramers_v", union_sql([
    f"SELECT '{a}' AS a, '{b}' AS b, n, round(chi2, 4) AS chi2, round(v, 6) AS effect, rl AS r_levels, cl AS c_levels FROM ({cramers_sql(a, b, _ORDERS_PLUS)})"
    for a, b in _CAT_PAIRS]))
def cramers_v(spark, sf):
    o = table(spark, sf, "orders")
    o = o.withColumn("missing_status", F.when(F.col("o_totalprice") <= 300000, F.col("o_orderstatus")))
    out = stats.cramers_v(o, _CAT_PAIRS)
    return out.select("a", "b", "n", F.round("chi2", 4).alias("chi2"), r6("effect").alias("effect"), "r_levels", "c_levels")


def anova_sql(y: str, g: str, source: str) -> str:
    return f"""
    WITH s AS (SELECT CAST({y} AS DOUBLE) AS y, {g} AS g FROM {source} WHERE {y} IS NOT NULL AND {g} IS NOT NULL),
    t AS (SELECT avg(y) AS m, count(*) AS n, var_pop(y) * count(*) AS total FROM s),
    gm AS (SELECT g, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS w FROM s GROUP BY g),
    b AS (SELECT sum(gm.n * (gm.m - t.m) * (gm.m - t.m)) AS between, sum(gm.w) AS within, count(*) AS k, max(gm.m) AS top, min(gm.m) AS bottom FROM gm, t)
    SELECT n, k AS groups, between / total AS eta2, (between / (k - 1)) / (within / (n - k)) AS f, top, bottom FROM b, t"""


_ANOVA_PAIRS = [("l_quantity", "l_returnflag"), ("l_extendedprice", "l_linestatus"), ("l_tax", "l_returnflag"), ("l_discount", "l_suppkey"), ("holey", "l_linestatus")]


@query("anova_eta2", union_sql([
    f"SELECT '{a}' AS a, '{b}' AS b, n, groups, round(eta2, 6) AS effect, round(f, 4) AS f FROM ({anova_sql(a, b, f'(SELECT *, {DISCOUNT_HOLES} AS holey FROM lineitem)')})"
    for a, b in _ANOVA_PAIRS]))
def anova_eta2(spark, sf):
    out = stats.anova(_lineitem(spark, sf), _ANOVA_PAIRS)
    return out.select("a", "b", "n", "groups", r6("effect").alias("effect"), F.round("f", 4).alias("f"))


@query("test_p_values", f"""
SELECT 'anova' AS test, round(pow(1 + 2 * f / (n - groups), -(n - groups) / 2.0), 6) AS p_value FROM ({anova_sql('l_quantity', 'l_returnflag', 'lineitem')})
UNION ALL SELECT 'cramers_v', round(exp(-chi2 / 2), 6) FROM ({cramers_sql('l_returnflag', 'l_linestatus', 'lineitem')})
""")
def test_p_values(spark, sf):
    """Tests with two degrees of freedom, whose tails SQL can express: three classes against numbers and against two."""
    li = table(spark, sf, "lineitem")
    f = stats.anova(li, [("l_quantity", "l_returnflag")]).select(F.lit("anova").alias("test"), p_value_udf(F.lit("f"), "f", "df1", "df2").alias("p_value"))
    none = F.lit(None).cast("double")
    chi2 = stats.cramers_v(li, [("l_returnflag", "l_linestatus")]).select(
        F.lit("cramers_v").alias("test"), p_value_udf(F.lit("chi2"), "chi2", "dof", none).alias("p_value"))
    return f.unionByName(chi2).select("test", r6("p_value").alias("p_value"))


@query("group_mean_direction", """
SELECT round(max(m), 6) AS top_mean, round(min(m), 6) AS bottom_mean, CASE WHEN max(m) > min(m) THEN 'positive' ELSE 'negative' END AS direction
FROM (SELECT avg(value) AS m FROM events GROUP BY event_type)
""")
def group_mean_direction(spark, sf):
    out = stats.anova(table(spark, sf, "events"), [("value", "event_type")])
    way = F.when(F.col("top_mean") > F.col("bottom_mean"), "positive").otherwise("negative")
    return out.select(r6("top_mean").alias("top_mean"), r6("bottom_mean").alias("bottom_mean"), way.alias("direction"))


@query("spearman_time_hour", f"SELECT n, round(rho, 6) AS r FROM ({spearman_sql('value', 'h', '(SELECT value, hour(ts) AS h FROM events)')})")
def spearman_time_hour(spark, sf):
    return stats.spearman_time_hour(table(spark, sf, "events"), [("value", "ts")]).select("n", r6("r").alias("r"))


# ------------------------------------------------------------------- relations

_RELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"]


def _upper_beta_sql(a: str, b: str, y: str) -> str:
    """1 - I_y(a, b), the tail of t and F: the series of the regularised beta function, whose terms are all positive.

    600 terms do where (a + b) y stays below 100; beyond, the tail is less than 1e-30.
    """
    term = f"exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({a} + 1 + k) + lgamma({a} + 1) + k * ln({y}))"
    front = f"exp({a} * ln({y}) + {b} * ln(1 - {y}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}))"
    return (f"CASE WHEN {y} <= 0 THEN 1.0 WHEN ({a} + {b}) * {y} > 100 THEN 0.0 "
            f"ELSE greatest(0.0, 1 - {front} * list_sum(list_transform(range(0, 600), lambda k: {term}))) END")


def _upper_gamma_sql(a: str, x: str) -> str:
    """1 - P(a, x), the tail of chi2, by its series."""
    term = f"exp(lgamma({a} + 1) - lgamma({a} + 1 + k) + k * ln({x}))"
    return (f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 100 + 3 * {a} THEN 0.0 "
            f"ELSE greatest(0.0, 1 - exp({a} * ln({x}) - {x} - lgamma({a} + 1)) * list_sum(list_transform(range(0, 600), lambda k: {term}))) END")


def _relation_sql(a: str, b: str) -> str:
    kinds = {"l_returnflag": "c", "l_linestatus": "c", "l_shipdate": "t"}
    ka, kb = kinds.get(a, "n"), kinds.get(b, "n")
    head = f"SELECT '{a}' AS parent_a, '{b}' AS parent_b, "
    by_rank = ("CASE WHEN isnan(rho) THEN NULL ELSE rho END AS effect_size, n, CASE WHEN rho > 0 THEN 'positive' ELSE 'negative' END AS direction, "
               f"CASE WHEN isnan(rho) THEN NULL ELSE {_upper_beta_sql('0.5', '((n - 2) / 2.0)', '(rho * rho)')} END AS p_value")
    if ka == kb == "n":
        return head + f"'spearman' AS method, {by_rank} FROM ({spearman_sql(a, b, 'lineitem')})"
    if {ka, kb} == {"n", "t"}:
        y = a if ka == "n" else b
        return head + f"'spearman_time_hour', {by_rank} FROM ({spearman_sql(y, 'h', '(SELECT *, hour(l_shipdate) AS h FROM lineitem)')})"
    if "n" in (ka, kb):
        y, g = (a, b) if ka == "n" else (b, a)
        p = _upper_beta_sql("((groups - 1) / 2.0)", "((n - groups) / 2.0)", "((groups - 1) * f / ((groups - 1) * f + n - groups))")
        return head + f"'anova_eta2', eta2, n, CASE WHEN top > bottom THEN 'positive' ELSE 'negative' END, {p} FROM ({anova_sql(y, g, 'lineitem')})"
    return head + f"'cramers_v', v, n, CAST(NULL AS VARCHAR), {_upper_gamma_sql('((rl - 1) * (cl - 1) / 2.0)', '(chi2 / 2)')} FROM ({cramers_sql(a, b, 'lineitem')})"


def _planned_relations(spark, sf):
    li = table(spark, sf, "lineitem").select(*_RELATED)
    facts = rl.type_facts(li)
    kinds = {f["column"]: f["kind"] for f in facts}
    reps = rl.representatives(li.columns, kinds, [])
    numeric = {c for c, k in kinds.items() if k == "numeric"}
    pairs = rl.plan_pairs(li, reps, facts, "l_quantity", ["l_returnflag"], numeric)
    return li, kinds, pairs, facts


_PAIR_PLAN = (
    [("l_quantity", c) for c in sorted(_RELATED) if c != "l_quantity"]
    + [("l_returnflag", c) for c in sorted(_RELATED) if c not in ("l_returnflag", "l_quantity")]
)
_TOP_PAIR = ("l_extendedprice", "l_discount")
_HOURS = "(SELECT count(DISTINCT hour(l_shipdate)) AS hours FROM lineitem)"


_ALL_RELATIONS = union_sql([_relation_sql(a, b) for a, b in _PAIR_PLAN + [_TOP_PAIR]])


@query("compute_relations", f"""
WITH r AS ({_ALL_RELATIONS}),
t AS (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p_value) + count(*) OVER (PARTITION BY p_value) - 1 AS rk FROM r WHERE p_value IS NOT NULL),
q AS (SELECT *, least(min(p_value * m / rk) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS adj FROM t)
SELECT r.parent_a, r.parent_b, CASE WHEN r.effect_size IS NULL THEN NULL ELSE r.method END AS method, round(r.effect_size, 6) AS effect_size, r.n,
  CASE WHEN r.effect_size IS NULL THEN NULL ELSE r.direction END AS direction, round(r.p_value, 6) AS p_value, round(q.adj, 6) AS adjusted_p_value
FROM r LEFT JOIN q ON r.parent_a = q.parent_a AND r.parent_b = q.parent_b
""")
def compute_relations(spark, sf):
    """Every test family at once: pairs planned from the data, one pass for all families, and one that brings ranks to rows."""
    li, kinds, pairs, facts = _planned_relations(spark, sf)
    out = stats.benjamini_hochberg(rl.compute(li, pairs, kinds, facts=facts))
    return out.select("parent_a", "parent_b", "method", "n", "direction", *[r6(c).alias(c) for c in ("effect_size", "p_value", "adjusted_p_value")])


_FACTS_SQL = union_sql([
    f"SELECT '{c}' AS c, count(DISTINCT {c}) + (CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END) AS levels, "
    + (f"stddev_samp({c})" if c in ("l_quantity", "l_extendedprice", "l_discount") else "CAST(NULL AS DOUBLE)") + " AS sd FROM lineitem" for c in _RELATED])


@query("relation_pairs", f"""
WITH f AS (SELECT * FROM ({_FACTS_SQL}) WHERE levels > 1),
top AS (SELECT c, row_number() OVER (ORDER BY round(sd, 9) DESC, c) AS k FROM f WHERE sd IS NOT NULL QUALIFY k <= 6),
planned AS (
  SELECT t.c AS parent_a, f.c AS parent_b, 1 AS step FROM f t, f WHERE t.c = 'l_quantity' AND f.c <> t.c
  UNION ALL SELECT t.c, f.c, 2 FROM f t, f WHERE t.c = 'l_returnflag' AND f.c NOT IN (t.c, 'l_quantity')
  UNION ALL SELECT a.c, b.c, 3 FROM top a, top b WHERE a.k < b.k)
SELECT arg_min(parent_a, step) AS parent_a, arg_min(parent_b, step) AS parent_b FROM planned GROUP BY least(parent_a, parent_b), greatest(parent_a, parent_b)
""")
def relation_pairs(spark, sf):
    _, _, pairs, _ = _planned_relations(spark, sf)
    rows = [(a, b) for a, b, _, _ in pairs]
    return spark.createDataFrame(rows, "parent_a string, parent_b string")


_VARIES = lambda e: f"(SELECT count(DISTINCT {e}) FROM orders) > 1"


@query("representatives", f"""
WITH made(parent, feature, preference, there) AS (
  SELECT 'o_custkey', 'o_custkey_z', 1, {_VARIES('o_custkey')} UNION ALL SELECT 'o_totalprice', 'o_totalprice_z', 1, {_VARIES('o_totalprice')}
  UNION ALL SELECT 'o_orderstatus', 'o_orderstatus_encoded', 1, (SELECT count(DISTINCT o_orderstatus) FROM orders) BETWEEN 2 AND 30
  UNION ALL SELECT 'o_orderstatus', 'o_orderstatus_freq', 2, (SELECT count(DISTINCT n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus HAVING (SELECT count(DISTINCT o_orderstatus) FROM orders) > 30)) > 1
  UNION ALL SELECT 'clerk', 'clerk_encoded', 1, (SELECT count(DISTINCT o_custkey) FROM orders) BETWEEN 2 AND 30
  UNION ALL SELECT 'clerk', 'clerk_freq', 2, (SELECT count(DISTINCT o_custkey) FROM orders) > 30 AND (SELECT count(DISTINCT n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) > 1
  UNION ALL SELECT 'o_orderdate', 'o_orderdate_year', 1, {_VARIES('year(o_orderdate)')} UNION ALL SELECT 'o_orderdate', 'o_orderdate_month', 2, {_VARIES('month(o_orderdate)')}
  UNION ALL SELECT 'o_orderdate', 'o_orderdate_day', 3, {_VARIES('day(o_orderdate)')} UNION ALL SELECT 'o_orderdate', 'o_orderdate_weekday', 4, {_VARIES('isodow(o_orderdate)')}
  UNION ALL SELECT c, c, 9, true FROM (SELECT unnest(['o_custkey', 'o_totalprice', 'o_orderstatus', 'clerk', 'o_orderdate', 'o_orderpriority']) AS c))
SELECT parent, arg_min(feature, preference) AS representative FROM made WHERE there AND (SELECT count(*) FROM orders) > 0 GROUP BY parent
""")
def representatives(spark, sf):
    written, meta = engineered_orders(spark, sf)
    table_, meta = ft.prune(written, meta, ["o_orderpriority"])
    kinds = {f["column"]: f["kind"] for f in rl.type_facts(table_)}
    reps = rl.representatives(table_.columns, kinds, meta["lineage"])
    return spark.createDataFrame(list(reps.items()), "parent string, representative string")


# relations derived from the data whose p is a plain expression, so SQL can follow
_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey"]
_MEASURE_PAIRS = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1:]]
_REL_SQL = ("SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus, parent_a, parent_b) AS seq, * FROM (" + union_sql([
    f"SELECT l_returnflag, l_linestatus, '{a}' AS parent_a, '{b}' AS parent_b, corr({a}, {b}) AS effect_size, count(*) AS n, "
    f"exp(-count(*) * corr({a}, {b}) * corr({a}, {b}) / 2.0) AS p_value FROM lineitem GROUP BY ALL" for a, b in _MEASURE_PAIRS]) + ")")


def _derived_relations(spark, sf):
    """Correlation of every measure pair per return flag and line status: the
    number of rows depends on the columns and flags, not on the table size."""
    li = table(spark, sf, "lineitem")
    aggs = [F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(_MEASURE_PAIRS)]
    wide = li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), *aggs)
    items = F.array(*[
        F.struct(F.lit(a).alias("parent_a"), F.lit(b).alias("parent_b"), F.col(f"r{i}").alias("effect_size"))
        for i, (a, b) in enumerate(_MEASURE_PAIRS)])
    long = wide.select("l_returnflag", "l_linestatus", "n", F.inline(items))
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("l_returnflag", "l_linestatus", "parent_a", "parent_b"))
    p = F.exp(-F.col("n") * F.col("effect_size") * F.col("effect_size") / 2.0)
    return long.withColumn("p_value", p).withColumn("seq", order).withColumns({
        "feature_a": F.col("parent_a"), "feature_b": F.col("parent_b"), "method": F.lit("pearson"),
        "direction": F.when(F.col("effect_size") > 0, "positive").otherwise("negative"), "notes": F.lit(None).cast("string")})


def _bh_sql(source: str) -> str:
    return f"""
    SELECT *, least(min(p_value * m / rk) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS adj
    FROM (SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY p_value) + count(*) OVER (PARTITION BY p_value) - 1 AS rk FROM ({source}))"""


@query("fdr_bh", f"SELECT seq, round(adj, 6) AS adjusted_p_value, adj <= 0.05 AS significant_fdr FROM ({_bh_sql(_REL_SQL)})")
def fdr_bh(spark, sf):
    out = stats.benjamini_hochberg(_derived_relations(spark, sf))
    return out.select(F.col("seq").cast("long").alias("seq"), r6("adjusted_p_value").alias("adjusted_p_value"), "significant_fdr")


_WEIGHTED = f"""
SELECT *, (CASE WHEN 'l_quantity' IN (parent_a, parent_b) THEN 3 ELSE 0 END)
        + (CASE WHEN 'l_tax' IN (parent_a, parent_b) THEN 2 ELSE 0 END) AS w FROM ({_REL_SQL})"""
_BEST = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_a, parent_b
   ORDER BY abs(effect_size) * (1 + w) * (1 - least(1, p_value)) DESC, seq) AS rn FROM ({_WEIGHTED})) WHERE rn = 1"""
_RANKED = f"SELECT *, abs(effect_size) * (1 + w) * (1 - least(1, adj)) AS rank_score FROM ({_bh_sql(_BEST)})"


@query("rank_relations", f"""
SELECT parent_a, parent_b, w AS priority_weight, round(effect_size, 6) AS effect_size, round(adj, 6) AS adjusted_p_value,
       adj <= 0.05 AS significant_fdr, round(rank_score, 6) AS rank_score FROM ({_RANKED})
""")
def rank_relations(spark, sf):
    out = rl.rank(_derived_relations(spark, sf), "l_quantity", ["l_tax"])
    return out.select("parent_a", "parent_b", "priority_weight", "significant_fdr",
                      *[r6(c).alias(c) for c in ("effect_size", "adjusted_p_value", "rank_score")])


def _finished_relations(spark, sf):
    """Computed, ranked and selected relations of the engineered part table."""
    part = table(spark, sf, "part").withColumns({
        "price_band": F.floor(F.col("p_retailprice") / 100).cast("string"), "half_price": F.col("p_retailprice") * 0.5 + F.col("p_size")})
    part = part.drop("p_partkey", "p_name")
    facts = rl.type_facts(part)
    kinds = {f["column"]: f["kind"] for f in facts}
    reps = rl.representatives(part.columns, kinds, [])
    pairs = rl.plan_pairs(part, reps, facts, "p_retailprice", ["p_size"], {c for c, k in kinds.items() if k == "numeric"})
    ranked = rl.rank(rl.compute(part, pairs, kinds), "p_retailprice", ["p_size"])
    n_rows = table(spark, sf, "part").count()
    good = rl.quality(ranked, n_rows)
    return ranked, rl.select(good, "p_retailprice", ["p_size"])


_PART = """(SELECT p_brand, p_type, p_size, p_retailprice, CAST(CAST(floor(p_retailprice / 100) AS BIGINT) AS VARCHAR) AS price_band,
  p_retailprice * 0.5 + p_size AS half_price FROM part)"""
_PART_PAIRS = [("p_retailprice", c) for c in ("half_price", "p_brand", "p_size", "p_type", "price_band")] + [
    ("p_size", c) for c in ("half_price", "p_brand", "p_type", "price_band")]


def _part_relation_sql(a: str, b: str) -> str:
    """Effect of one pair; significance by the usual normal approximations."""
    head = f"SELECT '{a}' AS parent_a, '{b}' AS parent_b, {3 if a == 'p_retailprice' else 0} + {2 if 'p_size' in (a, b) else 0} AS w, "
    if b in ("half_price", "p_size"):
        return head + f"'spearman' AS method, rho AS e, abs(rho) * sqrt((n - 2) / (1 - least(rho * rho, 0.999999999))) > 2.3 AS sig FROM ({spearman_sql(a, b, _PART)})"
    z = ("((1 - 2 / (9.0 * (n - groups))) * pow(f, 1 / 3.0) - (1 - 2 / (9.0 * (groups - 1)))) "
         "/ sqrt(2 / (9.0 * (n - groups)) * pow(f, 2 / 3.0) + 2 / (9.0 * (groups - 1)))")
    return head + f"'anova_eta2' AS method, eta2 AS e, {z} > 2 AS sig FROM ({anova_sql(a, b, _PART)})"


@query("select_relations", f"""
WITH RECURSIVE q AS (
  SELECT *, row_number() OVER (ORDER BY round(abs(e) * (1 + w), 9) DESC, parent_a, parent_b) AS i
  FROM ({union_sql([_part_relation_sql(a, b) for a, b in _PART_PAIRS])}) WHERE sig AND abs(e) >= 0.15),
g AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST([] AS BIGINT[]) AS picked
  UNION ALL
  SELECT q.i, CASE WHEN len(picked) < 4 AND NOT (list_contains(used, parent_a) AND list_contains(used, parent_b)) THEN list_concat(used, [parent_a, parent_b]) ELSE used END,
    CASE WHEN len(picked) < 4 AND NOT (list_contains(used, parent_a) AND list_contains(used, parent_b)) THEN list_append(picked, q.i) ELSE picked END
  FROM g JOIN q ON q.i = g.i + 1)
SELECT parent_a, parent_b, method, round(e, 6) AS effect_size, w AS priority_weight
FROM q WHERE list_contains((SELECT picked FROM g ORDER BY i DESC LIMIT 1), i)
""")
def select_relations(spark, sf):
    ranked, picked = _finished_relations(spark, sf)
    chosen = ranked.where(F.col("seq").isin([r["seq"] for r in picked]))
    return chosen.select("parent_a", "parent_b", "method", r6("effect_size").alias("effect_size"), "priority_weight")


def _worded_sql() -> str:
    strength = "CASE WHEN abs(effect_size) > 0.3 THEN 'strong' WHEN abs(effect_size) > 0.1 THEN 'moderate' ELSE 'weak' END"
    verb = "CASE WHEN effect_size > 0 THEN 'increases with' ELSE 'decreases with' END"
    name = lambda c: f"array_to_string(list_transform(string_split({c}, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    return f"""
    SELECT seq, format('{{}} {{}} {{}} ({{}}, pearson, effect={{:.2f}}, p={{:.3g}}).', a, v, b, s, effect_size, p_value) AS short,
       format('A {{}} relationship was found between {{}} and {{}} using pearson (effect={{:.3f}}, p={{:.3g}}, n={{}}). This indicates that {{}} {{}} {{}}.',
              s, a, b, effect_size, p_value, n, a, v, b) AS long,
       CASE s WHEN 'strong' THEN format('Consider prioritizing {{}} and {{}} for interventions or further testing.', a, b)
              WHEN 'moderate' THEN format('Investigate {{}} vs {{}} further — they show a moderate relationship.', a, b)
              ELSE 'Relationship weak — likely not a primary driver.' END AS action
    FROM (SELECT seq, effect_size, p_value, n, {name('parent_a')} AS a, {name('parent_b')} AS b, {verb} AS v, {strength} AS s FROM ({_REL_SQL}))"""


@query("relation_sentences", _worded_sql())
def relation_sentences(spark, sf):
    out = rl.sentences(_derived_relations(spark, sf))
    return out.select(F.col("seq").cast("long").alias("seq"), "short", "long", "action")


@query("relation_summary_lines", f"""
SELECT row_number() OVER (ORDER BY rank_score DESC, seq) AS ord,
  format('{{}}. {{}} ↔ {{}} | method=pearson | effect={{:.3f}} | p={{:.3g}} | adj_p={{:.3g}}',
    row_number() OVER (ORDER BY rank_score DESC, seq), a, b, effect_size, p_value, adj) AS line
FROM (SELECT *, array_to_string(list_transform(string_split(parent_a, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS a,
             array_to_string(list_transform(string_split(parent_b, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS b FROM ({_RANKED}))
""")
def relation_summary_lines(spark, sf):
    ranked = rl.rank(_derived_relations(spark, sf), "l_quantity", ["l_tax"])
    out = rl.summary_lines(ranked)
    return out.select(F.col("ord").cast("long").alias("ord"), "line")


@query("relation_summary", f"""
WITH k AS (SELECT count(*) AS m FROM ({_RANKED})), rows AS (SELECT count(*) AS n FROM lineitem)
SELECT CAST(0 AS BIGINT) AS ord, 'Top relations (final selected):' AS line FROM k
UNION ALL SELECT row_number() OVER (ORDER BY rank_score DESC, seq), format('{{}}. {{}} ↔ {{}} | method=pearson | effect={{:.3f}} | p={{:.3g}} | adj_p={{:.3g}}',
    row_number() OVER (ORDER BY rank_score DESC, seq), a, b, effect_size, p_value, adj)
  FROM (SELECT *, array_to_string(list_transform(string_split(parent_a, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS a,
               array_to_string(list_transform(string_split(parent_b, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS b FROM ({_RANKED}))
UNION ALL SELECT m + 1, '' FROM k UNION ALL SELECT m + 2, 'Notes:' FROM k
UNION ALL SELECT m + 3, '- Only high-quality relations (effect >= 0.15, adj_p <= 0.05, min_points = ' ||
    (CASE WHEN n < 100 THEN greatest(10, CAST(floor(n * 0.1) AS BIGINT)) ELSE 50 END) || ') are plotted.' FROM k, rows
UNION ALL SELECT m + 4, '- Parent-level reporting: engineered columns are used for calculation but outputs reference original CSV column names.' FROM k
UNION ALL SELECT m + 5, '- Plots labels use prettified parent names (underscores removed, Title Case).' FROM k
""")
def relation_summary(spark, sf):
    """The whole summary file."""
    ranked = rl.rank(_derived_relations(spark, sf), "l_quantity", ["l_tax"])
    out = rl.summary_document(ranked, table(spark, sf, "lineitem").count())
    return out.select(F.col("ord").cast("long").alias("ord"), "line")


@query("prettify", r"""
SELECT p_name, regexp_replace(trim(replace(k, '_', ' ')), '^$', '') AS raw, pretty FROM (
  SELECT DISTINCT p_name, replace(p_name, ' ', '_') || '_(10)' AS k,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' (10)' AS pretty FROM part
  UNION ALL SELECT 'café élève', 'café_élève_(10)', 'Café Élève (10)' FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region))
""")
def prettify(spark, sf):
    """Names of parts, and one with letters beyond ASCII."""
    accented = table(spark, sf, "region").groupBy().agg(F.min("r_regionkey")).select(F.lit("café élève").alias("p_name"))
    names = table(spark, sf, "part").select("p_name").distinct().unionByName(accented)
    key = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_(10)"))
    return names.select("p_name", F.replace(key, F.lit("_"), F.lit(" ")).alias("raw"), tx.prettify(key).alias("pretty"))


# ---------------------------------------------------------------------- charts


@query("scatter_fit", """
SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
       min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem
""")
def scatter_fit(spark, sf):
    out = ch.scatter_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "x_min", "x_max")


@query("scatter_points", """
WITH e AS (SELECT min(o_custkey)::DOUBLE AS x0, max(o_custkey)::DOUBLE AS x1, min(o_totalprice) AS y0, max(o_totalprice) AS y1 FROM orders)
SELECT least(floor((o_custkey - x0) / (x1 - x0) * 100), 99)::INTEGER AS x_bin, least(floor((o_totalprice - y0) / (y1 - y0) * 100), 99)::INTEGER AS y_bin,
       count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS x_sum, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS y_cents
FROM orders, e GROUP BY 1, 2
""")
def scatter_points(spark, sf):
    out = ch.scatter_points(table(spark, sf, "orders"), "o_custkey", "o_totalprice")
    # sums of keys and cents are whole, so the means are compared without a tie
    whole = lambda c, unit: F.round(F.col(c) * F.col("n") * unit).cast("long")
    return out.select("x_bin", "y_bin", "n", whole("x", 1).alias("x_sum"), whole("y", 100).alias("y_cents"))


@query("box_stats", """
WITH t AS (SELECT coalesce(CASE WHEN user_id < 10 THEN NULL ELSE event_type END, '__MISSING__') AS cat, value AS v FROM events WHERE value IS NOT NULL AND event_id % 50 <> 1),
q AS (SELECT cat, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM t GROUP BY cat)
SELECT substr(cat, 1, 30) AS label, n, round(least(min(v), q1), 6) AS low_whisker, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
       round(greatest(max(v), q3), 6) AS high_whisker
FROM t JOIN q USING (cat) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY cat, n, q1, q2, q3
""")
def box_stats(spark, sf):
    e = table(spark, sf, "events").withColumns({
        "event_type": F.when(F.col("user_id") >= 10, F.col("event_type")),
        "value": F.when(F.col("event_id") % 50 == 1, F.lit(float("nan"))).otherwise(F.col("value"))})
    out = ch.box_stats(e, "value", "event_type")
    return out.select("label", "n", *[r6(c).alias(c) for c in ("low_whisker", "q1", "median", "q3", "high_whisker")])


@query("crosstab_heatmap", """
WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS a, o_orderpriority AS b FROM orders)
SELECT a, b, count(*) AS n FROM t WHERE a IN (SELECT DISTINCT a FROM t ORDER BY a LIMIT 30) GROUP BY a, b
""")
def crosstab_heatmap(spark, sf):
    return ch.crosstab_heatmap(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query("daily_mean", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS mean FROM events WHERE day(ts) <> 13 GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT strftime(s.day, '%Y-%m-%d') AS day, round(mean, 6) AS mean FROM s LEFT JOIN d ON s.day = d.day
""")
def daily_mean(spark, sf):
    """Values of one day of each month are missing, which leaves gaps."""
    e = table(spark, sf, "events").withColumn("value", F.when(F.dayofmonth("ts") != 13, F.col("value")))
    return ch.daily_mean(e, "ts", "value").select(F.date_format("day", "yyyy-MM-dd").alias("day"), r6("mean").alias("mean"))


# ------------------------------------------------------------------- responses

_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_RESPONSE_SQL = """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Recap. ' || text || chr(10) || 'Recommendations:' || chr(10) || '- first ' || chr(10) || '2. second one' || chr(10) || text
  ELSE text || '. One. Two. Three. Four' || chr(10) || '* keep ' || chr(10) || '3) third' END AS t FROM conversations
"""


def _responses(spark, sf):
    """Texts of the conversations laid out as model responses."""
    c, text = table(spark, sf, "conversations"), F.col("text")
    sectioned = F.concat(F.lit("Recap. "), text, F.lit("\nRecommendations:\n- first \n2. second one\n"), text)
    loose = F.concat(text, F.lit(". One. Two. Three. Four\n* keep \n3) third"))
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", sectioned).otherwise(loose).alias("response"))


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_LINES = lambda x: f"list_filter(list_transform(regexp_split_to_array({x}, '{_BREAKS}'), lambda s: {_strip_sql('s')}), lambda s: s <> '')"
_ITEM = (
    "CASE WHEN regexp_matches(s, '^[-*]') THEN " + _strip_sql("regexp_replace(s, '^[-* ]+', '')")
    + " WHEN regexp_matches(s, '^[0-9][.)]') AND contains(s, '.') THEN " + _strip_sql("substr(s, instr(s, '.') + 1)")
    + " ELSE s END"
)


@query("split_responses", rf"""
WITH r AS (SELECT conv_id, turn, {_strip_sql('t')} AS t FROM ({_RESPONSE_SQL})),
m AS (SELECT *, CASE WHEN contains(t, chr(10) || 'recommendations') THEN chr(10) || 'recommendations' WHEN contains(t, chr(10) || 'recommendation') THEN chr(10) || 'recommendation'
   WHEN contains(t, chr(10) || '- recommendations') THEN chr(10) || '- recommendations' WHEN contains(t, chr(10) || 'Recommendations') THEN chr(10) || 'Recommendations'
   WHEN contains(t, chr(10) || 'Recommendation') THEN chr(10) || 'Recommendation' END AS mark, string_split(t, '. ') AS parts FROM r),
b AS (SELECT *, list_transform(list_filter(list_transform(regexp_split_to_array(t, '{_BREAKS}'), lambda s: {_strip_sql('s')}), lambda s: regexp_matches(s, '^([-*] |[0-9])')),
   lambda s: {_strip_sql("regexp_replace(s, '^[-*0-9. )]+', '')")}) AS bare FROM m)
SELECT conv_id, turn, md5(CASE WHEN mark IS NOT NULL THEN {_strip_sql('substr(t, 1, instr(t, mark) - 1)')} WHEN len(parts) <= 4 THEN t
         ELSE {_strip_sql("array_to_string(parts[1:4], '. ')")} END) AS summary_hash,
  md5(array_to_string(CASE WHEN mark IS NOT NULL THEN list_transform({_LINES('substr(t, instr(t, mark) + length(mark))')}, lambda s: {_ITEM})
         WHEN len(parts) <= 4 THEN [] WHEN len(bare) > 0 THEN bare ELSE {_LINES("array_to_string(parts[5:], '. ')")} END, '|')) AS recommendations_hash
FROM b
""")
def split_responses(spark, sf):
    out = rs.split_responses(_responses(spark, sf), "response")
    return out.select("conv_id", "turn", F.md5("summary").alias("summary_hash"),
                      F.md5(F.array_join("recommendations", "|")).alias("recommendations_hash"))


@query("sanitize_summary", r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '  ** Final Summary ** : ' || text ELSE text || chr(10) || '## FINAL SUMMARY ' || text || ' FINAL SUMMARY' END AS s FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(replace(replace(regexp_replace(regexp_replace(s, '(?im)^\s*(\*{0,2}\s*final summary\s*\*{0,2}\s*[:\-]*\s*)', '', 'g'),
   '(?im)^\s*(#{1,3}\s*final summary\s*)', '', 'g'), '**FINAL SUMMARY**', ''), 'FINAL SUMMARY', ''), '^\s+|\s+$', '', 'g')) AS h FROM t
""")
def sanitize_summary(spark, sf):
    c, text = table(spark, sf, "conversations"), F.col("text")
    marked = F.when(F.col("role") == "user", F.concat(F.lit("  ** Final Summary ** : "), text)).otherwise(
        F.concat(text, F.lit("\n## FINAL SUMMARY "), text, F.lit(" FINAL SUMMARY")))
    return c.select("conv_id", "turn", F.md5(rs.sanitize_summary(marked)).alias("h"))


_REPORTED = 3


@query("report_facts", f"""
WITH c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)
SELECT 'overview' AS section, 1 AS ord, 'Rows: ' || count(*) AS text FROM events
UNION ALL SELECT 'overview', 2, 'Columns: ' || (4 + 0 * count(*)) FROM events
UNION ALL SELECT 'columns', 1, 'event_id (numeric): ' || min(event_id) FROM events
UNION ALL SELECT 'columns', 2, 'user_id (numeric): ' || arg_min(user_id, event_id) FROM events
UNION ALL SELECT 'columns', 3, 'event_type (categorical): ' || arg_min(event_type, event_id) FROM events
UNION ALL SELECT 'columns', 4, 'value (numeric): ' || arg_min(value, event_id) FROM events
UNION ALL SELECT 'sentiment', CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER), label || ': ' || n FROM c
UNION ALL SELECT 'relations', CAST(rn AS INTEGER), long FROM (
  SELECT row_number() OVER (ORDER BY rank_score DESC, k.seq) AS rn, w.long FROM ({_RANKED}) k JOIN ({_worded_sql()}) w ON w.seq = k.seq) WHERE rn <= {_REPORTED}
""")
def report_facts(spark, sf):
    """Facts of events, and the best ranked relations between measures of lineitem in words."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    best = rl.rank(_derived_relations(spark, sf), "l_quantity", ["l_tax"]).orderBy(F.desc("rank_score"), "seq").limit(_REPORTED)
    return rs.report_facts(pf.profile(e, ["event_id"]), st.distribution(e, "event_type"), rl.sentences(best))


@query("column_samples", """
SELECT 'p_name' AS "column", string_agg(v, '|' ORDER BY k) AS samples FROM (SELECT p_name AS v, p_partkey AS k FROM part ORDER BY p_partkey LIMIT 5)
""" + "".join(f"""
UNION ALL SELECT '{c}', string_agg(v, '|' ORDER BY v) FROM (SELECT {c} AS v FROM part ORDER BY md5('1:' || p_partkey), p_partkey LIMIT 6)
""" for c in ("p_brand", "p_type")))
def column_samples(spark, sf):
    """One column from its profile, the others from a seeded sample."""
    part = table(spark, sf, "part")
    known = pf.profile(part.select("p_partkey", "p_name"), ["p_partkey"])
    out = rs.column_samples(part, ["p_partkey"], ["p_name", "p_brand", "p_type"], 6, known)
    return out.select("column", F.array_join("samples", "|").alias("samples"))
