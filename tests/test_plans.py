"""Shape of the physical plans: what must not shuffle, scan or nest."""

import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tabloom.operators import charts
from tabloom.operators import features as ft
from tabloom.operators import relations as rl
from tabloom.operators import sentiment as st
from tabloom.operators import stats
from tabloom.operators.facts import column_facts
from tabloom.plans.catalog import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_annotation_by_lexicon_is_a_projection(spark):
    out = st.annotate(read(spark, "conversations"), ["text"], st.LexiconScorer())
    assert "Exchange" not in plan(out) and "Python" not in plan(out)


def test_label_encoding_needs_no_join(spark):
    o = read(spark, "orders")
    out = ft.label_encode(o, ft.label_mapping(o, ["o_orderpriority", "o_orderstatus"]))
    assert "Exchange" not in plan(out) and "Join" not in plan(out)


def test_facts_take_two_shuffles_and_prune_columns(spark):
    p = plan(column_facts(read(spark, "documents"), ["lang", "source"]))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2
    assert "ReadSchema: struct<lang:string,source:string>" in p


def test_text_features_read_only_the_text(spark):
    p = plan(ft.text_features(read(spark, "documents"), ["text"]).select("text_word_count", "text_has_url"))
    assert "ReadSchema: struct<text:string>" in p and "Exchange" not in p


def test_filters_reach_the_scan(spark):
    p = plan(charts.daily_mean(read(spark, "events").where("event_type = 'purchase'"), "ts", "value"))
    assert "EqualTo(event_type,purchase)" in p and "user_id" not in p


@pytest.mark.parametrize("name", ["compute_relations", "cramers_v", "spearman", "box_stats", "frequency_encode", "seeded_sample"])
def test_no_nested_loops(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in p and "CartesianProduct" not in p


def test_relations_scan_the_table_four_times_at_most(spark):
    """Facts, cells of all families, and ranks brought back to rows; a fourth only for classes near a limit."""
    li = read(spark, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    facts = rl.type_facts(li)
    kinds = {f["column"]: f["kind"] for f in facts}
    pairs = rl.plan_pairs(li, rl.representatives(li.columns, kinds, []), facts, "l_quantity", ["l_returnflag"], {c for c, k in kinds.items() if k == "numeric"})
    rl.compute(li, pairs, kinds, facts=facts).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    texts = [store.executionsList().apply(i).physicalPlanDescription() for i in range(int(before), int(store.executionsCount()))]
    assert sum("lineitem.parquet" in t for t in texts) <= 4


def test_correlations_share_one_scan(spark):
    li = read(spark, "lineitem")
    assert plan(stats.pearson(li.select([F.col(c) for c in li.columns]), [("l_tax", "l_quantity")])).count("Exchange") == 1
