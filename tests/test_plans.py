"""What the plans have to look like, whatever the size of the data."""

import re

import pytest
from pyspark.sql import functions as F

from guardedlake.plans import analytics
from guardedlake.plans.all_queries import NAMED
from guardedlake.plans.star import StarFinance
from tests.conftest import plan

# These start jobs of their own when called, so their plan is not one plan.
RUNS_JOBS = ("s0", "e01", "l01")


@pytest.mark.parametrize("name", [n for n in NAMED if not n.startswith(RUNS_JOBS)])
def test_no_cross_joins_and_no_forced_broadcast(spark, data, name):
    text = plan(NAMED[name].run(spark, data))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "strategy=broadcast"):
        assert forbidden not in text


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(analytics.revenue_by_unit(StarFinance(spark, data), "1998-01-01"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(p_type,PROMO\)", text) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", text)
    scan = re.search(r"ReadSchema: struct<[^>]*l_orderkey[^>]*>", text).group(0)
    assert "l_comment" not in scan and "l_tax" not in scan and "l_shipdate" not in scan


def test_previous_month_is_a_range_filter(spark, data):
    text = plan(NAMED["q25_previous_month_orders"].run(spark, data))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


@pytest.mark.parametrize("name", ["q05_top_expense_accounts", "q09_vendor_spend", "q13_top_films", "c03_row_cap", "f06_session_cap"])
def test_limits_are_top_k(spark, data, name):
    assert "TakeOrderedAndProject" in plan(NAMED[name].run(spark, data))


@pytest.mark.parametrize("name", ["f03_trimmed_history", "c07_output_budget", "b03_cosine_topk", "d06_agent_catalog"])
def test_rank_limits_run_before_the_shuffle(spark, data, name):
    text = plan(NAMED[name].run(spark, data))
    assert text.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["d09_scope_check", "c05_cell_text", "d11_redaction", "d10_response_filters", "h05_account_classes"])
def test_row_work_needs_no_shuffle(spark, data, name):
    text = plan(NAMED[name].run(spark, data))
    exchanges = [x for x in re.findall(r"Exchange (\w+)", text) if x != "RoundRobinPartitioning"]
    assert name == "c05_cell_text" or not exchanges, exchanges


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    from guardedlake.operators import quality, sessions

    hot = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.timestamp_seconds("id").alias("ts"))
    for df in (sessions.idle_sessions(hot, "k"), quality.audit_foreign_key("t", hot, "k", spark.range(10), "id")):
        text = plan(df)
        assert "partial_count" in text or "partial_min" in text
        df.collect()
