"""Shapes of the physical plans that must hold at scale."""

import re

import pytest

import __spark_entry__ as contract
from footfall.catalog import catalog

SF = "/root/testdata/sf0.001"
BATCH = sorted(n for n in catalog() if not n.startswith("S0") and n not in ("I15_full_rebuild", "I13b_append_after_archive", "I18c_retention_stored", "I19_archive_cold", "I19c_archive_stored", "I19b_archive_late_rows", "I20_unified_view", "I21_export_table", "A58b_site_sql_parts"))  # the last is a tenant's own text, with windows over small results
PYTHON = {"A48_heatmap_clusters", "A50_detect_rage_clicks"}


@pytest.fixture(autouse=True)
def nothing_cached(spark):
    spark.catalog.clearCache()


def plan_of(spark, name):
    return contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_product_joins_and_python_only_where_needed(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("Python" in plan or "InPandas" in plan) == (name in PYTHON)
    assert not re.search(r"Window .*windowspecdefinition\((?!\w*[a-z_0-9]+#)", plan)
    assert "Exchange SinglePartition, REPARTITION" not in plan


@pytest.mark.parametrize("name", ["A05_top_pages", "A20_utm_campaigns", "A22_user_flow", "A45_heatmap_points", "A55_js_errors", "R07_rank_history_series"])
def test_top_k_cuts_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_of(spark, name)


def test_scans_read_only_needed_columns(spark):
    scan = re.search(r"ReadSchema: struct<([^>]*)>", plan_of(spark, "Q04_daily_events")).group(1)
    assert scan == "ts:timestamp_ntz"


def test_time_filter_reaches_the_scan(spark):
    assert re.search(r"PushedFilters: \[IsNotNull\(ts\), GreaterThanOrEqual\(ts,", plan_of(spark, "A01_traffic_over_time"))


def scans(spark, name):
    return plan_of(spark, name).count("FileScan parquet")


def test_ordered_funnel_is_one_scan(spark):
    plan = plan_of(spark, "A17o_funnel_ordered")
    assert scans(spark, "A17o_funnel_ordered") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["A28_retention_daily", "R16_keyword_suggestions", "R17_site_suggestions"])
def test_no_scan_without_a_time_filter(spark, name):
    filters = re.findall(r"events\.parquet\], PartitionFilters: \[\], PushedFilters: \[([^\]]*)\]", plan_of(spark, name))
    assert filters and all("GreaterThanOrEqual(ts" in f for f in filters)


@pytest.mark.parametrize("name", ["A02_bounce_rate_trend", "A13_sessions_by_city", "A15_kpi_summary", "A37_exit_pages"])
def test_session_reports_read_the_days_of_their_period(spark, name):
    plan = plan_of(spark, name)
    parts = [f for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if f]
    assert len(parts) == plan.count("sessions-") and all("session_date" in f for f in parts)
