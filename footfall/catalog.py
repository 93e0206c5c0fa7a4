"""Every report and job as a query over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall import schemas
from footfall.functions import urls
from footfall.functions.geo import networks_of_cidr
from footfall.functions.numbers import present
from footfall.functions.properties import sanitise_properties
from footfall.functions.ranges import DateRange, date_range, last_days
from footfall.functions.stats import timing_summary
from footfall.operators import (
    acquisition, audience, conversion, engagement, explain, ingest, issues, keywords, performance,
    search, traffic,
)
from footfall.operators.acquisition import json_number, json_text
from footfall.operators.sessions import gap_sessions, mark_returning, sessionise_by_id
from footfall.plans import dashboard, first_seen, keyed, rollup, site_sql, tables, workload
from footfall.plans.session_table import read_sessions, write_sessions
from footfall.sources import fixture, raw_fixture as raw
from footfall.sources.fixture import AS_OF, table, web_event_stream, web_events
from footfall.streaming import jobs

MONTH, WEEK = date_range("30d", AS_OF), date_range("7d", AS_OF)
NOON = datetime(2024, 1, 20, 12)
PAST = DateRange(datetime(2024, 1, 5), datetime(2024, 1, 20))


def sessions_of(events: DataFrame) -> DataFrame:
    return sessionise_by_id(events)


def stored_sessions(events: DataFrame) -> DataFrame:
    """The sessions table that session reports read, with days to prune by. It is written here because the
    driver's folder holds events only; a live job keeps it up with `merge_sessions`."""
    path = tables.scratch_path(events.sparkSession, "sessions")
    write_sessions(sessions_of(events), path)
    return read_sessions(events.sparkSession, path)


def _goals(spark: SparkSession) -> DataFrame:
    rows = [
        ("g1", "site_a", "Pricing", "page_visit", '{"path":"/pricing"}', None),
        ("g2", "site_a", "Bought", "event", '{"eventType":"purchase"}', None),
        ("g3", "site_b", "Button", "click", '{"selector":"button.b2"}', None),
        ("g4", "site_c", "Home", "page_visit", "not json", None),
        ("g5", "site_b", "Odd", "other", '{"selector":"button.b1"}', None),
        ("g6", "site_c", "Custom", "event", "{}", None),
    ]
    return spark.createDataFrame(rows, schemas.GOALS)


def _funnels(spark: SparkSession) -> DataFrame:
    shop = ('[{"label":"Home","type":"pageview","path":"/"},{"label":"Cart","type":"add_to_cart"},'
            '{"label":"Paid","type":"purchase"}]')
    read = '[{"label":"Docs","type":"pageview","path":"/docs"},{"label":"Any page","type":"pageview"},{"label":"Never","type":"lead"}]'
    return spark.createDataFrame(
        [("f1", "site_a", "Shop", shop, None), ("f2", "site_b", "Read", read, None), ("f3", "site_a", "Read", read, None)],
        schemas.FUNNELS)


def _tests(spark: SparkSession) -> DataFrame:
    landing = '[{"name":"home","path":"/"},{"name":"products","url":"/products"},{"name":"ghost","path":"/nowhere"}]'
    docs = '[{"name":"docs","path":"/docs"},{"name":"blog","path":"/blog"}]'
    rows = [
        ("t1", "site_a", "Landing", landing, "g2", "active", None),
        ("t2", "site_b", "Docs", docs, "g3", "paused", None),
        ("t3", "site_b", "Gone", docs, "g3", "deleted", None),
    ]
    return spark.createDataFrame(rows, schemas.AB_TESTS)


def _links(spark: SparkSession) -> DataFrame:
    rows = [
        ("l1", "site_a", "google", "cpc", "launch"), ("l2", "site_a", "newsletter", None, ""),
        ("l3", "site_b", "", "email", ""), ("l4", "site_c", None, None, None),
        ("l5", "site_c", "nobody", "", ""),
    ]
    return spark.createDataFrame(rows, schemas.UTM_LINKS)


def _annotated_days(spark: SparkSession, events: DataFrame) -> DataFrame:
    notes = spark.createDataFrame(
        [("n1", "site_a", datetime(2024, 1, 10).date(), "Launch", None, None, None),
         ("n2", "site_b", datetime(2024, 1, 12).date(), "Sale", None, None, None),
         ("n3", "site_b", datetime(2023, 1, 12).date(), "Before", None, None, None)],
        schemas.ANNOTATIONS)
    daily = traffic.daily_active_users(events, MONTH).withColumnRenamed("unique_users", "visitors")
    return traffic.annotate(daily, traffic.annotations_in_range(notes, MONTH))


def _halves(events: DataFrame) -> DataFrame:
    """Odd against even visitor numbers as the two arms of a test."""
    users = events.groupBy(
        "site_id", (F.substring_index("user_id", "_", -1).cast("bigint") % 2).alias("arm"), "user_id"
    ).agg(F.max((F.col("type") == "purchase").cast("int")).alias("hit"))
    arms = users.groupBy("site_id", "arm").agg(
        F.count("*").alias("visitors"), F.sum("hit").alias("conversions"))
    return conversion.add_significance(arms, "site_id", "arm")


def _two_reports(spark: SparkSession, events: DataFrame, sessions: DataFrame) -> DataFrame:
    reports = dashboard.report_sources(events, sessions, _goals(spark), MONTH)
    return reports["os"]().select(
        "site_id", F.lit("os").alias("data_source"), F.col("os").alias("label"), "visitors"
    ).unionByName(reports["browsers"]().select(
        "site_id", F.lit("browsers").alias("data_source"), F.col("browser").alias("label"), "visitors"))


def _over_events() -> dict:
    """Queries of (spark, events)."""
    a, u, q, c, g, p, w = traffic, audience, acquisition, conversion, engagement, performance, workload
    month = lambda f, **kw: lambda s, e: f(e, MONTH, **kw)
    return {
        "A01_traffic_over_time": month(a.traffic_over_time),
        "A01r_traffic_from_rollup": lambda s, e: a.traffic_over_time(
            e, PAST, rollup=rollup.daily_rollup(e)),
        "A04_pageviews_over_time": month(a.pageviews_over_time),
        "A05_top_pages": month(a.top_pages, limit=5),
        "A06_page_traffic_trend": month(a.page_traffic_trend),
        "A07_page_search_terms": month(a.page_search_terms),
        "A08_page_wow": month(a.page_wow),
        "A09_traffic_sources": month(q.traffic_sources),
        "A10_devices": month(u.devices),
        "A10b_browsers": month(u.breakdown, column="browser", label="Unknown"),
        "A10c_operating_systems": month(u.breakdown, column="os", label="Unknown"),
        "A11_countries": month(u.countries),
        "A11b_countries_additive": month(u.countries, additive=True),
        "A12_cities": month(u.cities),
        "A12b_geo_map": month(u.geo_map),
        "A15r_kpi_from_rollup": lambda s, e: a.kpi_from_rollup(
            rollup.daily_rollup(e), DateRange(datetime(2024, 1, 11), datetime(2024, 1, 20, 23, 59, 59))),
        "A16_funnel_event_types": month(c.funnel_event_types),
        "A16b_funnel_paths": month(c.funnel_paths),
        "A17_funnel": month(c.funnel),
        "A17o_funnel_ordered": month(c.funnel_ordered),
        "A17s_saved_funnels": lambda s, e: c.saved_funnels(e, _funnels(s), MONTH),
        "A18_realtime_summary": lambda s, e: a.realtime_summary(e, NOON, minutes=60),
        "A19_event_stream_tail": lambda s, e: a.event_stream_tail(e, NOON, minutes=12 * 60),
        "A20_utm_campaigns": month(q.utm_campaigns),
        "A21_comparison": lambda s, e: a.comparison(e, WEEK),
        "A22_user_flow": month(a.user_flow),
        "A23_traffic_alerts": month(a.traffic_alerts),
        "A24_error_alerts": lambda s, e: a.error_alerts(
            p.js_errors_daily(e, MONTH).withColumnRenamed("errors", "events")),
        "A25_daily_active_users": lambda s, e: a.daily_active_users(e, last_days(30, AS_OF)),
        "A26_hourly_pattern": lambda s, e: a.hourly_pattern(e, last_days(7, AS_OF)),
        "A28_retention_daily": lambda s, e: u.retention_daily(e, PAST),
        "A29_cohorts": month(u.cohorts),
        "A29b_cohort_matrix": month(u.cohort_matrix),
        "A30_goal_conversions": lambda s, e: c.goal_conversions(e, _goals(s), MONTH),
        "A31_goal_conversions_daily": lambda s, e: c.goal_conversions_daily(e, _goals(s), MONTH),
        "A32_ab_test_results": lambda s, e: c.ab_test_results(e, _tests(s), _goals(s), MONTH),
        "A33_ab_significance": lambda s, e: _halves(e),
        "A35_visitor_segments": month(u.visitor_segments, browser="Chrome"),
        "A36_revenue_summary": month(q.revenue_summary),
        "A36b_revenue_daily": month(q.revenue_daily),
        "A36c_revenue_by_source": month(q.revenue_by_source),
        "A39_site_search_terms": month(g.site_search_terms),
        "A40_campaign_dashboard": month(q.campaign_dashboard),
        "A41_social_traffic": month(q.social_traffic),
        "A41h_social_traffic_by_host": month(q.social_traffic, match="host"),
        "A42_search_keywords": month(q.search_keywords),
        "A43_utm_link_stats": lambda s, e: q.utm_link_stats(e, _links(s)),
        "A44_scroll_depth": month(g.scroll_depth),
        "A45_heatmap_points": month(g.heatmap_points),
        "A46_heatmap_summary": month(g.heatmap_summary),
        "A47_page_actions": month(g.page_actions),
        "A48_heatmap_clusters": lambda s, e: g.heatmap_clusters(g.heatmap_points(e, MONTH)),
        "A48b_heatmap_grid": month(g.heatmap_grid),
        "A49_rage_clicks": month(g.rage_clicks),
        "A51_time_on_page": month(g.time_on_page),
        "A52_engagement_summary": month(g.engagement_summary),
        "A53_web_vitals_by_page": month(p.web_vitals_by_page, limit=5),
        "A54_web_vitals_overview": month(p.web_vitals_overview),
        "A55_js_errors": month(p.js_errors),
        "A55b_js_errors_daily": month(p.js_errors_daily),
        "A57_annotations_in_range": lambda s, e: _annotated_days(s, e),
        "A61_ab_assignment_audit": lambda s, e: c.ab_assignment_audit(e, "copy", ["a", "b"], MONTH),
        "Q01_total_events": lambda s, e: w.total_events(e),
        "Q02_unique_visitors": lambda s, e: w.unique_visitors(e),
        "Q03_sessions": lambda s, e: w.total_sessions(e),
        "Q04_daily_events": lambda s, e: w.daily_events(e),
        "Q05_daily_unique_visitors": lambda s, e: w.daily_unique_visitors(e),
        "Q06_top_pages": lambda s, e: w.busiest_pages(e),
        "Q07_referrer_sources": lambda s, e: w.referrer_sources(e),
        "Q08_date_range_filter": lambda s, e: w.date_range_filter(e, "site_a", MONTH),
        "Q09_multi_dim_groupby": lambda s, e: w.multi_dim_groupby(e),
        "Q10_dashboard_kpi": lambda s, e: w.dashboard_kpi(e, "site_a", MONTH),
        "Q11_utm_campaign_breakdown": lambda s, e: w.utm_campaign_breakdown(e, MONTH),
        "Q12_hourly_pattern": lambda s, e: w.hourly_pattern(e),
    }


def _over_sessions() -> dict:
    """Queries of sessions."""
    a, u = traffic, audience
    return {
        "A02_bounce_rate_trend": lambda s: a.bounce_rate_trend(s, MONTH),
        "A03_avg_session_trend": lambda s: a.avg_session_trend(s, MONTH),
        "A13_sessions_by_city": lambda s: u.sessions_by_city(s, MONTH),
        "A14_session_duration_buckets": lambda s: u.session_duration_buckets(s, MONTH),
        "A14b_session_buckets_short_label": lambda s: u.session_duration_buckets(
            s, last_days(30, AS_OF), minute_label="30-60s"),
        "A22b_flow_ends": lambda s: a.flow_ends(s, MONTH),
        "A27_bounce_by_entry_page": lambda s: u.bounce_by_entry_page(s, last_days(30, AS_OF)),
        "A37_exit_pages": lambda s: u.exit_pages(s, MONTH, limit=5),
        "A38_entry_pages": lambda s: u.entry_pages(s, MONTH, limit=5),
    }


def stored_first(sessions: DataFrame) -> DataFrame:
    """The table of first sessions, from two batches of which the later one has the earlier days."""
    spark, path = sessions.sparkSession, tables.scratch_path(sessions.sparkSession, "first")
    late = F.col("started_at") >= F.lit("2024-01-16")
    for part in (late, ~late):
        first_seen.merge_first(spark, sessions.filter(part), path, buckets=16)
    return first_seen.read_first(spark, path, sessions)


def _over_first() -> dict:
    """Queries of stored sessions and the table of first sessions."""
    u = audience
    return {
        "A34_new_vs_returning": lambda s, f: u.new_vs_returning(first_seen.mark_by_first(s, f, MONTH), MONTH),
        "A34b_new_vs_returning_totals": lambda s, f: u.new_vs_returning_totals(first_seen.mark_by_first(s, f, MONTH), MONTH),
    }


def _over_both() -> dict:
    """Queries of events and stored sessions."""
    return {
        "A15_kpi_summary": lambda s, e, v: traffic.kpi_summary(e, v, WEEK),
        "A59_dashboard_all": lambda s, e, v: dashboard.dashboard_table(e, v, WEEK, AS_OF),
        "A60_report_sources": _two_reports,
        "A60b_every_report_source": lambda s, e, v: dashboard.report_table(e, v, _goals(s), WEEK),
    }


#: A tenant's query with shared sub-queries, a join, windows over ranks and ranges, and set operations.
TENANT_QUERY = """
WITH busy AS (SELECT path, COUNT(*) AS views FROM events WHERE type = {{kind}} GROUP BY path),
ranked AS (
  SELECT path, views, RANK() OVER (ORDER BY views DESC, path) AS place, NTILE(3) OVER (ORDER BY views DESC, path) AS third,
    SUM(views) OVER (ORDER BY views RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS near FROM busy)
SELECT 'page' AS part, path AS label, views AS n, place, third, near FROM ranked
UNION ALL
SELECT 'entry', r.path, COUNT(*), r.place, MIN(r.third), CAST(SUM(s.pageviews) AS BIGINT)
FROM sessions s JOIN ranked r ON s.entry_page = r.path GROUP BY r.path, r.place
UNION ALL
SELECT 'device', device, 0, 0, 0, 0 FROM (
  (SELECT device FROM events INTERSECT SELECT device FROM sessions WHERE is_bounce) EXCEPT SELECT 'Tablet')
"""


def _tenant_tables(d: str):
    def tables_of(session: SparkSession) -> dict[str, DataFrame]:
        events = web_events(session, d)
        return {"events": events, "sessions": sessions_of(events)}

    return tables_of


def _add_nested(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"amount":'), F.col("event_id").cast("string"),
                    F.lit(',"nested":{"Token":"t","ok":true},"session":"abc"}'))
    return table(s, d, "events").select(
        F.col("event_id").cast("string").alias("id"), sanitise_properties(text).alias("properties"))


def _geo(s: SparkSession, d: str) -> DataFrame:
    seen = raw.requests(s, d).withColumn(
        "ip", ingest.client_ip(F.col("forwarded"), F.col("real_ip"), F.col("peer")))
    return ingest.enrich_geo_ip(seen, raw.ip_ranges(s, d)).select("id", "country", "city")


def _zones(s: SparkSession) -> DataFrame:
    return s.createDataFrame(raw.ZONES, "timezone string, country string")


def _pages_with_utm(s: SparkSession, d: str) -> DataFrame:
    blank = F.lit("")
    pages = table(s, d, "pages").select(
        "page_id", "url", F.when(F.col("page_id") % 5 == 0, "kept").otherwise("").alias("utm_source"),
        *[blank.alias(c) for c in ("utm_medium", "utm_campaign", "utm_term", "utm_content")])
    return ingest.extract_utm(pages).select("page_id", "utm_source", "utm_medium")


def _per_day(events: DataFrame, name: str) -> DataFrame:
    return events.groupBy("site_id", F.to_date("timestamp").alias("date")).agg(F.count("*").alias(name))


def _sketched(s: SparkSession, d: str) -> DataFrame:
    """Exact visitors of the month, and whether the merged daily sketches come within 5 % of them."""
    events = web_events(s, d)
    found = rollup.visitors_from_sketches(rollup.daily_visitor_sketches(events), PAST)
    days = F.to_date("timestamp").between(F.lit(PAST.start.date()), F.lit(PAST.end.date()))
    exact = events.filter(days).groupBy("site_id").agg(F.countDistinct("user_id").alias("visitors"))
    return exact.join(found, "site_id", "left").select("site_id", "visitors", F.coalesce(
        F.abs(F.col("visitors_estimate") - F.col("visitors")) <= 0.05 * F.col("visitors"), F.lit(False)).alias("is_close"))


def _vitals_sketched(s: SparkSession, d: str) -> DataFrame:
    """Per page and for all pages: samples and the exact nearest-rank 75th percentile, and whether that of the merged daily
    sketches has a rank within the stated error of it."""
    events = web_events(s, d)
    days = F.to_date("timestamp").between(F.lit(PAST.start.date()), F.lit(PAST.end.date()))
    rows = events.filter(days & (F.col("type") == "web_vital")).select(
        "site_id", F.explode(F.array(F.col("path"), F.lit("(all)"))).alias("path"), json_text("name").alias("metric"), json_number("value").alias("value"))
    found = rollup.vitals_from_sketches(rollup.daily_vital_sketches(events), PAST).select(
        "site_id", F.coalesce("path", F.lit("(all)")).alias("path"), "metric", "percentile")
    both = rows.filter("value IS NOT NULL").join(found, ["site_id", "path", "metric"], "left").groupBy("site_id", "path", "metric").agg(
        F.count("*").alias("samples"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY value)").alias("p75_value"),
        F.count_if(F.col("value") < F.col("percentile")).alias("_below"), F.count_if(F.col("value") <= F.col("percentile")).alias("_upto"))
    error = F.lit(rollup.VITALS_RANK_ERROR) * F.col("samples") + 1e-9
    close = (F.col("_below") <= 0.75 * F.col("samples") + error) & (F.col("_upto") >= 0.75 * F.col("samples") - error)
    return both.select("site_id", "path", "metric", "samples", "p75_value", close.alias("is_close"))


def _appended(s: SparkSession, d: str) -> DataFrame:
    """Half of the events are stored; all of them arrive, twice."""
    e = web_events(s, d)
    stored = e.filter(F.col("id").cast("bigint") % 2 == 0)
    return _per_day(tables.unseen(e.union(e), stored), "appended")


def _latest_orders(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders")
    return tables.upsert_by_key(
        orders.filter(F.col("o_orderkey") % 2 == 0), orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


def _upserted(s: SparkSession, d: str) -> DataFrame:
    """The newest order of each customer: a stored table, then changes of a part of the customers, applied twice."""
    orders, path = table(s, d, "orders"), tables.scratch_path(s, "orders")
    changes = orders.filter("o_orderkey % 3 = 0 AND o_custkey % 4 = 0")
    for batch in (orders.filter("o_orderkey % 3 <> 0"), changes, changes):
        keyed.upsert_stored(s, batch, path, ["o_custkey"], ["o_orderdate", "o_orderkey"], buckets=32)
    return keyed.read_keyed(s, path, orders.schema)


def _appended_without_ids(s: SparkSession, d: str) -> DataFrame:
    """Events of which every third has no id, stored twice, with every fifth record delivered again."""
    n = F.col("id").cast("bigint")
    e = web_events(s, d).withColumn("id", F.when(n % 3 != 0, F.col("id")))
    path = tables.scratch_path(s, "events")
    tables.append_new(s, e.union(e.filter(F.xxhash64("user_id") % 5 == 0)), path)
    tables.append_new(s, e, path)
    stored = tables.read_events(s, path)
    return stored.groupBy("site_id", F.to_date("timestamp").alias("date")).agg(
        F.count("*").alias("events"), F.count_if(F.col("id").startswith("h_")).alias("named_by_content"))


def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    e, path = tables.with_event_date(web_events(s, d)), tables.scratch_path(s, "rebuild")
    tables.full_rebuild(e.filter("type = 'pageview'"), path, tables.HOT_PARTITIONS)
    tables.full_rebuild(e, path, tables.HOT_PARTITIONS)
    return _per_day(s.read.parquet(path), "events")


def _retention(s: SparkSession) -> DataFrame:
    policies = s.createDataFrame(
        [("p1", "site_a", 10, True, None), ("p2", "site_b", 35, True, None), ("p3", "site_c", 30, False, None)],
        schemas.RETENTION_POLICIES)
    return tables.retention_cutoffs(policies, datetime(2024, 2, 20))


def _archived(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    hot, cold = tables.scratch_path(s, "hot"), tables.scratch_path(s, "cold")
    tables.archive_cold(web_events(s, d), cold, hot, datetime(2024, 2, 10))
    return tables.read_events(s, hot), tables.read_events(s, cold)


def _archive_parts(s: SparkSession, d: str) -> DataFrame:
    hot, cold = _archived(s, d)
    both = hot.withColumn("part", F.lit("hot")).unionByName(cold.withColumn("part", F.lit("cold")))
    return both.groupBy("site_id", "part").agg(
        F.count("*").alias("events"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))


def _by_day(*parts: DataFrame) -> DataFrame:
    return tables.unified_view(*parts).groupBy("site_id", F.col("event_date").alias("date")).agg(
        F.count("*").alias("events"), F.countDistinct("user_id").alias("visitors"))


def _archived_in_place(s: SparkSession, d: str) -> DataFrame:
    """The stored table archived in two runs, the later one with the days that have become cold since."""
    hot, cold = tables.scratch_path(s, "hot"), tables.scratch_path(s, "cold")
    tables.write_events(web_events(s, d), hot)
    for as_of in (datetime(2024, 2, 5), datetime(2024, 2, 10)):
        tables.archive_stored(s, hot, cold, as_of)
    both = tables.read_events(s, hot).withColumn("part", F.lit("hot")).unionByName(
        tables.read_events(s, cold).withColumn("part", F.lit("cold")))
    return both.groupBy("site_id", "part").agg(
        F.count("*").alias("events"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))


def _deleted_in_place(s: SparkSession, d: str) -> DataFrame:
    path = tables.scratch_path(s, "events")
    tables.write_events(web_events(s, d), path)
    tables.delete_expired(s, path, _retention(s))
    return _per_day(tables.read_events(s, path), "events")


def _unified(s: SparkSession, d: str) -> DataFrame:
    return _by_day(*_archived(s, d))


def _redelivered(s: SparkSession, d: str) -> DataFrame:
    """All events again, after a part of them was archived."""
    e, hot, cold = web_events(s, d), tables.scratch_path(s, "hot"), tables.scratch_path(s, "cold")
    tables.archive_cold(e, cold, hot, datetime(2024, 2, 10))
    tables.append_new(s, e, hot, cold)
    return _by_day(tables.read_events(s, hot), tables.read_events(s, cold))


def _late_archive(s: SparkSession, d: str) -> DataFrame:
    """Half of the events come late, after their days were archived."""
    e, cold, now = web_events(s, d), tables.scratch_path(s, "cold"), datetime(2024, 2, 10)
    first, second = tables.scratch_path(s, "hot"), tables.scratch_path(s, "hot")
    late = F.col("id").cast("bigint") % 2 == 0
    tables.archive_cold(e.filter(~late), cold, first, now)
    tables.archive_cold(tables.read_events(s, first).drop("event_date").unionByName(e.filter(late)), cold, second, now)
    return _by_day(tables.read_events(s, second), tables.read_events(s, cold))


def _exported(s: SparkSession, d: str) -> DataFrame:
    path = tables.scratch_path(s, "export")
    tables.export_csv(web_events(s, d).select("id", "site_id", "city", "properties"), path)
    return s.read.option("escape", '"').csv(
        path, header=True, schema="id string, site_id string, city string, properties string")


def _polled_issues(s: SparkSession, d: str) -> DataFrame:
    rows, k = raw.raw_issues(s, d), F.col("_k")
    stored = issues.normalise_issues(rows.filter(k % 3 != 0)).withColumn("stale", F.lit(False)).withColumn(
        "count", F.col("count") - (F.col("sentry_id").cast("bigint") % 5 == 0).cast("bigint"))
    polled = issues.normalise_issues(rows.filter((k % 2 == 0) & F.col("project_slug").isin("1", "2", "3")))
    return issues.upsert_issues(stored, polled).select("issue_id", "stale", "changed", "count")


def _live_issues(s: SparkSession, d: str) -> DataFrame:
    return issues.normalise_issues(raw.raw_issues(s, d)).withColumn(
        "stale", F.when(F.col("sentry_id").cast("bigint") % 7 == 0, True))


def _flat_events(s: SparkSession, d: str) -> DataFrame:
    flat = issues.flatten_events(raw.raw_error_events(s, d))
    return flat.select(
        "site_id", "event_id", "message", "exception_value", F.size("tags").alias("tags"),
        F.size("frames").alias("frames"), F.size(F.filter("frames", lambda f: f["in_app"])).alias("in_app"),
        F.col("frames")[0]["filename"].alias("first_file"), F.size("breadcrumbs").alias("crumbs"),
        F.col("breadcrumbs")[0]["message"].alias("first_crumb"),
        F.element_at("breadcrumbs", -1)["message"].alias("last_crumb"))


ISSUE_YEARS = DateRange(datetime(1996, 1, 1), datetime(1999, 12, 31))


def _over_raw() -> dict:
    """Queries over uncleaned inputs, stored tables and the error tracker's feed."""
    url, i = F.col, issues
    return {
        "I01_ingest_clean": lambda s, d: ingest.ingest_clean(raw.raw_events(s, d)),
        "I01b_ingest_rejects": lambda s, d: ingest.ingest_rejects(raw.raw_events(s, d)).select("id", "reason"),
        "I02_sanitise_url": lambda s, d: raw.dirty_urls(s, d).select(
            "page_id", urls.sanitise_url(url("url")).alias("url")),
        "I03_sanitise_properties": _add_nested,
        "I04_opt_out_filter": lambda s, d: ingest.opt_out_filter(raw.requests(s, d)).select("id"),
        "I05_enrich_geo_ip": _geo,
        "I05b_geo_prefixes": lambda s, d: ingest.enrich_geo(
            raw.addressed_requests(s, d), networks_of_cidr(raw.geo_networks(s, d))).drop("ip"),
        "I06_enrich_user_agent": lambda s, d: ingest.enrich_user_agent(
            raw.requests(s, d).select("id", "user_agent")).drop("user_agent"),
        "I07_enrich_country_tz": lambda s, d: ingest.enrich_country(
            raw.requests(s, d).drop("country"), _zones(s)).select("id", "country"),
        "I08_extract_site_search": lambda s, d: ingest.extract_site_search(raw.search_views(s, d)).select(
            "site_id", "id", "path", "param", "query"),
        "I09_extract_utm": _pages_with_utm,
        "I10_sessionise_by_id": lambda s, d: sessions_of(web_events(s, d)),
        "I11_sessionise_by_gap": lambda s, d: gap_sessions(web_events(s, d), gap_minutes=360),
        "I12_mark_returning": lambda s, d: mark_returning(sessions_of(web_events(s, d))).select(
            "site_id", "id", "user_id", "is_returning"),
        "I13_incremental_append": _appended,
        "I14_upsert_by_key": _latest_orders,
        "I13c_append_without_ids": _appended_without_ids,
        "I14b_upsert_stored": _upserted,
        "I15_full_rebuild": _rebuilt,
        "I16_daily_rollup": lambda s, d: rollup.daily_rollup(web_events(s, d)),
        "I17_daily_top_lists": lambda s, d: rollup.daily_top_lists(web_events(s, d)),
        "I17b_daily_rollup_full": lambda s, d: rollup.daily_rollup_full(web_events(s, d)).select(
            "site_id", "date", "visitors", "top_pages", "devices", "sources", "countries"),
        "I16s_visitor_sketches": _sketched,
        "A54k_vitals_from_sketches": _vitals_sketched,
        "I18_retention_delete": lambda s, d: tables.retention_report(web_events(s, d), _retention(s)),
        "I18b_retention_kept": lambda s, d: _per_day(
            tables.apply_retention(web_events(s, d), _retention(s)), "events"),
        "I18c_retention_stored": _deleted_in_place,
        "I19_archive_cold": _archive_parts,
        "I19c_archive_stored": _archived_in_place,
        "I13b_append_after_archive": _redelivered,
        "I19b_archive_late_rows": _late_archive,
        "I20_unified_view": _unified,
        "I21_export_table": _exported,
        "I23_issue_normalise": lambda s, d: i.normalise_issues(raw.raw_issues(s, d)).select(
            "issue_id", "title", "level", "status", "count", "user_count", "project_slug",
            "is_regression", "last_release", "first_seen", "last_seen"),
        "I24_issue_upsert_stale": _polled_issues,
        "I25_issue_stats_daily": lambda s, d: i.daily_issue_counts(raw.raw_issue_stats(s, d)),
        "I26_issue_event_flatten": _flat_events,
        "I28_extract_domain": lambda s, d: table(s, d, "pages").select(
            "page_id", urls.extract_domain(url("url")).alias("domain"),
            urls.domain_matches(urls.extract_domain(url("url")), F.lit("example.com")).alias("on_example_com")),
        "A50_detect_rage_clicks": lambda s, d: engagement.detect_rage_clicks(raw.raw_clicks(s, d)),
        "A56_issue_list": lambda s, d: i.issue_list(_live_issues(s, d), ISSUE_YEARS).select(
            "site_id", "sentry_id", "short_id", "title", "level", "status", "count", "user_count",
            "project", "is_regression", "last_seen"),
        "A56b_issue_summary": lambda s, d: i.issue_summary(_live_issues(s, d), ISSUE_YEARS),
        "A56c_issue_trend": lambda s, d: i.issue_trend(
            i.daily_issue_counts(raw.raw_issue_stats(s, d)), MONTH),
    }


def _serps(s: SparkSession, d: str) -> DataFrame:
    return search.normalise_snapshots(raw.result_pages(s, d))


def _serp_ranks(s: SparkSession, d: str) -> DataFrame:
    sites = s.createDataFrame([(i, None, i, host, None) for i, host in raw.SITE_DOMAINS], schemas.SITES)
    return search.observe_ranks(_serps(s, d), raw.event_page_keywords(s), sites)


def _ranked_orders(s: SparkSession, d: str, **limits) -> DataFrame:
    """Orders as visits: each with the position of its keyword that was last seen by its day."""
    visits = table(s, d, "orders").select(
        "o_orderkey", fixture.site_of(F.col("o_custkey")).alias("site_id"), F.col("o_orderdate").alias("timestamp"),
        F.concat(F.lit("kw_"), (F.col("o_orderkey") % 23).cast("string")).alias("keyword"))
    return search.rank_as_of(visits, fixture.rank_observations(s, d), **limits).drop("timestamp")


def _diffs(s: SparkSession, d: str) -> DataFrame:
    return search.serp_diff(search.rank_changes(_serp_ranks(s, d)))


def _diff_text(s: SparkSession, d: str) -> DataFrame:
    shown = F.transform("overtaken_by", lambda o: F.concat(
        o["domain"], F.lit(":"), F.coalesce(o["previous_position"].cast("string"), F.lit("-")), F.lit(">"),
        o["position"].cast("string")))
    return _diffs(s, d).select(
        "site_id", "keyword", "checked_at", F.array_join("features_added", ",").alias("features_added"),
        F.array_join("features_removed", ",").alias("features_removed"), F.array_join(shown, ",").alias("overtaken"))


def _alerts(s: SparkSession, d: str) -> DataFrame:
    return search.search_alerts(search.rank_changes(fixture.rank_observations(s, d)))


def _feed(s: SparkSession, d: str) -> DataFrame:
    observations = fixture.rank_observations(s, d)
    alerts = _alerts(s, d).withColumns(
        {"created_at": F.col("checked_at"), "read_at": F.lit(None).cast("date")})
    feed = search.alert_feed(alerts, fixture.page_keywords(observations))
    return feed.select("site_id", "keyword", "created_at", "type", F.array_join("paths", ",").alias("paths"))


def _budget_sites(s: SparkSession) -> DataFrame:
    return s.createDataFrame(
        [("site_a", "https://www.s1.example.com/x", True, 240, 3), ("site_b", "s2.example.com", False, None, None),
         ("site_c", "s3.example.com", True, 0, 500)],
        "id string, domain string, has_key boolean, min_hours int, max_per_run int")


def _due(s: SparkSession, d: str) -> DataFrame:
    observations = fixture.rank_observations(s, d)
    history = observations.filter(F.col("checked_at") < "2001-08-01")
    return search.keywords_due(
        fixture.page_keywords(observations), _budget_sites(s), history, datetime(2001, 7, 31, 12)
    ).drop("location")


def _with_way(s: SparkSession, d: str) -> DataFrame:
    """Every keyword change, explained as if even months had dropped and odd ones risen."""
    return _diffs(s, d).withColumn(
        "direction", F.when(F.month("checked_at") % 2 == 0, "drop").otherwise("spike"))


def _causes(s: SparkSession, d: str) -> DataFrame:
    return explain.attribute_causes(_with_way(s, d)).select(
        "site_id", "keyword", "checked_at", F.posexplode("causes").alias("cause_no", "c")
    ).select("site_id", "keyword", "checked_at", "cause_no", "c.code", "c.phrase")


def _rivals(s: SparkSession, d: str) -> DataFrame:
    return present(explain.pick_rival(_diffs(s, d)), "rival").select(
        "site_id", "keyword", "checked_at", "rival.domain", "rival.position", "rival.also_cited", "rival.overtook")


def _weekly(s: SparkSession, d: str, **floors) -> DataFrame:
    return explain.weekly_change(traffic.page_traffic_trend(web_events(s, d), MONTH), **floors)


def _explained(s: SparkSession, d: str) -> DataFrame:
    return explain.explain_traffic(
        _weekly(s, d, min_pct=5, min_views=2), explain.latest_findings(_diffs(s, d)),
        raw.event_page_keywords(s), datetime(2001, 11, 5), "30d")


def _part_phrases(s: SparkSession, d: str) -> DataFrame:
    name, slot = F.col("p_name"), F.col("p_partkey") % 6
    path = (
        F.when(slot == 0, F.concat(F.lit("/blog/2024/"), F.replace(name, F.lit(" "), F.lit("-"))))
        .when(slot == 1, F.concat(F.lit("/0:/Guides/"), F.replace(name, F.lit(" "), F.lit("%20")), F.lit(".html?x=1#y")))
        .when(slot == 2, "/Login")
        .when(slot == 3, F.concat(F.lit("/docs/"), F.substring_index(name, " ", -1), F.lit("/12")))
        .when(slot == 4, "/notes/")
        .otherwise(F.concat(F.lit("/x/"), F.replace(name, F.lit(" "), F.lit("_")), F.lit("+7th+(2024)"))))
    parts = table(s, d, "part").select("p_partkey", path.alias("path"))
    return keywords.with_phrase(parts).select("p_partkey", "phrase")


def _taken(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("site_a", "/blog", "Free Templates")], "site_id string, path string, keyword string")


def _newest_serps(s: SparkSession, d: str) -> DataFrame:
    return search.freshest_snapshot(_serps(s, d), datetime(2002, 1, 1), max_age_hours=24 * 365 * 10)


def _over_search() -> dict:
    """Queries over result pages and rank observations."""
    return {
        "I27_serp_normalise": lambda s, d: _serps(s, d).select(
            "keyword", F.to_date("fetched_at").alias("month"), F.explode("organic").alias("r")
        ).select("keyword", "month", "r.*"),
        "I27b_serp_parts": lambda s, d: _serps(s, d).select(
            "keyword", F.to_date("fetched_at").alias("month"), "has_ai_overview",
            F.size("citations").alias("citations"),
            F.try_element_at("people_also_ask", F.lit(1))["question"].alias("first_question"),
            F.array_join(F.transform("related_searches", lambda r: r["query"]), ",").alias("related"),
            F.array_join("features", ",").alias("features")),
        "R01_locate_domain": lambda s, d: _serps(s, d).select(
            "keyword", F.to_date("fetched_at").alias("month"),
            search.locate_domain(F.col("organic"), F.lit("s1.example.com"))["position"].alias("position")),
        "R02_rank_observations": lambda s, d: _serp_ranks(s, d).select(
            "site_id", "keyword", "checked_at", "position", "ai_overview", "is_cited", "url"),
        "R03_rank_change": lambda s, d: search.rank_changes(fixture.rank_observations(s, d)).select(
            "site_id", "keyword", "checked_at", "position", "previous_position", "position_change", "citation_change"),
        "R04_serp_diff": _diff_text,
        "R05_search_alerts": lambda s, d: _alerts(s, d).drop("location", "device"),
        "R05b_serp_alerts": lambda s, d: search.search_alerts(_diffs(s, d)).select(
            "site_id", "keyword", "checked_at", "type", "message"),
        "R06_alert_feed": _feed,
        "R07_rank_history_series": lambda s, d: search.rank_history_series(
            fixture.rank_observations(s, d)).drop("location", "device"),
        "R08_keywords_due": _due,
        "R08b_rank_budget": lambda s, d: search.rank_budget(
            fixture.page_keywords(fixture.rank_observations(s, d)), _budget_sites(s)),
        "R07b_rank_as_of": _ranked_orders,
        "R07c_rank_as_of_fresh": lambda s, d: _ranked_orders(s, d, max_age_days=2),
        "R09_weekly_change": _weekly,
        "R10_attribute_causes": _causes,
        "R11_pick_rival": _rivals,
        "R12_next_step": lambda s, d: _explained(s, d).select("site_id", "path", "next_action", "next_text"),
        "R13_explain_traffic": lambda s, d: _explained(s, d).select(
            "site_id", "path", "explanation", "confidence",
            F.array_join("cause_codes", ",").alias("cause_codes"), F.array_join("caveats", " ").alias("caveats")),
        "R14_steady_page_score": lambda s, d: explain.steady_page_score(
            _weekly(s, d), explain.latest_findings(_diffs(s, d)), raw.event_page_keywords(s)),
        "R15_path_to_phrase": _part_phrases,
        "R16_keyword_suggestions": lambda s, d: keywords.keyword_suggestions(
            web_events(s, d), _taken(s), MONTH, _newest_serps(s, d)),
        "R17_site_suggestions": lambda s, d: keywords.site_suggestions(
            web_events(s, d), _taken(s), MONTH).select("site_id", "path", "views", "keyword", "rank"),
    }


def _finish(df: DataFrame, s: SparkSession) -> DataFrame:
    """Run an append-mode stream over all files present and return the table it wrote."""
    path = tables.scratch_path(s, "stream")
    df.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(
        availableNow=True).format("parquet").start(f"{path}/out").awaitTermination()
    return s.read.schema(df.schema).parquet(f"{path}/out")


def _buckets(s: SparkSession, d: str) -> DataFrame:
    path = tables.scratch_path(s, "buckets")
    jobs.for_each_batch(jobs.time_buckets(web_event_stream(s, d)), jobs.latest_rows(f"{path}/rows", ["bucket", "site_id"]),
                        f"{path}/state", mode="update").awaitTermination()
    return jobs.read_latest(s, f"{path}/rows", ["bucket", "site_id"])


def _ingested(s: SparkSession, events: DataFrame) -> str:
    path = tables.scratch_path(s, "events")
    jobs.stream_ingest(events, path, f"{path}-state").awaitTermination()
    return path


def _cleaned_live(s: SparkSession, d: str) -> DataFrame:
    """Raw records through the live cleaning job into the table."""
    records = raw.as_raw_events(web_event_stream(s, d))
    stored = s.read.parquet(_ingested(s, jobs.clean_stream(records)))
    return stored.groupBy("site_id", "type", "event_date").agg(
        F.count("*").alias("events"), F.count_if(F.col("url").contains("REDACTED")).alias("redacted"))


def _stored_stream(s: SparkSession, path: str) -> DataFrame:
    return s.readStream.schema(s.read.parquet(path).schema).parquet(path)


def _live_rollup(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path, out = _ingested(s, web_event_stream(s, d)), tables.scratch_path(s, "rollup")
    work = jobs.rollup_updates(path, f"{out}/days", f"{out}/sessions", f"{out}/alerts", buckets=8)
    jobs.for_each_batch(_stored_stream(s, path), work, f"{out}/state").awaitTermination()
    return s.read.parquet(f"{out}/days").drop("event_date"), jobs.read_alerts(s, f"{out}/alerts")


def _long_sessions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rollup and stored sessions after several batches, with a session a visitor and week."""
    week = F.to_date(F.date_trunc("week", "timestamp")).cast("string")
    events = web_event_stream(s, d).withColumn("session_id", F.concat("user_id", F.lit("_"), week))
    path, out = _ingested(s, events), tables.scratch_path(s, "rollup")
    landed = s.readStream.schema(s.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(path)
    work = jobs.rollup_updates(path, f"{out}/days", f"{out}/sessions", buckets=8)
    jobs.for_each_batch(landed, work, f"{out}/state").awaitTermination()
    return s.read.parquet(f"{out}/days").drop("event_date"), read_sessions(s, f"{out}/sessions")


def _live_first(s: SparkSession, d: str) -> DataFrame:
    """First sessions after several batches of a live job."""
    path, out = _ingested(s, web_event_stream(s, d)), tables.scratch_path(s, "rollup")
    landed = s.readStream.schema(s.read.parquet(path).schema).option("maxFilesPerTrigger", 16).parquet(path)
    work = jobs.rollup_updates(path, f"{out}/days", f"{out}/sessions", first_path=f"{out}/first", buckets=8)
    jobs.for_each_batch(landed, work, f"{out}/state").awaitTermination()
    first = first_seen.read_first(s, f"{out}/first", read_sessions(s, f"{out}/sessions"))
    return first.select("site_id", "user_id", F.col("timestamp").alias("first_at"), F.col("id").alias("session_id"))


def _split_live(s: SparkSession, d: str) -> DataFrame:
    """One stream into the table of events in time and that of late ones; all of it comes a second time."""
    n, out = F.col("id").cast("bigint"), tables.scratch_path(s, "split")
    delay = F.when(n % 10 == 0, F.expr("INTERVAL 3 DAYS")).when(n % 10 == 1, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 1 MINUTE"))
    received = web_event_stream(s, d).withColumn("received_at", F.when(n % 10 != 2, F.col("timestamp") + delay))
    for run in ("first", "again"):
        jobs.for_each_batch(received, jobs.split_late(f"{out}/main", f"{out}/late", "1 DAY"), f"{out}/{run}").awaitTermination()
    parts = [tables.read_events(s, f"{out}/{name}").withColumn("part", F.lit(name)) for name in ("main", "late")]
    return parts[0].unionByName(parts[1]).groupBy("part", "site_id", F.col("event_date").alias("date")).agg(F.count("*").alias("events"))


def _packed(s: SparkSession, d: str) -> DataFrame:
    """Live ingest of many small files, whose days are packed on the way."""
    out = tables.scratch_path(s, "packed")
    found = web_events(s, d)
    found.repartition(6, "id").write.parquet(f"{out}/in")
    live = s.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    jobs.for_each_batch(live, jobs.ingest_compacted(f"{out}/events", every=2), f"{out}/state").awaitTermination()
    kept = tables.stored_at(s, f"{out}/events", tables.with_event_date(found).schema)
    return kept.groupBy("site_id", F.col("event_date").cast("string").alias("date")).agg(
        F.count("*").alias("events"), F.countDistinct("id").alias("ids"))


def _tail(s: SparkSession, d: str) -> DataFrame:
    out = tables.scratch_path(s, "tail")
    jobs.for_each_batch(
        web_event_stream(s, d), jobs.event_tail(f"{out}/rows"), f"{out}/state").awaitTermination()
    kept = s.read.parquet(f"{out}/rows")  # one folder a batch; the last has the tail
    return kept.filter(F.col("batch") == kept.agg(F.max("batch")).first()[0]).select("site_id", "id", "type", "path", "timestamp")


def _click_stream(s: SparkSession, d: str) -> DataFrame:
    path = tables.scratch_path(s, "clicks")
    raw.raw_clicks(s, d).withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.parquet(path)
    return s.readStream.schema(s.read.parquet(path).schema).parquet(path)


def _over_streams() -> dict:
    """Queries that run a live job over the files present."""
    return {
        "S01_stream_ingest": _cleaned_live,
        "S02_stream_dedupe": lambda s, d: _finish(
            jobs.dedupe(web_event_stream(s, d).union(web_event_stream(s, d)), "40 days"), s
        ).select("id", "site_id", "type"),
        "S03_stream_sessions": lambda s, d: _finish(
            jobs.sessions_live(web_event_stream(s, d), "6 hours", "1 hour"), s),
        "S04_stream_active_visitors": lambda s, d: _finish(
            jobs.active_visitors(web_event_stream(s, d), exact=True), s),
        "S05_stream_event_tail": _tail,
        "S06_stream_rollup": lambda s, d: _live_rollup(s, d)[0],
        "S07_stream_rage_clicks": lambda s, d: _finish(jobs.rage_clicks_live(_click_stream(s, d)), s),
        "S08_stream_alerts": lambda s, d: _live_rollup(s, d)[1],
        "S06b_rollup_long_sessions": lambda s, d: _long_sessions(s, d)[0],
        "S09_time_buckets": _buckets,
        "S13_live_ingest_packed": _packed,
        "S11_late_events": _split_live,
        "S12_first_sessions": _live_first,
        "S10_stored_sessions": lambda s, d: _long_sessions(s, d)[1].select(
            "site_id", "id", "user_id", "session_date", "started_at", "ended_at", "duration", "pageviews", "is_bounce"),
    }


def _shown(df: DataFrame) -> DataFrame:
    """Dates and times as text, the form in which the reports hand them out."""
    return df.select(*[
        F.col(f.name).cast("string").alias(f.name)
        if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(f.name)
        for f in df.schema.fields
    ])


def _bind(build) -> object:
    return lambda spark, sf_dir: _shown(build(spark, sf_dir))


def catalog() -> dict:
    over_events = {n: (lambda s, d, f=f: f(s, web_events(s, d))) for n, f in _over_events().items()}
    over_sessions = {
        n: (lambda s, d, f=f: f(stored_sessions(web_events(s, d)))) for n, f in _over_sessions().items()}
    over_first = {
        n: (lambda s, d, f=f: f(v := stored_sessions(web_events(s, d)), stored_first(v))) for n, f in _over_first().items()}
    over_both = {
        n: (lambda s, d, f=f: f(s, e := web_events(s, d), stored_sessions(e))) for n, f in _over_both().items()}
    other = {
        **_over_raw(), **_over_search(), **_over_streams(),
        "A58_site_sql": lambda s, d: site_sql.site_sql(
            s, "SELECT country, COUNT(*) AS events FROM events WHERE type = {{kind}} GROUP BY country",
            "site_b", lambda session: {"events": web_events(session, d)}, {"kind": "pageview"}),
        "A58b_site_sql_parts": lambda s, d: site_sql.site_sql(s, TENANT_QUERY, "site_a", _tenant_tables(d), {"kind": "pageview"}),
        "B01_timing_summary": lambda s, d: timing_summary(table(s, d, "events"), ["event_type"], "value"),
    }
    return {n: _bind(f) for n, f in sorted({**over_events, **over_sessions, **over_first, **over_both, **other}.items())}
