"""Several reports at once: the dashboard's ten results and the report builder's data sources."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from footfall.functions.numbers import union_all
from footfall.functions.ranges import DateRange, for_site, within
from footfall.operators import acquisition, audience, conversion, performance, traffic
from footfall.operators.sessions import mark_returning, with_returning
from footfall.plans.shared import shared_reports

# Columns every report may need; the rest is never read for a dashboard.
_USED = [
    "site_id", "user_id", "session_id", "id", "type", "path", "timestamp", "referrer", "device",
    "country",
]


def dashboard_all(
    events: DataFrame, sessions: DataFrame, period: DateRange, as_of: datetime,
    site_id: str | None = None, keep: bool = True,
) -> dict[str, DataFrame]:
    """The ten results of one dashboard page. Events of both periods are read once and kept
    (on disk if memory is short) while the results are computed; call `.unpersist()` on the
    frame under "_events" when done."""
    span = DateRange(period.previous().start, max(period.end, as_of))
    shared = for_site(within(events, span), site_id).select(*_USED)
    if keep:
        shared = shared.persist(StorageLevel.MEMORY_AND_DISK)
    return {
        "traffic": traffic.traffic_over_time(shared, period),
        "pageviews": traffic.pageviews_over_time(shared, period),
        "top_pages": traffic.top_pages(shared, period),
        "sources": acquisition.traffic_sources(shared, period),
        "devices": audience.devices(shared, period),
        "countries": audience.countries(shared, period),
        "sessions": audience.session_duration_buckets(sessions, period, site_id),
        "kpi": traffic.kpi_summary(shared, sessions, period, site_id),
        "funnel": conversion.funnel(shared, period),
        "realtime": traffic.realtime_summary(shared, as_of),
        "_events": shared,
    }


def long_form(results: dict[str, DataFrame]) -> DataFrame:
    """Several results as one typed table (site_id, report, item, metric, value). An item is a row's texts
    and dates, in the order of their columns' names; every number of the row is a metric of its own."""
    parts = []
    for name, df in results.items():
        if name.startswith("_"):
            continue
        numbers = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
        texts = sorted(set(df.columns) - {"site_id", *numbers})
        item = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts])
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])
        parts.append(df.select("site_id", F.lit(name).alias("report"), item.alias("item"), F.explode(cells).alias("_cell"))
                     .select("site_id", "report", "item", "_cell.metric", "_cell.value"))
    return union_all(parts)


DASHBOARD = {"traffic": None, "pageviews": None, "top_pages": 10, "sources": None, "devices": None, "countries": 10,
             "sessions": None, "kpi": None, "funnel": None, "realtime": 10}
REPORTS = {"traffic": None, "top_pages": 20, "sources": None, "devices": None, "countries": 15, "sessions": None, "kpi": None,
           "referrers": None, "utm": 20, "entry_pages": 20, "exit_pages": 20, "browsers": None, "os": None, "bounce_rate": None,
           "avg_session": None, "conversions": None, "new_vs_returning": None, "revenue": None}


def dashboard_table(events, sessions, period: DateRange, as_of: datetime, site_id: str | None = None) -> DataFrame:
    """`long_form` of `dashboard_all`, from one scan of the events and one of the sessions."""
    return shared_reports(events, sessions, period, DASHBOARD, as_of, site_id=site_id)


def report_table(events, sessions, goals, period: DateRange, site_id: str | None = None) -> DataFrame:
    """`long_form` of all `report_sources`. The events are read for the counts together, the goals and the vitals;
    the sessions for the counts and for the first session of each visitor."""
    marked = with_returning(for_site(sessions, site_id))
    counted = shared_reports(events, marked, period, REPORTS, goals=goals, site_id=site_id)
    return union_all([counted, long_form({"web_vitals": performance.web_vitals_overview(events, period, site_id)})])


def report_sources(
    events: DataFrame, sessions: DataFrame, goals: DataFrame, period: DateRange,
    site_id: str | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """Data source name of a report widget -> report. Built on demand."""
    e, s, p, site = events, sessions, period, site_id
    return {
        "traffic": lambda: traffic.traffic_over_time(e, p, site),
        "top_pages": lambda: traffic.top_pages(e, p, site, limit=20),
        "sources": lambda: acquisition.traffic_sources(e, p, site),
        "devices": lambda: audience.devices(e, p, site),
        "countries": lambda: audience.countries(e, p, site, limit=15),
        "sessions": lambda: audience.session_duration_buckets(s, p, site),
        "kpi": lambda: traffic.kpi_summary(e, s, p, site),
        "referrers": lambda: acquisition.traffic_sources(e, p, site)
        .withColumnRenamed("source", "referrer"),
        "utm": lambda: acquisition.utm_campaigns(e, p, site),
        "entry_pages": lambda: audience.entry_pages(s, p, site),
        "exit_pages": lambda: audience.exit_pages(s, p, site),
        "browsers": lambda: audience.breakdown(e, p, "browser", "Unknown", site),
        "os": lambda: audience.breakdown(e, p, "os", "Unknown", site),
        "bounce_rate": lambda: traffic.bounce_rate_trend(s, p, site),
        "avg_session": lambda: traffic.avg_session_trend(s, p, site),
        "conversions": lambda: conversion.goal_conversions(e, goals, p, site),
        "new_vs_returning": lambda: audience.new_vs_returning(mark_returning(s), p, site),
        "revenue": lambda: acquisition.revenue_daily(e, p, site),
        "web_vitals": lambda: performance.web_vitals_overview(e, p, site),
    }
