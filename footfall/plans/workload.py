"""The twelve fixed benchmark shapes over an events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.functions.classify import filled
from footfall.functions.ranges import DateRange, within


def _day():
    return F.to_date("timestamp").alias("day")


def _events():
    return F.count("*").alias("events")


def _visitors():
    return F.countDistinct("user_id").alias("visitors")


def total_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total"))


def unique_visitors(events: DataFrame) -> DataFrame:
    return events.agg(_visitors())


def total_sessions(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("session_id").alias("sessions"))


def daily_events(events: DataFrame) -> DataFrame:
    return events.groupBy(_day()).agg(_events())


def daily_unique_visitors(events: DataFrame) -> DataFrame:
    return events.groupBy(_day()).agg(_visitors())


def busiest_pages(events: DataFrame, k: int = 20) -> DataFrame:
    pages = events.filter("type = 'pageview'").groupBy("path").agg(F.count("*").alias("views"), _visitors())
    return pages.orderBy(F.desc("views"), F.asc_nulls_last("path")).limit(k)


def referrer_sources(events: DataFrame) -> DataFrame:
    return events.groupBy(filled("referrer", "direct").alias("source")).agg(
        F.count("*").alias("hits"), F.countDistinct("session_id").alias("sessions"))


def _one_site(events: DataFrame, site_id: str, period: DateRange) -> DataFrame:
    return within(events, period, end_inclusive=False).filter(F.col("site_id") == site_id)


def date_range_filter(events: DataFrame, site_id: str, period: DateRange) -> DataFrame:
    return _one_site(events, site_id, period).agg(_events(), _visitors())


def multi_dim_groupby(events: DataFrame, k: int = 50) -> DataFrame:
    dims = ["country", "device", "browser", "os"]
    counted = events.groupBy(*dims).agg(_events())
    return counted.orderBy(F.desc("events"), *[F.asc_nulls_last(d) for d in dims]).limit(k)


def dashboard_kpi(events: DataFrame, site_id: str, period: DateRange) -> DataFrame:
    return _one_site(events, site_id, period).agg(
        F.count("*").alias("total_events"), _visitors(),
        F.countDistinct("session_id").alias("sessions"),
        F.count_if(F.col("type") == "pageview").alias("pageviews"),
        F.countDistinct("path").alias("distinct_paths"))


def utm_campaign_breakdown(events: DataFrame, period: DateRange) -> DataFrame:
    tagged = within(events, period, end_inclusive=False).filter("utm_source <> ''")
    return tagged.groupBy("utm_source", "utm_medium", "utm_campaign").agg(_events(), _visitors())


def hourly_pattern(events: DataFrame) -> DataFrame:
    return events.groupBy(F.hour("timestamp").alias("hour")).agg(_events())
