"""Where visitors come from: sources, campaigns, keywords, social platforms, revenue by source."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.classify import filled, is_blank, social_platform, source_class
from footfall.functions.numbers import (
    desc_then, exact_mean, exact_sum, round_half_up, top_per, with_share,
)
from footfall.functions.ranges import within
from footfall.operators.traffic import by_day, n_pageviews, n_sessions, n_visitors, period_rows


def json_number(name: str) -> Column:
    """A numeric event property; anything unreadable, NaN and infinite is NULL."""
    value = F.get_json_object("properties", f"$.{name}").try_cast("double")
    return F.when(value.between(-sys.float_info.max, sys.float_info.max), value)


def json_text(name: str) -> Column:
    return F.get_json_object("properties", f"$.{name}")


def is_purchase() -> Column:
    return F.col("type") == "purchase"


_UTM = {"source": "utm_source", "medium": "utm_medium", "campaign": "utm_campaign"}


def _utm_keys() -> list[Column]:
    return [filled(c, "(none)").alias(n) for n, c in _UTM.items()]


def traffic_sources(events, period, site_id=None) -> DataFrame:
    rows = period_rows(events, period, site_id)
    counted = rows.groupBy("site_id", source_class(F.col("referrer")).alias("source")).agg(n_visitors())
    return with_share(counted, ["site_id"], "visitors")


def _tagged(events, period, site_id) -> DataFrame:
    any_utm = ~(is_blank(F.col("utm_source")) & is_blank(F.col("utm_medium"))
                & is_blank(F.col("utm_campaign")))
    return period_rows(events, period, site_id).filter(any_utm)


def utm_campaigns(events, period, site_id=None, limit=20) -> DataFrame:
    counted = _tagged(events, period, site_id).groupBy("site_id", *_utm_keys()).agg(
        n_visitors(), n_pageviews())
    top = top_per(counted, ["site_id"], desc_then("visitors", *_UTM), limit)
    return with_share(top, ["site_id"], "visitors")


def campaign_dashboard(events, period, site_id=None, limit=30) -> DataFrame:
    value = F.when(is_purchase(), json_number("value"))
    counted = _tagged(events, period, site_id).groupBy("site_id", *_utm_keys()).agg(
        n_visitors(), n_pageviews(), F.count_if(is_purchase()).alias("purchases"),
        round_half_up(exact_sum(value), 2).alias("revenue"))
    top = top_per(counted, ["site_id"], desc_then("visitors", *_UTM), limit)
    return with_share(top, ["site_id"], "visitors")


def social_traffic(events, period, site_id=None, match="substring") -> DataFrame:
    rows = period_rows(events, period, site_id).withColumn(
        "platform", social_platform(F.col("referrer"), match)).filter("platform IS NOT NULL")
    counted = rows.groupBy("site_id", "platform").agg(n_visitors(), n_pageviews(), n_sessions())
    return with_share(counted, ["site_id"], "visitors")


def search_keywords(events, period, site_id=None, limit=20) -> DataFrame:
    rows = period_rows(events, period, site_id).filter(F.col("utm_term") != "")
    counted = rows.groupBy(
        "site_id", F.col("utm_term").alias("keyword"), filled("utm_source", "(direct)").alias("source")
    ).agg(n_visitors(), n_pageviews())
    return top_per(counted, ["site_id"], desc_then("visitors", "keyword", "source"), limit)


def utm_link_stats(events, links: DataFrame, period=None) -> DataFrame:
    """Visits per saved link. A link matches on those of its three tags that are filled in.

    Each event is expanded to the eight tag combinations it may satisfy, after reducing events to
    distinct (site, tags, visitor); the match is then an equality join on all three tags."""
    rows = events if period is None else within(events, period)
    tags = list(_UTM.values())
    per_user = rows.groupBy("site_id", *tags, "user_id").agg(
        n_pageviews(), F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))

    def either(tag: str) -> Column:
        value = filled(tag, "")
        return F.array_distinct(F.array(value, F.lit("")))

    keyed = per_user
    for tag in tags:
        keyed = keyed.withColumn(f"_{tag}", F.explode(either(tag)))
    wanted = links.select(
        F.col("id").alias("link_id"), F.col("site_id"), *[filled(t, "").alias(f"_{t}") for t in tags])
    on = ["site_id", *[f"_{t}" for t in tags]]
    hits = keyed.join(wanted, on).groupBy("link_id").agg(
        F.countDistinct("user_id").alias("visitors"), F.sum("pageviews").alias("pageviews"),
        F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen"))
    return links.select(F.col("id").alias("link_id"), "site_id").join(hits, "link_id", "left").na.fill(
        0, ["visitors", "pageviews"])


def revenue_summary(events, period, site_id=None) -> DataFrame:
    rows = period_rows(events, period, site_id).filter(is_purchase())
    value = json_number("value")
    return rows.groupBy("site_id").agg(
        F.count("*").alias("total_purchases"), F.countDistinct("user_id").alias("unique_buyers"),
        round_half_up(exact_sum(value), 2).alias("total_revenue"),
        F.coalesce(round_half_up(exact_mean(value), 2), F.lit(0.0)).alias("avg_order_value"))


def revenue_daily(events, period, site_id=None) -> DataFrame:
    rows = period_rows(events, period, site_id).filter(is_purchase())
    return rows.groupBy("site_id", by_day()).agg(
        F.count("*").alias("purchases"),
        round_half_up(exact_sum(json_number("value")), 2).alias("revenue"))


def revenue_by_source(events, period, site_id=None) -> DataFrame:
    rows = period_rows(events, period, site_id).filter(is_purchase())
    value = json_number("value")
    return rows.groupBy("site_id", filled("utm_source", "Direct").alias("source")).agg(
        F.count("*").alias("purchases"), round_half_up(exact_sum(value), 2).alias("revenue"),
        F.coalesce(round_half_up(exact_mean(value), 2), F.lit(0.0)).alias("avg_value"))
