"""The daily rollup: totals per (site, day), recomputed for exactly the days that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.classify import filled, rollup_source_class
from footfall.functions.numbers import desc_then, top_per
from footfall.functions.ranges import DateRange, for_site
from footfall.operators.acquisition import json_number, json_text
from footfall.operators.sessions import sessionise_by_id
from footfall.operators.traffic import is_view, n_pageviews, n_sessions, n_visitors

_KEYS = ["site_id", "date"]


def _dated(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("date", F.to_date(column))


def daily_rollup(events: DataFrame, sessions: DataFrame | None = None,
                 days: DataFrame | None = None) -> DataFrame:
    """Visitors, sessions, page views, bounces and mean session length per (site, day); with
    `days`, only for those pairs. A session belongs to the day it started."""
    visits = sessionise_by_id(events) if sessions is None else sessions
    e, s = _dated(events, "timestamp"), _dated(visits, "started_at")
    if days is not None:
        e, s = (df.join(days, _KEYS, "left_semi") for df in (e, s))
    counts = e.groupBy(*_KEYS).agg(n_visitors(), n_sessions(), n_pageviews())
    ends = s.groupBy(*_KEYS).agg(
        F.count_if("is_bounce").alias("bounces"), F.avg("duration").alias("avg_duration"))
    return counts.join(ends, _KEYS, "left").na.fill(0, ["bounces"]).na.fill(0.0, ["avg_duration"])


def daily_visitor_sketches(events: DataFrame, lg_k: int = 14) -> DataFrame:
    """A mergeable sketch of the visitors per (site, day), 2**lg_k registers: the opt-in, approximate way
    to count visitors of any period without its events (standard error about 0.8 % by default)."""
    return _dated(events, "timestamp").groupBy(*_KEYS).agg(F.hll_sketch_agg("user_id", lg_k).alias("visitor_sketch"))


def visitors_from_sketches(sketches: DataFrame, period: DateRange, site_id: str | None = None) -> DataFrame:
    """Approximate visitors of the days of a period."""
    days = F.col("date").between(F.lit(period.start.date()), F.lit(period.end.date()))
    return for_site(sketches.filter(days), site_id).groupBy("site_id").agg(
        F.hll_sketch_estimate(F.hll_union_agg("visitor_sketch")).alias("visitors_estimate"))


#: Accuracy of the sketches of vitals: the rank of a percentile from merged sketches is off by this share of the
#: samples at most, with 99 % confidence.
VITALS_K, VITALS_RANK_ERROR = 400, 0.01


def daily_vital_sketches(events: DataFrame, k: int = VITALS_K) -> DataFrame:
    """A mergeable sketch of the web vitals per (site, day, metric), for each page and, with a NULL path, for
    all pages: the opt-in way to percentiles of any period without its events."""
    vitals = _dated(events.filter(F.col("type") == "web_vital"), "timestamp").select(
        *_KEYS, "path", json_text("name").alias("metric"), json_number("value").alias("value")).filter("value IS NOT NULL")
    each = vitals.withColumn("_page", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("path", F.when(F.col("_page"), F.col("path")))
    return each.groupBy(*_KEYS, "path", "metric").agg(
        F.expr(f"kll_sketch_agg_double(value, {k})").alias("sketch"), F.count("*").alias("samples"))


def vitals_from_sketches(sketches: DataFrame, period: DateRange, site_id: str | None = None, share: float = 0.75) -> DataFrame:
    """Samples and a percentile of each (site, page, metric) over the days of a period; a NULL path stands for all pages.
    A group has one sketch a day, so what is merged in one place is bounded by the days of the period."""
    days = F.col("date").between(F.lit(period.start.date()), F.lit(period.end.date()))
    merged = for_site(sketches.filter(days), site_id).groupBy("site_id", "path", "metric").agg(
        F.collect_list("sketch").alias("_each"), F.sum("samples").alias("samples"))
    whole = F.expr("aggregate(slice(_each, 2, size(_each)), _each[0], (a, b) -> kll_sketch_merge_double(a, b))")
    return merged.withColumn("sketch", whole).select(
        "site_id", "path", "metric", "samples",
        F.expr(f"kll_sketch_get_quantile_double(sketch, {share}D)").alias("percentile"), "sketch")


def daily_top_lists(events: DataFrame, limit: int = 10) -> DataFrame:
    """Per (site, day) and list: label, measure and rank. Pages and countries keep `limit` rows;
    source classes and devices are few by nature and kept whole. Each event is expanded to its cells
    and counted per visitor map-side: one scan and one large shuffle for all lists."""
    def cell(name: str, label: Column) -> Column:
        return F.struct(F.lit(name).alias("list"), label.alias("label"))

    cells = F.array_compact(F.array(
        F.when(is_view(), cell("top_pages", F.col("path"))),
        cell("sources", rollup_source_class(F.col("referrer"))),
        cell("devices", filled("device", "Desktop")),
        cell("countries", filled("country", "Unknown"))))
    per_user = _dated(events, "timestamp").select(*_KEYS, "user_id", F.explode(cells).alias("c")).groupBy(
        *_KEYS, "c.list", "c.label", "user_id").agg(F.count("*").alias("_views"))
    counted = per_user.groupBy(*_KEYS, "list", "label").agg(
        F.sum("_views").alias("_views"), F.count("*").alias("_visitors")
    ).withColumn("value", F.when(F.col("list") == "top_pages", F.col("_views")).otherwise(F.col("_visitors")))
    counted = counted.drop("_views", "_visitors")
    long_lists = F.col("list").isin("top_pages", "countries")
    capped = top_per(
        counted.filter(long_lists), [*_KEYS, "list"], desc_then("value", "label"), limit)
    return counted.filter(~long_lists).unionByName(capped)


def daily_rollup_full(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The rollup with its four lists as JSON columns, largest first."""
    lists = daily_top_lists(events)
    label_of = {"top_pages": ("path", "views"), "sources": ("source", "visitors"),
                "devices": ("device", "visitors"), "countries": ("country", "visitors")}

    def as_json(name: str):
        label, measure = label_of[name]
        entry = F.when(F.col("list") == name, F.struct((-F.col("value")).alias("o"), "label", "value"))
        ordered = F.sort_array(F.collect_list(entry))
        shaped = F.transform(ordered, lambda r: F.struct(r["label"].alias(label), r["value"].alias(measure)))
        return F.to_json(shaped).alias(name)

    packed = lists.groupBy(*_KEYS).agg(*[as_json(n) for n in label_of])
    return daily_rollup(events, sessions).join(packed, _KEYS, "left")
