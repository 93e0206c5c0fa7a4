"""Traffic volume: series, pages, periods, realtime and the dashboard's headline numbers.

Every report covers all sites in one job, with `site_id` as the first key; `site_id=` narrows it.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.functions.classify import filled
from footfall.functions.numbers import (
    desc_then, percent, round_half_up, top_per, trend, union_all,
)
from footfall.functions.ordered import next_row
from footfall.functions.ranges import DateRange, for_site, instant, within

def is_view() -> Column:
    return F.col("type") == "pageview"


def by_day() -> Column:
    return F.to_date("timestamp").alias("date")


def n_visitors() -> Column:
    return F.countDistinct("user_id").alias("visitors")


def n_sessions() -> Column:
    return F.countDistinct("session_id").alias("sessions")


def n_pageviews() -> Column:
    return F.count_if(is_view()).alias("pageviews")


def period_rows(df, period, site_id=None, column="timestamp", end_inclusive=True) -> DataFrame:
    return for_site(within(df, period, column, end_inclusive), site_id)


def covered_by_rollup(period: DateRange, as_of: datetime) -> bool:
    """The rollup answers a period that neither starts nor ends today."""
    return as_of.date() not in (period.start.date(), period.end.date())


def traffic_over_time(events, period, site_id=None, rollup: DataFrame | None = None) -> DataFrame:
    """Visitors, sessions and page views per day, from the daily rollup when one is given."""
    if rollup is not None:
        days = F.col("date").between(F.lit(period.start.date()), F.lit(period.end.date()))
        return for_site(rollup.filter(days), site_id).select(
            "site_id", "date", "visitors", "sessions", "pageviews"
        )
    rows = period_rows(events, period, site_id)
    return rows.groupBy("site_id", by_day()).agg(n_visitors(), n_sessions(), n_pageviews())


def pageviews_over_time(events, period, site_id=None, rollup: DataFrame | None = None) -> DataFrame:
    if rollup is not None:
        return traffic_over_time(events, period, site_id, rollup).select(
            "site_id", "date", "pageviews"
        )
    rows = period_rows(events, period, site_id).filter(is_view())
    return rows.groupBy("site_id", by_day()).agg(F.count("*").alias("pageviews"))


def bounce_rate_trend(sessions, period, site_id=None) -> DataFrame:
    rows = period_rows(sessions, period, site_id, "started_at")
    return rows.groupBy("site_id", F.to_date("started_at").alias("date")).agg(
        percent(F.count_if("is_bounce"), F.count("*"), 1).alias("bounce_rate")
    )


def avg_session_trend(sessions, period, site_id=None) -> DataFrame:
    rows = period_rows(sessions, period, site_id, "started_at")
    return rows.groupBy("site_id", F.to_date("started_at").alias("date")).agg(
        F.coalesce(round_half_up(F.avg("duration")), F.lit(0)).alias("avg_duration")
    )


def top_pages(events, period, site_id=None, limit=10) -> DataFrame:
    """Most viewed pages per site, with their share of all page views of the site."""
    views = period_rows(events, period, site_id).filter(is_view())
    pages = views.groupBy("site_id", "path").agg(
        F.count("*").alias("views"), F.countDistinct("user_id").alias("unique_visitors")
    )
    top = top_per(pages, ["site_id"], desc_then("views", "path"), limit)
    totals = views.groupBy("site_id").agg(F.count("*").alias("_total"))
    return top.join(totals, "site_id").withColumn(
        "share", percent(F.col("views"), F.col("_total"), 1)
    ).drop("_total")


def page_traffic_trend(events, period, site_id=None, path: str | None = None) -> DataFrame:
    """Views and visitors per page and day, for every page or the one named."""
    views = period_rows(events, period, site_id).filter(is_view())
    if path is not None:
        views = views.filter(F.col("path") == path)
    return views.groupBy("site_id", "path", by_day()).agg(F.count("*").alias("views"), n_visitors())


def page_search_terms(events, period, site_id=None, limit=5) -> DataFrame:
    """Search terms (utm_term) that brought visitors to each page."""
    rows = period_rows(events, period, site_id).filter(F.col("utm_term") != "")
    terms = rows.groupBy("site_id", "path", F.col("utm_term").alias("keyword")).agg(n_visitors())
    return top_per(terms, ["site_id", "path"], desc_then("visitors", "keyword"), limit)


def page_wow(events, period, site_id=None, limit=20) -> DataFrame:
    """Pages with the largest change between the last 7 days of the period and the 7 before."""
    views = period_rows(events, period, site_id).filter(is_view())
    ts = F.col("timestamp")
    week, fortnight = (
        instant(events, "timestamp", period.end - timedelta(days=d)) for d in (7, 14)
    )
    pages = views.groupBy("site_id", "path").agg(
        F.count_if(ts > week).alias("current_views"),
        F.count_if((ts <= week) & (ts > fortnight)).alias("previous_views"),
    ).filter("current_views > 0 OR previous_views > 0")
    change = F.col("current_views") - F.col("previous_views")
    pages = pages.withColumn("change_abs", change).withColumn("_size", F.abs(change))
    top = top_per(pages, ["site_id"], desc_then("_size", "path"), limit).drop("_size")
    was_none = F.col("previous_views") == 0
    pct = F.floor(F.col("change_abs") / F.nullif(F.col("previous_views"), F.lit(0)) * 100 * 10 + 0.5) / 10
    return top.withColumn(
        "change_pct", F.when(was_none, F.when(F.col("current_views") > 0, 100.0).otherwise(0.0))
        .otherwise(pct)
    ).withColumn("direction", direction(F.col("change_abs")))


def direction(change: Column) -> Column:
    return F.when(change < 0, "drop").when(change > 0, "spike").otherwise("flat")


def minutes_and_seconds(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "),
                    round_half_up(seconds % 60).cast("string"), F.lit("s"))


def headline() -> list[Column]:
    """Headline numbers and trends from the totals of a period (`total_visitors`, `total_pageviews`,
    `total_sessions`, `_bounces`, `_duration`) and of the one before."""
    def rate(bounces: str, n: str) -> Column:
        return F.coalesce(F.col(bounces) / F.nullif(F.col(n), F.lit(0)) * 100, F.lit(0.0))

    bounce, bounce_before = rate("_bounces", "total_sessions"), rate("_bounces_before", "_sessions")
    pages = F.col("total_pageviews") / F.nullif(F.col("total_sessions"), F.lit(0))

    def grew(a: str, b: str) -> Column:
        return trend(F.col(a).cast("double"), F.col(b).cast("double"))

    return [
        F.col("total_visitors"), F.col("total_pageviews"), F.col("total_sessions"),
        round_half_up(bounce, 1).alias("bounce_rate"),
        minutes_and_seconds(F.col("_duration")).alias("avg_session_duration"),
        F.format_string("%.2f", F.coalesce(pages, F.lit(0.0))).alias("pages_per_session"),
        grew("total_visitors", "_visitors").alias("visitors_trend"),
        grew("total_pageviews", "_pageviews").alias("pageviews_trend"),
        trend(bounce, bounce_before).alias("bounce_rate_trend"),
        grew("_duration", "_duration_before").alias("session_trend"),
    ]


def kpi_summary(events, sessions, period, site_id=None) -> DataFrame:
    """Headline numbers of the period and their trend against the equally long one before.
    Events are reduced to one row per (site, period, visitor) before anything is counted."""
    before = period.previous()
    whole = DateRange(before.start, period.end)

    def tagged(df, column):
        rows = period_rows(df, whole, column=column, site_id=site_id)
        return rows.withColumn("_now", F.col(column) >= instant(df, column, period.start))

    per_user = tagged(events, "timestamp").groupBy("site_id", "_now", "user_id").agg(n_pageviews())
    now, then = F.col("_now"), ~F.col("_now")

    def side(flag: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(flag, F.col(c))), F.lit(0))

    traffic = per_user.groupBy("site_id").agg(
        F.count_if(now).alias("total_visitors"), F.count_if(then).alias("_visitors"),
        side(now, "pageviews").alias("total_pageviews"), side(then, "pageviews").alias("_pageviews"),
    )
    visits = tagged(sessions, "started_at").groupBy("site_id").agg(
        F.count_if(now).alias("total_sessions"), F.count_if(then).alias("_sessions"),
        F.count_if(now & F.col("is_bounce")).alias("_bounces"),
        F.count_if(then & F.col("is_bounce")).alias("_bounces_before"),
        F.avg(F.when(now, F.col("duration"))).alias("_duration"),
        F.avg(F.when(then, F.col("duration"))).alias("_duration_before"),
    )

    both = traffic.join(visits, "site_id", "left").na.fill(0)
    return both.select("site_id", *headline())


def kpi_from_rollup(rollup, period, site_id=None) -> DataFrame:
    """The same headline from daily totals. Daily visitors are added up, so a visitor of two days
    counts twice; bounces and durations are weighted by the sessions of each day."""
    before = period.previous()
    day = F.col("date")
    now = day.between(F.lit(period.start.date()), F.lit(period.end.date()))
    then = (day >= F.lit(before.start.date())) & (day < F.lit(before.end.date()))
    rows = for_site(rollup.filter(now | then), site_id).withColumn("seconds", F.col("avg_duration") * F.col("sessions"))
    parts = ["visitors", "sessions", "pageviews", "bounces", "seconds"]

    def total(flag: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(flag, F.col(c))), F.lit(0))

    sums = rows.groupBy("site_id").agg(
        *[total(now, c).alias(c) for c in parts], *[total(then, c).alias(f"_{c}") for c in parts],
    ).filter("visitors > 0")

    def per_session(c: str, before: str = "") -> Column:
        n = F.nullif(F.col(f"{before}sessions").cast("double"), F.lit(0.0))
        return F.coalesce(F.col(f"{before}{c}") / n, F.lit(0.0))

    seconds, seconds_before = per_session("seconds"), per_session("seconds", "_")
    bounce, bounce_before = per_session("bounces") * 100, per_session("bounces", "_") * 100
    return sums.select(
        "site_id",
        F.col("visitors").alias("total_visitors"),
        F.col("pageviews").alias("total_pageviews"),
        F.col("sessions").alias("total_sessions"),
        percent(F.col("bounces"), F.col("sessions"), 1).alias("bounce_rate"),
        trend(F.col("visitors").cast("double"), F.col("_visitors").cast("double"))
        .alias("visitors_trend"),
        trend(F.col("pageviews").cast("double"), F.col("_pageviews").cast("double"))
        .alias("pageviews_trend"),
        minutes_and_seconds(seconds).alias("avg_session_duration"),
        F.format_string("%.2f", per_session("pageviews")).alias("pages_per_session"),
        trend(bounce, bounce_before).alias("bounce_rate_trend"),
        trend(seconds, seconds_before).alias("session_trend"),
    )


def comparison(events, period, site_id=None) -> DataFrame:
    """Daily series of the period beside the one before it, matched by day number."""
    in_order = Window.partitionBy("site_id").orderBy("date")

    def series(p, end_inclusive):
        rows = period_rows(events, p, site_id, end_inclusive=end_inclusive)
        daily = rows.groupBy("site_id", by_day()).agg(n_visitors(), n_sessions(), n_pageviews())
        return daily.withColumn("_day", F.row_number().over(in_order))

    before = series(period.previous(), False).select(
        "site_id", "_day", *[F.col(c).alias(f"prev_{c}")
                             for c in ("date", "visitors", "sessions", "pageviews")])
    zipped = series(period, True).join(before, ["site_id", "_day"], "left").drop("_day")
    return zipped.na.fill(0, ["prev_visitors", "prev_sessions", "prev_pageviews"])


def user_flow(events, period, site_id=None, limit=20) -> DataFrame:
    """Page-to-next-page transitions within a session. Sessions are cut into hours, so one
    enormous session does not end up in one task."""
    views = period_rows(events, period, site_id).filter(is_view()).select(
        "site_id", "session_id", "timestamp", "id", "path"
    )
    steps = next_row(views, ["site_id", "session_id"], ["timestamp", "id"], {"to_page": "path"})
    flows = steps.filter("to_page IS NOT NULL").groupBy(
        "site_id", F.col("path").alias("from_page"), "to_page"
    ).agg(F.count("*").alias("transitions"))
    return top_per(flows, ["site_id"], desc_then("transitions", "from_page", "to_page"), limit)


def flow_ends(sessions, period, site_id=None, limit=10) -> DataFrame:
    """Top entry and exit pages of the sessions (`side` = entry / exit)."""
    rows = period_rows(sessions, period, site_id, "started_at")
    ends = rows.select("site_id", F.explode(F.array(
        F.struct(F.lit("entry").alias("side"), F.col("entry_page").alias("page")),
        F.struct(F.lit("exit").alias("side"), F.col("exit_page").alias("page")),
    )).alias("e")).select("site_id", "e.*").filter("page IS NOT NULL")
    counted = ends.groupBy("site_id", "side", "page").agg(F.count("*").alias("count"))
    return top_per(counted, ["site_id", "side"], desc_then("count", "page"), limit)


def realtime_summary(events, as_of: datetime, site_id=None, minutes=5, limit=10) -> DataFrame:
    """Visitors of the last minutes in total, per page, device and country (long form).
    One row per (site, dimension, label): one expansion, one distinct count."""
    recent = period_rows(events, DateRange(as_of - timedelta(minutes=minutes), as_of), site_id)

    def cell(name: str, label: Column) -> Column:
        return F.struct(F.lit(name).alias("dimension"), label.alias("label"))

    cells = F.array(
        cell("total", F.lit("active")),
        cell("page", F.when(is_view(), F.col("path"))),
        cell("device", filled("device", "Desktop")),
        cell("country", filled("country", "Unknown")),
    )
    long = recent.select("site_id", "user_id", F.explode(cells).alias("c")).select(
        "site_id", "user_id", "c.*"
    ).filter("label IS NOT NULL")
    counted = long.groupBy("site_id", "dimension", "label").agg(n_visitors())
    keep = F.col("dimension").isin("total", "device")
    capped = top_per(
        counted.filter(~keep), ["site_id", "dimension"], desc_then("visitors", "label"), limit
    )
    return union_all([counted.filter(keep), capped])


def event_stream_tail(events, as_of: datetime, site_id=None, minutes=5, limit=50) -> DataFrame:
    """The latest events of the last minutes, blanks shown as their defaults."""
    recent = period_rows(events, DateRange(as_of - timedelta(minutes=minutes), as_of), site_id)
    newest = top_per(recent, ["site_id"], [F.col("timestamp").desc(), F.col("id").desc()], limit)
    blank_to_null = ["referrer", "city", "utm_source", "utm_medium", "utm_campaign"]
    return newest.select(
        "site_id", "id", "type", "path", "url", "user_id", "session_id", "timestamp",
        filled("device", "Desktop").alias("device"),
        *[filled(c, "Unknown").alias(c) for c in ("browser", "os", "country")],
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in blank_to_null],
    )


def moving_alerts(
    series: DataFrame, measure: str, kinds: dict[str, str], noun: str, unit: str,
) -> DataFrame:
    """Days outside mean +- 2 standard deviations of the up to 7 days before (at least 3).
    `kinds` maps spike/drop to severity; rows per site are days, so the window stays small."""
    w = Window.partitionBy("site_id").orderBy("date")
    trailing = w.rowsBetween(-7, -1)
    value = F.col(measure).cast("double")
    scored = series.select(
        "site_id", "date", F.col(measure).alias("value"),
        F.avg(value).over(trailing).alias("_mean"),
        F.stddev_pop(value).over(trailing).alias("_sd"),
        F.row_number().over(w).alias("_n"),
    ).filter("_n > 3 AND _sd > 0 AND _mean > 0")
    side = F.when(F.col("value") > F.col("_mean") + 2 * F.col("_sd"), "spike").when(
        F.col("value") < F.col("_mean") - 2 * F.col("_sd"), "drop")
    mean = round_half_up(F.col("_mean"))
    hits = scored.withColumn("_side", side).filter(F.col("_side").isin(*kinds))
    severity = F.coalesce(*[F.when(F.col("_side") == k, s) for k, s in kinds.items()])
    return hits.select(
        "site_id", "date",
        (F.col("_side") if noun == "Traffic" else F.concat(F.lit("error_"), F.col("_side")))
        .alias("type"),
        severity.alias("severity"),
        F.concat(F.lit(f"{noun} "), F.col("_side"), F.lit(": "), F.col("value").cast("string"),
                 F.lit(f" {unit} (avg: "), mean.cast("string"), F.lit(")")).alias("message"),
        "value", mean.alias("average"),
        round_half_up((F.col("value") - F.col("_mean")) / F.col("_mean") * 100).alias("change"),
    )


def traffic_alerts(events, period, site_id=None, daily: DataFrame | None = None) -> DataFrame:
    """Spikes (warning) and drops (error) in daily visitors."""
    series = traffic_over_time(events, period, site_id) if daily is None else daily
    return moving_alerts(
        series, "visitors", {"spike": "warning", "drop": "error"}, "Traffic", "visitors"
    )


def error_alerts(daily_errors: DataFrame) -> DataFrame:
    """Spikes in a daily series (site_id, date, events) of error counts."""
    return moving_alerts(daily_errors, "events", {"spike": "error"}, "Error", "events")


def daily_active_users(events, period, site_id=None) -> DataFrame:
    rows = period_rows(events, period, site_id)
    return rows.groupBy("site_id", by_day()).agg(F.countDistinct("user_id").alias("unique_users"))


def hourly_pattern(events, period, site_id=None) -> DataFrame:
    views = period_rows(events, period, site_id).filter(is_view())
    return views.groupBy("site_id", F.hour("timestamp").alias("hour")).agg(
        n_visitors(), F.count("*").alias("pageviews")
    )


def annotations_in_range(annotations, period, site_id=None) -> DataFrame:
    """Notes of the period's days, blanks shown as their defaults."""
    days = F.col("date").between(F.lit(period.start.date()), F.lit(period.end.date()))
    return for_site(annotations.filter(days), site_id).select(
        "site_id", "id", "date", "title", F.coalesce("description", F.lit("")).alias("description"),
        filled("category", "general").alias("category"))


def annotate(daily: DataFrame, annotations: DataFrame) -> DataFrame:
    """A daily series with the notes of each day."""
    return daily.join(annotations, ["site_id", "date"], "left")
