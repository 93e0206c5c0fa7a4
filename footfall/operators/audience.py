"""Who visits: devices, places, session lengths, retention, segments."""

from __future__ import annotations

from datetime import datetime, time, timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from footfall.functions.classify import duration_bucket, duration_bucket_order, filled
from footfall.functions.geo import country_code, country_name, with_country_name
from footfall.functions.numbers import (
    desc_then, percent, round_half_up, top_per, union_all, with_share,
)
from footfall.functions.ranges import DateRange, for_site, within
from footfall.operators.traffic import is_view, n_pageviews, n_sessions, n_visitors, period_rows


def breakdown(events, period, column: str, label: str, site_id=None) -> DataFrame:
    """Visitors per value of one column, blanks under `label`, with shares."""
    rows = period_rows(events, period, site_id)
    counted = rows.groupBy("site_id", filled(column, label).alias(column)).agg(n_visitors())
    return with_share(counted, ["site_id"], "visitors")


def devices(events, period, site_id=None) -> DataFrame:
    return breakdown(events, period, "device", "Desktop", site_id)


def countries(events, period, site_id=None, limit=10, additive=False) -> DataFrame:
    """Visitors per country. Codes and names of a country are one label, so a visitor seen under
    both counts once; `additive` adds the counts of the stored spellings instead."""
    rows = period_rows(events, period, site_id)
    if additive:
        per_value = rows.groupBy("site_id", filled("country", "Unknown").alias("_raw")).agg(n_visitors())
        counted = per_value.groupBy("site_id", country_name(F.col("_raw")).alias("country")).agg(
            F.sum("visitors").alias("visitors"))
    else:
        counted = with_country_name(rows).groupBy("site_id", "country").agg(n_visitors())
    shared = with_share(counted, ["site_id"], "visitors")
    top = top_per(shared, ["site_id"], desc_then("visitors", "country"), limit)
    return top.withColumn("code", country_code(F.col("country")))


def cities(events, period, site_id=None, limit=10) -> DataFrame:
    rows = period_rows(events, period, site_id)
    counted = rows.groupBy(
        "site_id", filled("city", "Unknown").alias("city"), filled("country", "Unknown").alias("country")
    ).agg(n_visitors(), n_sessions(), n_pageviews(), F.count("*").alias("_n"))
    top = top_per(counted, ["site_id"], desc_then("visitors", "city", "country"), limit)
    top = top.withColumn("engagement_rate", percent(F.col("pageviews"), F.col("_n"), 1)).drop("_n")
    return with_share(top, ["site_id"], "visitors")


def geo_map(events, period, site_id=None) -> DataFrame:
    rows = period_rows(events, period, site_id).filter(F.col("city") != "")
    return rows.groupBy("site_id", "city", "country").agg(n_visitors(), n_sessions())


def sessions_by_city(sessions, period, site_id=None, limit=10) -> DataFrame:
    rows = period_rows(sessions, period, site_id, "started_at")
    counted = rows.groupBy(
        "site_id", filled("city", "Unknown").alias("city"), filled("country", "Unknown").alias("country")
    ).agg(
        F.count("*").alias("sessions"),
        F.coalesce(round_half_up(F.avg("duration")), F.lit(0)).alias("avg_duration"),
        percent(F.count_if("is_bounce"), F.count("*"), 1).alias("bounce_rate"),
        round_half_up(F.sum("pageviews") / F.count("*"), 1).alias("avg_pageviews"),
    )
    return top_per(counted, ["site_id"], desc_then("sessions", "city", "country"), limit)


def session_duration_buckets(sessions, period, site_id=None, minute_label="30s-1m") -> DataFrame:
    rows = period_rows(sessions, period, site_id, "started_at")
    seconds = F.col("duration")
    counted = rows.groupBy(
        "site_id", duration_bucket_order(seconds).alias("bucket_order"),
        duration_bucket(seconds, minute_label).alias("bucket"),
    ).agg(F.count("*").alias("sessions"))
    return with_share(counted, ["site_id"], "sessions")


def bounce_by_entry_page(sessions, period, site_id=None, limit=10) -> DataFrame:
    rows = period_rows(sessions, period, site_id, "started_at").filter("entry_page IS NOT NULL")
    pages = rows.groupBy("site_id", F.col("entry_page").alias("page")).agg(
        F.count("*").alias("total_sessions"), F.count_if("is_bounce").alias("bounced_sessions")
    )
    top = top_per(pages, ["site_id"], desc_then("total_sessions", "page"), limit)
    return top.withColumn(
        "bounce_rate", percent(F.col("bounced_sessions"), F.col("total_sessions"), 1)
    )


def exit_pages(sessions, period, site_id=None, limit=20) -> DataFrame:
    rows = period_rows(sessions, period, site_id, "started_at").filter(F.col("exit_page") != "")
    pages = rows.groupBy("site_id", F.col("exit_page").alias("page")).agg(
        F.count("*").alias("exits"), F.countDistinct("user_id").alias("unique_users"),
        F.coalesce(round_half_up(F.avg("duration")), F.lit(0)).alias("avg_session_duration"),
    )
    top = top_per(pages, ["site_id"], desc_then("exits", "page"), limit)
    return with_share(top, ["site_id"], "exits", digits=1)


def entry_pages(sessions, period, site_id=None, limit=20) -> DataFrame:
    rows = period_rows(sessions, period, site_id, "started_at").filter(F.col("entry_page") != "")
    pages = rows.groupBy("site_id", F.col("entry_page").alias("page")).agg(
        F.count("*").alias("entries"), F.countDistinct("user_id").alias("unique_users"),
        percent(F.count_if("is_bounce"), F.count("*"), 1).alias("bounce_rate"),
        F.coalesce(round_half_up(F.avg("duration")), F.lit(0)).alias("avg_session_duration"),
    )
    top = top_per(pages, ["site_id"], desc_then("entries", "page"), limit)
    return with_share(top, ["site_id"], "entries", digits=1)


def new_vs_returning(sessions, period, site_id=None) -> DataFrame:
    """Sessions of new and returning visitors per day."""
    rows = period_rows(sessions, period, site_id, "started_at")
    back = F.coalesce(F.col("is_returning"), F.lit(False))
    return rows.groupBy("site_id", F.to_date("started_at").alias("date")).agg(
        F.count_if(~back).alias("new_visitors"),
        F.count_if(back).alias("returning_visitors"),
        F.count("*").alias("total_sessions"),
    )


def new_vs_returning_totals(sessions, period, site_id=None) -> DataFrame:
    parts = ["new_visitors", "returning_visitors", "total_sessions"]
    sums = new_vs_returning(sessions, period, site_id).groupBy("site_id").agg(
        *[F.sum(c).alias(c) for c in parts])
    return sums.select(
        "site_id", *parts,
        percent(F.col("new_visitors"), F.col("total_sessions")).alias("new_percentage"),
        percent(F.col("returning_visitors"), F.col("total_sessions")).alias("returning_percentage"),
    )


def _visit_days(events: DataFrame) -> DataFrame:
    """Distinct (site, visitor, day): at most one row per visitor and day from here on."""
    return events.select("site_id", "user_id", F.to_date("timestamp").alias("_day")).distinct()


def _cohort_counts(days: DataFrame, first: DataFrame, offsets) -> DataFrame:
    size = first.groupBy("site_id", "cohort_date").agg(F.count("*").alias("cohort_size"))
    offset = F.datediff("_day", "cohort_date")
    active = days.join(first, ["site_id", "user_id"]).withColumn("day_offset", offset)
    counted = active.filter(offsets(F.col("day_offset"))).groupBy(
        "site_id", "cohort_date", "day_offset"
    ).agg(F.count("*").alias("users"))
    return counted.join(size, ["site_id", "cohort_date"])


def retention_daily(events, period, site_id=None) -> DataFrame:
    """Of the visitors first seen on a day of the period, how many came 0 to 7 days later, up to a week
    beyond the period."""
    scope = for_site(events, site_id)
    first = within(scope, period).groupBy("site_id", "user_id").agg(
        F.to_date(F.min("timestamp")).alias("cohort_date"))
    midnight = [datetime.combine(t.date(), time.min) for t in (period.start, period.end)]
    around = within(scope, DateRange(midnight[0], midnight[1] + timedelta(days=8)), end_inclusive=False)
    counted = _cohort_counts(_visit_days(around), first, lambda d: d.between(0, 7))
    return counted.withColumnRenamed("users", "returning_users").withColumn(
        "retention_pct", percent(F.col("returning_users"), F.col("cohort_size"), 1))


def cohorts(events, period, site_id=None, offsets=(0, 1, 3, 7, 14, 30)) -> DataFrame:
    """Cohort by first day, long form: one row per cohort and day offset."""
    days = _visit_days(period_rows(events, period, site_id))
    first = days.groupBy("site_id", "user_id").agg(F.min("_day").alias("cohort_date"))
    counted = _cohort_counts(days, first, lambda d: d.isin(*offsets))
    return counted.withColumn("rate", percent(F.col("users"), F.col("cohort_size"), 1))


def cohort_matrix(events, period, site_id=None, offsets=(0, 1, 3, 7, 14, 30)) -> DataFrame:
    """Cohorts with one rate column per day offset."""
    long = cohorts(events, period, site_id, offsets)
    return long.groupBy("site_id", "cohort_date").agg(
        F.max("cohort_size").alias("cohort_size"),
        *[F.max(F.when(F.col("day_offset") == d, F.col("rate"))).alias(f"day{d}") for d in offsets],
    )


def visitor_segments(
    events, period, site_id=None, device=None, country=None, browser=None, source=None, limit=10,
) -> DataFrame:
    """Visitors, events and page views of a segment in total and by four dimensions (long form).
    One pass: each event is expanded to its five cells and aggregated map-side."""
    wanted = {"device": device, "country": country, "browser": browser, "utm_source": source}
    rows = reduce(
        lambda df, kv: df if kv[1] is None else df.filter(F.col(kv[0]) == kv[1]),
        wanted.items(), period_rows(events, period, site_id),
    )

    def cell(name, label):
        return F.struct(F.lit(name).alias("dimension"), label.alias("label"))

    cells = F.array(
        cell("all", F.lit("all")),
        cell("device", filled("device", "Desktop")),
        cell("country", filled("country", "Unknown")),
        cell("browser", filled("browser", "Unknown")),
        cell("source", filled("utm_source", "Direct")),
    )
    per_user = rows.select(
        "site_id", "user_id", is_view().alias("_view"), F.explode(cells).alias("c")
    ).groupBy("site_id", "c.dimension", "c.label", "user_id").agg(
        F.count("*").alias("events"), F.count_if("_view").alias("pageviews"))
    counted = per_user.groupBy("site_id", "dimension", "label").agg(
        F.count("*").alias("visitors"), F.sum("events").alias("events"),
        F.sum("pageviews").alias("pageviews"))
    capped = F.col("dimension").isin("country", "source")
    top = top_per(
        counted.filter(capped), ["site_id", "dimension"], desc_then("visitors", "label"), limit)
    return union_all([counted.filter(~capped), top])
