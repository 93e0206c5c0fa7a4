"""Sessions derived from events: by id, by inactivity gap, and first-visit marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.ordered import previous_row, running_total

_FIRST_TOUCH = [
    "referrer", "device", "browser", "os", "country", "city",
    "utm_source", "utm_medium", "utm_campaign",
]


def sessionise_by_id(events: DataFrame) -> DataFrame:
    """One row per (site, session, user). Struct minima merge map-side, so a session with very
    many events shuffles one partial row per task."""
    at = [F.col("timestamp").alias("ts"), F.col("id")]
    is_view = F.col("type") == "pageview"
    first_event = F.min(F.struct(*at, *_FIRST_TOUCH))
    first_view = F.min(F.when(is_view, F.struct(*at, "path")))
    last_view = F.max(F.when(is_view, F.struct(*at, "path")))
    grouped = events.groupBy("site_id", F.col("session_id").alias("id"), "user_id").agg(
        first_event.alias("_first"),
        F.max("timestamp").alias("ended_at"),
        F.count_if(is_view).alias("pageviews"),
        first_view.alias("_entry"),
        last_view.alias("_exit"),
    )
    return grouped.select(
        "site_id", "id", "user_id",
        F.col("_first.ts").alias("started_at"),
        "ended_at",
        F.expr("timestampdiff(SECOND, _first.ts, ended_at)").alias("duration"),
        "pageviews",
        F.col("_entry.path").alias("entry_page"),
        F.col("_exit.path").alias("exit_page"),
        *[F.col(f"_first.{c}").alias(c) for c in _FIRST_TOUCH],
        (F.col("pageviews") <= 1).alias("is_bounce"),
    )


def with_returning(sessions: DataFrame) -> DataFrame:
    """`is_returning`: the visitor has an earlier session on the site; NULL for sessions of nobody. Joins each
    session to the visitor's first one instead of ordering a whole visitor history in one task."""
    order: Column = F.struct("started_at", "id")
    first = sessions.groupBy("site_id", "user_id").agg(F.min(order).alias("_first"))
    return (
        sessions.join(first, ["site_id", "user_id"], "left")
        .withColumn("is_returning", order > F.col("_first"))
        .drop("_first")
    )


def mark_returning(sessions: DataFrame) -> DataFrame:
    """`with_returning` for the sessions of known visitors."""
    return with_returning(sessions.filter("site_id IS NOT NULL AND user_id IS NOT NULL"))


def sessionise_by_gap(events: DataFrame, gap_minutes: int = 30, chunk: str = "hour") -> DataFrame:
    """Adds `session_start` and `session_no` per (site, visitor) for logs without a session id.
    A new session opens after more than `gap_minutes` without an event."""
    keys = ["site_id", "user_id"]
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    ordered = events.withColumn("_at", micros)
    ordered = previous_row(ordered, keys, ["_at", "id"], {"_prev": "_at"}, chunk)
    opens = F.col("_prev").isNull() | (F.col("_at") - F.col("_prev") > gap_minutes * 60_000_000)
    flagged = ordered.withColumn("_opens", opens.cast("bigint"))
    return running_total(flagged, keys, ["_at", "id"], "_opens", "session_no", chunk).drop(
        "_at", "_prev", "_opens"
    )


def gap_sessions(events: DataFrame, gap_minutes: int = 30, chunk: str = "hour") -> DataFrame:
    """One row per gap-separated session."""
    numbered = sessionise_by_gap(events, gap_minutes, chunk)
    return numbered.groupBy("site_id", "user_id", "session_no").agg(
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        F.count("*").alias("events"),
        F.count_if(F.col("type") == "pageview").alias("pageviews"),
    ).withColumn("duration", F.expr("timestampdiff(SECOND, started_at, ended_at)"))
