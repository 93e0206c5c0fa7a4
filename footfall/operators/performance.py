"""Page speed and script errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.classify import filled, vital_rating
from footfall.functions.numbers import (
    desc_then, exact, round_half_up, round_interpolated, top_per,
)
from footfall.functions.ranks import with_percentile
from footfall.operators.acquisition import json_number, json_text
from footfall.operators.traffic import by_day, period_rows

def _mean() -> Column:
    """Mean of the histogram (v, n), from an exact sum."""
    total = F.sum(exact(F.col("v")) * F.col("n").cast("decimal(10,0)")).cast("double")
    return round_half_up(total / F.nullif(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)), 2)


def _vitals(events, period, site_id) -> DataFrame:
    return period_rows(events, period, site_id).filter(F.col("type") == "web_vital").withColumn(
        "metric", json_text("name"))


def _vital_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    stats = with_percentile(rows, [*keys, "metric"], json_number("value"), 0.75, [
        F.coalesce(_mean(), F.lit(0.0)).alias("avg_value"), F.sum("n").alias("samples")])
    return stats.withColumn(
        "p75_value", F.coalesce(round_interpolated(F.col("percentile"), 2), F.lit(0.0))).drop("percentile")


def web_vitals_by_page(events, period, site_id=None, limit=20) -> DataFrame:
    """Average and 75th percentile per page and metric, of the pages with most samples. The pages
    are chosen by a plain count first; only their samples go on."""
    rows = _vitals(events, period, site_id)
    counted = rows.groupBy("site_id", "path").agg(F.count("*").alias("page_samples"))
    busiest = top_per(counted, ["site_id"], desc_then("page_samples", "path"), limit)
    kept = rows.join(busiest, ["site_id", "path"])
    return _vital_stats(kept, ["site_id", "path", "page_samples"])


def web_vitals_overview(events, period, site_id=None, inclusive=True) -> DataFrame:
    stats = _vital_stats(_vitals(events, period, site_id), ["site_id"])
    return stats.withColumn("rating", vital_rating(F.col("metric"), F.col("p75_value"), inclusive))


def js_errors(events, period, site_id=None, limit=30) -> DataFrame:
    rows = period_rows(events, period, site_id).filter(F.col("type") == "js_error")
    counted = rows.groupBy(
        "site_id", filled(json_text("message"), "Unknown error").alias("message"),
        F.coalesce(json_text("source"), F.lit("")).alias("source_file"), F.col("path").alias("page"),
    ).agg(
        F.count("*").alias("occurrences"), F.countDistinct("user_id").alias("affected_users"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return top_per(
        counted, ["site_id"], desc_then("occurrences", "message", "source_file", "page"), limit)


def js_errors_daily(events, period, site_id=None) -> DataFrame:
    rows = period_rows(events, period, site_id).filter(F.col("type") == "js_error")
    return rows.groupBy("site_id", by_day()).agg(
        F.count("*").alias("errors"), F.countDistinct("user_id").alias("affected_users"))
