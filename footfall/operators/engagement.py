"""What visitors do on a page: scrolling, clicking, rage clicks, reading time, searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.functions.classify import filled
from footfall.functions.numbers import desc_then, round_half_up, round_interpolated, top_per
from footfall.functions.ranks import with_percentile
from footfall.operators.acquisition import json_number, json_text
from footfall.operators.traffic import period_rows


def _of_type(events, period, site_id, kind) -> DataFrame:
    return period_rows(events, period, site_id).filter(F.col("type") == kind)


def whole(x: Column) -> Column:
    """A fraction as the nearest integer (casting alone would cut it off); NULL beyond 64 bits."""
    return F.round(x).try_cast("bigint")


def mean_1dp(x: Column) -> Column:
    return round_half_up(F.avg(x), 1)


def scroll_depth(events, period, site_id=None, limit=20) -> DataFrame:
    rows = _of_type(events, period, site_id, "scroll_depth").filter(json_text("milestone") == "true")
    depth = json_number("depth")
    pages = rows.groupBy("site_id", "path").agg(
        *[F.count_if(whole(depth) >= d).alias(f"reached_{d}") for d in (25, 50, 75, 100)],
        F.count("*").alias("total_events"),
        F.coalesce(mean_1dp(depth), F.lit(0.0)).alias("avg_depth"),
    )
    return top_per(pages, ["site_id"], desc_then("total_events", "path"), limit)


def heatmap_points(events, period, site_id=None, path=None, limit=500) -> DataFrame:
    """Click positions per page, the most clicked ones of each page."""
    rows = _of_type(events, period, site_id, "heatmap_click")
    if path is not None:
        rows = rows.filter(F.col("path") == path)

    def number(name: str) -> Column:
        return F.coalesce(json_number(name), F.lit(0.0))

    points = rows.groupBy(
        "site_id", "path", number("relX").alias("rel_x"), number("relY").alias("rel_y"),
        whole(number("x")).alias("abs_x"), whole(number("y")).alias("abs_y"),
        F.coalesce(json_text("selector"), F.lit("")).alias("selector"),
    ).agg(F.count("*").alias("clicks"))
    order = desc_then("clicks", "rel_x", "rel_y", "abs_x", "abs_y", "selector")
    return top_per(points, ["site_id", "path"], order, limit)


def heatmap_summary(events, period, site_id=None, limit=50) -> DataFrame:
    rows = _of_type(events, period, site_id, "heatmap_click")
    counted = rows.groupBy(
        "site_id", "path", F.coalesce(json_text("selector"), F.lit("")).alias("selector")
    ).agg(F.count("*").alias("clicks"))
    return top_per(counted, ["site_id"], desc_then("clicks", "path", "selector"), limit)


def page_actions(events, period, site_id=None, path=None, limit=30) -> DataFrame:
    rows = _of_type(events, period, site_id, "heatmap_click")
    if path is not None:
        rows = rows.filter(F.col("path") == path)
    counted = rows.groupBy(
        "site_id", "path", filled(json_text("text"), "(no text)").alias("text"),
        F.coalesce(json_text("selector"), F.lit("")).alias("selector"),
        F.coalesce(json_text("tag"), F.lit("")).alias("tag"),
    ).agg(F.count("*").alias("clicks"), F.countDistinct("user_id").alias("unique_users"))
    return top_per(
        counted, ["site_id", "path"], desc_then("clicks", "text", "selector", "tag"), limit)


def heatmap_clusters(points: DataFrame, radius: float = 3.0) -> DataFrame:
    """Merge points within `radius` percent of an earlier (more clicked) one. The input is the
    per-page top list of `heatmap_points`, so a group never exceeds that list's limit."""

    def merge(page: pd.DataFrame) -> pd.DataFrame:
        order = ["rel_x", "rel_y", "abs_x", "abs_y", "selector"]
        page = page.sort_values(["clicks", *order], ascending=[False] + [True] * 5, ignore_index=True)
        x, y = page["rel_x"].to_numpy(), page["rel_y"].to_numpy()
        free = np.ones(len(page), dtype=bool)
        heads, clicks, members = [], [], []
        for i in range(len(page)):
            if free[i]:
                near = free & (np.sqrt((x - x[i]) ** 2 + (y - y[i]) ** 2) <= radius)
                near[:i] = False
                near[i] = True
                free &= ~near
                heads.append(i)
                clicks.append(int(page["clicks"][near].sum()))
                members.append(int(near.sum()))
        out = page.loc[heads, ["site_id", "path", "rel_x", "rel_y", "selector"]].copy()
        return out.assign(clicks=clicks, members=members)

    return points.groupBy("site_id", "path").applyInPandas(
        merge,
        "site_id string, path string, rel_x double, rel_y double, selector string, "
        "clicks bigint, members bigint",
    )


def heatmap_grid(events, period, site_id=None, cell: float = 3.0) -> DataFrame:
    """All clicks per page on a grid of `cell` percent: the unlimited form of the clusters."""
    rows = _of_type(events, period, site_id, "heatmap_click")

    def slot(name: str) -> Column:
        return F.floor(F.coalesce(json_number(name), F.lit(0.0)) / cell)

    return rows.groupBy(
        "site_id", "path", slot("relX").alias("cell_x"), slot("relY").alias("cell_y")
    ).agg(F.count("*").alias("clicks"))


def rage_clicks(events, period, site_id=None, limit=30) -> DataFrame:
    rows = _of_type(events, period, site_id, "rage_click")
    counted = rows.groupBy(
        "site_id", "path", F.coalesce(json_text("selector"), F.lit("")).alias("selector")
    ).agg(
        F.count("*").alias("incidents"),
        F.coalesce(F.sum(whole(json_number("count"))), F.lit(0)).alias("total_clicks"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    return top_per(counted, ["site_id"], desc_then("incidents", "path", "selector"), limit)


RAGE_WINDOW_MS, RAGE_CLICKS, RAGE_QUIET_MS = 1000, 3, 5000
NEVER = -(2 ** 62)  # an element that was not reported yet


def reported(times: np.ndarray, start: int, quiet_ms: int) -> list[int]:
    """Of the sorted moments when the burst condition holds, the places of those that are reported: the first
    from `start` on, then each first one at least `quiet_ms` after the last report."""
    picked, i = [], int(np.searchsorted(times, start))
    while i < len(times):
        picked.append(i)
        i = int(np.searchsorted(times, times[i] + quiet_ms))
    return picked


def bursts(
    times: np.ndarray, clicks: np.ndarray, fresh: np.ndarray, window_ms: int, min_clicks: int,
) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct moments with their numbers of clicks, `fresh` of them not seen before: the clicks of the last
    `window_ms` up to the first fresh one that makes a burst, and whether there is one."""
    upto = np.cumsum(clicks)
    first = np.searchsorted(times, times - window_ms + 1)
    inside = upto - np.where(first > 0, upto[first - 1], 0)
    return np.maximum(min_clicks, inside - fresh + 1), inside >= min_clicks


def _quiet_after(quiet_ms: int):
    """Of a block's moments, what it does to the time until which the block before it is quiet: steps (from, to).
    Any time up to `from`, and after the step before, becomes `to`; a time after all moments stays. Only the steps
    that a block before can reach are kept, so their number is bounded by the quiet time, not by the clicks."""
    @F.pandas_udf("struct<since: array<bigint>, until: array<bigint>>")
    def steps(starts: pd.Series, moments: pd.Series) -> pd.DataFrame:
        since, until = [], []
        for start, times in zip(starts, moments):
            following = np.searchsorted(times, times + quiet_ms)
            last = times + quiet_ms
            for i in range(len(times) - 1, -1, -1):
                if following[i] < len(times):
                    last[i] = last[following[i]]
            reach = np.searchsorted(times, start + quiet_ms) + 1
            since.append(times[:reach])
            until.append(last[:reach])
        return pd.DataFrame({"since": since, "until": until})

    return steps


def _quiet_before():
    """The time until which an element is quiet as each of its blocks begins, from the blocks' steps in order."""
    @F.pandas_udf("array<bigint>")
    def follow(since: pd.Series, until: pd.Series) -> pd.Series:
        found = []
        for froms, tos in zip(since, until):
            quiet, each = NEVER, []
            for at, to in zip(froms, tos):
                each.append(quiet)
                i = int(np.searchsorted(at, quiet))
                quiet = int(to[i]) if i < len(at) else quiet
            found.append(each)
        return pd.Series(found)

    return follow


def _picks(quiet_ms: int):
    @F.pandas_udf("array<int>")
    def picks(moments: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([reported(times, start, quiet_ms) for times, start in zip(moments, starts)])

    return picks


def detect_rage_clicks(
    clicks: DataFrame, window_ms=RAGE_WINDOW_MS, min_clicks=RAGE_CLICKS, quiet_ms=RAGE_QUIET_MS, block_ms=3_600_000,
) -> DataFrame:
    """Rage clicks in raw clicks (site_id, user_id, session_id, path, selector, id, timestamp).

    A click qualifies when it is at least the third on its element within one second. Clicks are
    counted per element and minute, with the last second of the minute before repeated as a lead-in,
    so a hot element is spread over its minutes. Which of the qualifying moments are reported depends on
    the report before, in a run without pause back to its first click. So each block of an hour is turned
    into what it does to the quiet time it begins with; these short steps, one row a block, are followed in
    order per element, and then every block reports with the quiet time it really begins with. A run of
    any length is spread over its blocks; a block holds its distinct milliseconds at most."""
    if not 0 < quiet_ms <= block_ms:
        raise ValueError("a block is at least as long as the quiet time")
    keys = ["site_id", "user_id", "session_id", "path", "selector"]
    at = F.unix_millis(F.col("timestamp").cast("timestamp"))
    per_moment = clicks.groupBy(*keys, at.alias("_ms")).agg(F.count("*").alias("_clicks"))
    minute = F.floor(F.col("_ms") / 60_000)
    spread = per_moment.withColumn(
        "_minute",
        F.explode(F.array_distinct(F.array(minute, F.floor((F.col("_ms") + window_ms - 1) / 60_000)))),
    ).withColumn("_lead_in", F.col("_minute") != minute)
    last_second = Window.partitionBy(*keys, "_minute").orderBy("_ms").rangeBetween(-(window_ms - 1), 0)
    burst = (
        spread.withColumn("count", F.sum("_clicks").over(last_second))
        .filter(~F.col("_lead_in") & (F.col("count") >= min_clicks))
    )
    # With several clicks in one millisecond the report is sent by the first that completes three.
    completed = F.greatest(F.lit(min_clicks), F.col("count") - F.col("_clicks") + 1)
    blocks = burst.groupBy(*keys, (F.floor(F.col("_ms") / block_ms) * block_ms).alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_ms", completed.alias("count")))).alias("_moments"))
    steps = blocks.withColumn("_s", _quiet_after(quiet_ms)("_block", "_moments._ms")).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_block", "_s.since", "_s.until"))).alias("_b"))
    begins = steps.withColumn("_quiet", _quiet_before()("_b.since", "_b.until")).select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.explode(F.arrays_zip(F.col("_b._block").alias("block"), F.col("_quiet").alias("quiet"))).alias("_q"))
    on = F.col("_block") == F.col("_q.block")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    found = blocks.join(begins, on).withColumn("_i", F.explode(_picks(quiet_ms)("_moments._ms", "_q.quiet")))
    return found.select(*keys, F.col("_moments")[F.col("_i")].alias("_m")).select(
        *keys, F.timestamp_millis("_m._ms").alias("timestamp"), "_m.count")


def time_on_page(events, period, site_id=None, limit=20) -> DataFrame:
    seconds = json_number("seconds")
    rows = _of_type(events, period, site_id, "time_on_page").filter(
        (whole(seconds) > 0) & (whole(seconds) < 3600))
    n, v = F.col("n"), F.col("v")
    pages = with_percentile(rows, ["site_id", "path"], seconds, 0.5, [
        round_half_up(F.sum(v * n) / F.sum(n), 1).alias("avg_time"),
        F.min(whole(v)).alias("min_time"), F.max(whole(v)).alias("max_time"),
        F.sum("n").alias("samples"),
    ]).withColumn("median_time", round_interpolated(F.col("percentile"), 1)).drop("percentile")
    return top_per(pages, ["site_id"], desc_then("samples", "path"), limit)


def engagement_summary(events, period, site_id=None) -> DataFrame:
    kinds = ["scroll_depth", "time_on_page", "rage_click", "heatmap_click"]
    rows = period_rows(events, period, site_id).filter(F.col("type").isin(kinds))
    kind, depth, seconds = F.col("type"), json_number("depth"), json_number("seconds")
    read = (kind == "time_on_page") & (whole(seconds) > 0) & (whole(seconds) < 3600)
    return rows.groupBy("site_id").agg(
        F.coalesce(mean_1dp(F.when(kind == "scroll_depth", depth)), F.lit(0.0)).alias("avg_scroll_depth"),
        F.coalesce(mean_1dp(F.when(read, seconds)), F.lit(0.0)).alias("avg_time_on_page"),
        F.count_if(kind == "rage_click").alias("total_rage_clicks"),
        F.count_if(kind == "heatmap_click").alias("total_clicks"),
    )


def site_search_terms(events, period, site_id=None, limit=30) -> DataFrame:
    rows = _of_type(events, period, site_id, "site_search")
    counted = rows.groupBy(
        "site_id", F.coalesce(json_text("query"), F.lit("")).alias("query"), F.col("path").alias("page")
    ).agg(F.count("*").alias("searches"), F.countDistinct("user_id").alias("unique_users"))
    return top_per(counted, ["site_id"], desc_then("searches", "query", "page"), limit)
