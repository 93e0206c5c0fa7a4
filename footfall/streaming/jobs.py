"""Live jobs on Structured Streaming. Each takes a streaming DataFrame and a checkpoint folder; a
restarted job continues where it stopped. Sinks are idempotent: a repeated batch changes nothing."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from footfall.functions.classify import filled
from footfall.functions.numbers import top_per, union_all
from footfall.operators.engagement import NEVER, RAGE_CLICKS, RAGE_QUIET_MS, RAGE_WINDOW_MS, bursts, reported
from footfall.operators.ingest import ingest_clean, opt_out_filter
from footfall.operators.traffic import is_view, traffic_alerts
from footfall.plans.first_seen import merge_first
from footfall.plans.keyed import BUCKETS
from footfall.plans.rollup import daily_rollup
from footfall.plans.session_table import merge_sessions, read_sessions
from footfall.plans.tables import (
    HOT_PARTITIONS, append_new, compact_days, drop_path, latest_per_key, overwrite_touched, with_event_date,
)

PERIOD = {"availableNow": True}


@contextmanager
def held(batch: DataFrame) -> Iterator[DataFrame]:
    """The rows of a batch, made once and kept on the executors (in memory and on disk) until its work is done. Each
    action on a batch makes all its columns anew."""
    rows = batch.persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def _start(df: DataFrame, mode: str, checkpoint: str, trigger: dict | None):
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        **(trigger or PERIOD))


def clean_stream(raw: DataFrame) -> DataFrame:
    """Validated, sanitised events; opted-out visitors dropped where the headers are present."""
    kept = opt_out_filter(raw) if {"dnt", "gpc"} <= set(raw.columns) else raw
    return ingest_clean(kept)


def stream_ingest(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append events to the table by day, each file exactly once. A batch is brought together by day first, so that
    a day gets as many files as its rows need, not one from every task."""
    return _start(with_event_date(events).hint("rebalance", *HOT_PARTITIONS), "append", checkpoint, trigger).format("parquet").option(
        "compression", "zstd").partitionBy(*HOT_PARTITIONS).start(path)


def dedupe(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops repeated deliveries of an event that arrive within `delay` of each other."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["site_id", "id"])


def late_events(events: DataFrame, delay: str, received: str = "received_at") -> DataFrame:
    """Events that reached us later than `delay` after they happened: the side table of what a
    watermark of that length may drop."""
    return events.filter(F.col("timestamp") < F.col(received) - F.expr(f"INTERVAL {delay}"))


def split_late(path: str, late_path: str, delay: str, received: str = "received_at") -> Callable[[DataFrame, int], None]:
    """Feeds two tables from one stream: events in time, and those that came later than `delay`. Both take each
    event once, whatever part of a batch was written before it is repeated."""
    def work(batch: DataFrame, n: int) -> None:
        with held(batch) as rows:
            in_time = rows.filter(~F.coalesce(F.col("timestamp") < F.col(received) - F.expr(f"INTERVAL {delay}"), F.lit(False)))
            append_new(rows.sparkSession, in_time, path)
            append_new(rows.sparkSession, late_events(rows, delay, received), late_path)

    return work


def sessions_live(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """One row per closed session: a session closes when the watermark passes its last event by
    `gap`. Append mode."""
    at = [F.col("timestamp").alias("ts"), F.col("id")]
    view = F.when(is_view(), F.struct(*at, "path"))
    grouped = events.withWatermark("timestamp", delay).groupBy(
        "site_id", "user_id", F.session_window("timestamp", gap).alias("w")
    ).agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"),
        F.count("*").alias("events"), F.count_if(is_view()).alias("pageviews"),
        F.min(view).alias("_in"), F.max(view).alias("_out"))
    return grouped.select(
        "site_id", "user_id", "started_at", "ended_at",
        F.timestamp_diff("SECOND", "started_at", "ended_at").alias("duration"), "events", "pageviews",
        F.col("_in.path").alias("entry_page"), F.col("_out.path").alias("exit_page"),
        (F.col("pageviews") <= 1).alias("is_bounce"))


def common_step(length: str, slide: str) -> str:
    """The longest step of which both the length and the slide of a window are multiples."""
    plain = [re.sub(r"(?i)\bweeks?\b", "W", re.sub(r"(?i)^\s*interval\s", "", span)) for span in (length, slide)]
    nanos = [pd.Timedelta(span).value for span in plain]
    return f"{math.gcd(*nanos) // 1000} microseconds"


def active_visitors(
    events: DataFrame, delay: str = "10 minutes", length="5 minutes", slide="1 minute", exact: bool = False,
) -> DataFrame:
    """Visitors and events of sliding windows, in total and per page, device and country. By default for
    update mode, with approximate visitors and state of one sketch a row. `exact` is for append mode: each
    window once, when it is closed. Open steps are kept as one row for each visitor, page, device and country; only
    closed ones are spread over their windows, so an event that comes after its own step is closed is left out."""
    labelled = events.withWatermark("timestamp", delay).select(
        "site_id", "user_id", "timestamp", F.lit("active").alias("total"), F.when(is_view(), F.col("path")).alias("page"),
        filled("device", "Desktop").alias("device"), filled("country", "Unknown").alias("country"))
    marks = ["total", "page", "device", "country"]
    if exact:
        steps = labelled.groupBy(F.window("timestamp", common_step(length, slide)).alias("step"), "site_id", "user_id", *marks).agg(
            F.count("*").alias("n"))
        visits = steps.groupBy(F.window("step", length, slide).alias("w"), "site_id", "user_id").agg(
            F.collect_list(F.struct(*marks, "n")).alias("parts"))
        # each label of the visitor's parts with the events, then each distinct one with the visitor
        lists = visits.select("w", "site_id", "user_id", F.col("parts.n").alias("counts"), F.explode(F.array(*[
            F.struct(F.lit(m).alias("dimension"), F.col(f"parts.{m}").alias("labels")) for m in marks])).alias("c"))
        each = lists.select("w", "site_id", "user_id", "counts", "c.dimension", F.posexplode(
            F.concat("c.labels", F.array_distinct("c.labels"))).alias("i", "label")).filter("label IS NOT NULL")
        counted = each.groupBy("w", "site_id", "dimension", "label").agg(
            F.count_if((F.col("i") >= F.size("counts")) & F.col("user_id").isNotNull()).alias("visitors"),
            F.sum(F.coalesce(F.get("counts", F.col("i")), F.lit(0))).alias("events"))
    else:
        cells = F.array(*[F.struct(F.lit(m).alias("dimension"), F.col(m).alias("label")) for m in marks])
        long = labelled.select("site_id", "user_id", "timestamp", F.explode(cells).alias("c")).filter("c.label IS NOT NULL")
        counted = long.groupBy(F.window("timestamp", length, slide).alias("w"), "site_id", "c.dimension", "c.label").agg(
            F.approx_count_distinct("user_id").alias("visitors"), F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), "site_id", "dimension", "label", "visitors", "events")


def time_buckets(events: DataFrame, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events and page views of tumbling windows per site. Update mode with `latest_rows` keeps all
    windows in a table; append mode gives each once it is closed."""
    return events.withWatermark("timestamp", delay).groupBy(
        F.window("timestamp", length).alias("w"), "site_id"
    ).agg(F.count("*").alias("events"), F.count_if(is_view()).alias("pageviews")).select(
        F.col("w.start").alias("bucket"), "site_id", "events", "pageviews")


def for_each_batch(
    events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None,
    mode: str = "append",
) -> StreamingQuery:
    return _start(events, mode, checkpoint, trigger).foreachBatch(work).start()


def _run(path: str, level: int, last: int) -> str:
    return f"{path}/level={level}/run={last}"


def latest_rows(path: str, keys: list[str], fan: int = 16) -> Callable[[DataFrame, int], None]:
    """The rows of each update, kept in levels: a batch is a run of level 0, and `fan` runs of a level become one of
    the next, with the newest row of a key. The number of runs grows with the logarithm of the batches. `fan` is the
    same for every run of the job.

    A repeated batch replaces its own runs. What went into a run stays until the next one of its level is written:
    so a job that failed in the middle finds all it merges, and a reader that has listed the old files can go on."""
    def work(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch", F.lit(n).cast("bigint"))
        rows.write.mode("overwrite").parquet(_run(path, 0, n))
        level = 1
        while (n + 1) % fan ** level == 0:
            step = fan ** (level - 1)
            parts = [spark.read.schema(rows.schema).parquet(_run(path, level - 1, n - i * step)) for i in range(fan)]
            latest_per_key(union_all(parts), keys, ["batch"]).write.mode("overwrite").parquet(_run(path, level, n))
            for i in range(fan, 2 * fan):
                drop_path(spark, _run(path, level - 1, n - i * step))
            level += 1

    return work


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key that `latest_rows` wrote. A row that is in two runs is the same in both."""
    return latest_per_key(spark.read.parquet(path).drop("level", "run"), keys, ["batch"]).drop("batch")


TAIL_KEPT = 3


def event_tail(path: str, limit: int = 50) -> Callable[[DataFrame, int], None]:
    """Keeps the latest events per site under `path/batch=<n>`. Batch n is built from batch n-1 and
    the new rows, so repeating it gives the same rows. Of older batches, which no run needs, the last
    few stay for readers."""
    def work(batch: DataFrame, n: int) -> None:
        rows = batch
        if n > 0:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={n - 1}"))
        order = [F.col("timestamp").desc(), F.col("id").desc()]
        top_per(rows, ["site_id"], order, limit).write.mode("overwrite").parquet(f"{path}/batch={n}")
        drop_path(batch.sparkSession, f"{path}/batch={n - TAIL_KEPT}")

    return work


def ingest_compacted(path: str, every: int = 24, target_bytes: int = 256 << 20) -> Callable[[DataFrame, int], None]:
    """Appends the events of each batch that the table does not have, sorted by site and time, and before every
    `every`th batch packs the small files of its days. Packing is part of the batch: nothing else writes meanwhile, and
    a batch that failed is repeated as a whole, from the packed rows that it had set aside."""
    def work(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        drop_path(spark, f"{path}-packed/batch={n - 1}")  # of a batch that is done
        if n > 0 and n % every == 0:
            compact_days(spark, path, batch.schema, target_bytes, f"{path}-packed/batch={n}")
        append_new(spark, batch, path)

    return work


def rollup_updates(
    events_path: str, rollup_path: str, sessions_path: str, alerts_path: str | None = None, first_path: str | None = None,
    buckets: int = BUCKETS,
) -> Callable[[DataFrame, int], None]:
    """After each batch of the events table, bring the stored sessions up to date, recompute the days the
    batch touched, late events included, with `alerts_path` the traffic alerts of the sites it touched, and with
    `first_path` the first sessions of its visitors. `buckets`: of the tables kept by key; the same for every run.
    Touched are the days of the batch's events and those on which its sessions start or started before it.
    What the batch replaces in the sessions is kept under `<sessions_path>-staged/batch=<n>` until the next batch."""
    def update(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        events = read_stored(spark, events_path)
        staged = f"{sessions_path}-staged/batch={n}"
        starts = merge_sessions(batch, events, sessions_path, staged, buckets)
        if first_path is not None:
            merge_first(spark, spark.read.parquet(f"{staged}/fresh"), first_path, buckets, f"{staged}/first")
        days = batch.select("site_id", F.to_date("timestamp").alias("date")).union(starts).distinct()
        dates = [r[0] for r in days.select("date").distinct().collect()]
        visits = read_sessions(spark, sessions_path).filter(F.col("session_date").isin(dates))
        fresh = daily_rollup(events.filter(F.col("event_date").isin(dates)), visits, days)
        overwrite_touched(fresh.withColumn("event_date", F.col("date")), rollup_path, ["event_date", "site_id"])
        if alerts_path is not None:
            sites = batch.select("site_id").distinct()
            daily = spark.read.parquet(rollup_path).drop("event_date").join(sites, "site_id", "left_semi")
            alerts = traffic_alerts(None, None, daily=daily)
            # A site without alerts still replaces its partition, so withdrawn alerts disappear.
            replaced = sites.join(alerts, "site_id", "left")
            overwrite_touched(replaced, alerts_path, ["site_id"])

    def work(batch: DataFrame, n: int) -> None:
        drop_path(batch.sparkSession, f"{sessions_path}-staged/batch={n - 1}")  # of a batch that is done
        with held(batch.select("site_id", "user_id", "session_id", "timestamp")) as rows:
            if not rows.isEmpty():
                update(rows, n)

    return work


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The whole events table at `path`, with the partition columns in their own types."""
    return spark.read.parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("type IS NOT NULL")


_CLICK_KEY = ["site_id", "user_id", "session_id", "path", "selector"]


def rage_clicks_live(clicks: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Rage clicks as they happen: the third click on one element within a second, then five quiet
    seconds, by the same steps as the batch job. State per element is the last second of click times and the
    end of its quiet time; it is dropped once the watermark has passed that. A late click counts the clicks
    of the second before it that the state still has."""
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, quiet_until = (state.get[0], state.get[1]) if state.exists else ([], NEVER)
        new = np.concatenate([b["ms"].to_numpy() for b in batches])
        times, of, clicks = np.unique(np.concatenate([recent, new]).astype("int64"), return_inverse=True, return_counts=True)
        fresh = np.bincount(of[len(recent):], minlength=len(times))
        # clicks of the state that fall on the same millisecond as new ones came before them
        counts, holds = bursts(times, clicks, fresh, RAGE_WINDOW_MS, RAGE_CLICKS)
        places = np.flatnonzero(holds & (fresh > 0))
        found = []
        for i in places[reported(times[places], quiet_until, RAGE_QUIET_MS)].tolist():
            quiet_until = int(times[i]) + RAGE_QUIET_MS
            found.append((*key, pd.Timestamp(times[i], unit="ms", tz="UTC"), int(counts[i])))
        last = times > times[-1] - RAGE_WINDOW_MS
        state.update((np.repeat(times[last], clicks[last]).tolist(), quiet_until))
        expiry = int(times[-1]) + RAGE_QUIET_MS + RAGE_WINDOW_MS
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=[*_CLICK_KEY, "timestamp", "count"])

    keyed = clicks.withWatermark("timestamp", delay).withColumn("ms", F.unix_millis("timestamp"))
    schema = ", ".join(f"{k} string" for k in _CLICK_KEY) + ", timestamp timestamp, count bigint"
    return keyed.groupBy(*_CLICK_KEY).applyInPandasWithState(
        update, schema, "recent array<bigint>, quiet_until bigint", "append",
        GroupStateTimeout.EventTimeTimeout)
