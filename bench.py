"""Headline queries over the stored events table; prints one JSON line.

The events are first written to the partitioned layout the jobs use in production (timed as
`load`), then all queries are run twice to warm up and each is measured `BENCH_RUNS` times; the
reported time is the median. `grown` is the same over the events table ten times, with visitors of their own;
`once` has ingest and live jobs, run once. `BENCH_SF_DIR`, `BENCH_CPUS`, `BENCH_RUNS` and `BENCH_COPIES` set the
scale."""

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from footfall import catalog  # noqa: E402
from footfall.plans import tables  # noqa: E402
from footfall.plans.session_table import read_sessions, write_sessions  # noqa: E402
from footfall.sources import fixture  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
COPIES = int(os.environ.get("BENCH_COPIES", "10"))
ANALYTICS = [
    "A01_traffic_over_time", "A05_top_pages", "A09_traffic_sources", "A11_countries",
    "A17_funnel", "A20_utm_campaigns", "A22_user_flow", "A23_traffic_alerts", "A28_retention_daily",
    "A29_cohorts", "A30_goal_conversions", "A36_revenue_summary", "A45_heatmap_points",
    "A51_time_on_page", "A53_web_vitals_by_page",
]
SESSIONS = ["A13_sessions_by_city", "A38_entry_pages"]
FIRST = ["A34_new_vs_returning"]
BOTH = ["A15_kpi_summary"]
ONCE = ["I01_ingest_clean", "S01_stream_ingest", "S06_stream_rollup"]
OTHER = ["R03_rank_change", "R05_search_alerts", "R09_weekly_change"]


def session() -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("footfall-bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", f"{scratch}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, copies: int) -> str:
    path = tables.scratch_path(spark, "events")
    events = fixture.web_events(spark, SF_DIR)
    if copies > 1:
        suffix = F.concat(F.lit("-"), F.col("_copy").cast("string"))
        events = events.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumns(
            {c: F.concat(c, suffix) for c in ("id", "user_id", "session_id")}).drop("_copy")
    tables.write_events(events, path, mode="overwrite")
    return path


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def over_tables(spark: SparkSession, path: str) -> tuple[dict, float]:
    """The queries of the stored events and sessions, and the time to write the sessions."""
    events, sessions_path = tables.read_events(spark, path), tables.scratch_path(spark, "sessions")
    took = seconds(lambda: write_sessions(catalog.sessions_of(events), sessions_path))
    visits = read_sessions(spark, sessions_path)
    over_events, over_sessions, over_both = catalog._over_events(), catalog._over_sessions(), catalog._over_both()
    over_first, first = catalog._over_first(), catalog.stored_first(visits)
    names = [n for n in over_events if n.startswith("Q")] + ANALYTICS
    jobs = {n: (lambda n=n: over_events[n](spark, events).collect()) for n in names}
    jobs |= {n: (lambda n=n: over_sessions[n](visits).collect()) for n in SESSIONS}
    jobs |= {n: (lambda n=n: over_first[n](visits, first).collect()) for n in FIRST}
    jobs |= {n: (lambda n=n: over_both[n](spark, events, visits).collect()) for n in BOTH}
    return jobs, took


def measure(jobs: dict, warm: int = 2) -> dict[str, float]:
    for _ in range(warm):
        for job in jobs.values():
            job()
    return {n: round(statistics.median(seconds(job) for _ in range(RUNS)), 4) for n, job in jobs.items()}


def main() -> None:
    spark = session()
    loaded = {}
    load(spark, 1)  # the first write of a fresh session mostly measures its start
    load_time = seconds(lambda: loaded.update(path=load(spark, 1)))
    jobs, sessions_time = over_tables(spark, loaded["path"])
    queries = catalog.catalog()
    jobs |= {n: (lambda n=n: queries[n](spark, SF_DIR).write.format("noop").mode("overwrite").save()) for n in OTHER}
    times = measure(jobs)
    once = {n: round(seconds(lambda n=n: queries[n](spark, SF_DIR).write.format("noop").mode("overwrite").save()), 3)
            for n in ONCE}
    grown_load = seconds(lambda: loaded.update(grown=load(spark, COPIES)))
    grown_jobs, grown_sessions = over_tables(spark, loaded["grown"])
    grown = measure(grown_jobs, warm=1)
    same = sum(times[n] for n in grown)
    print(json.dumps({
        "metric": "total of median query times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF_DIR, "rows": tables.read_events(spark, loaded["path"]).count(),
        "suite_q01_q12": round(sum(t for n, t in times.items() if n.startswith("Q")), 3),
        "load": round(load_time, 3), "load_sessions": round(sessions_time, 3), "once": once,
        "grown": {"copies": COPIES, "queries": grown, "value": round(sum(grown.values()), 3),
                  "suite_q01_q12": round(sum(t for n, t in grown.items() if n.startswith("Q")), 3),
                  "load": round(grown_load, 3), "load_sessions": round(grown_sessions, 3),
                  "times_the_small": round(sum(grown.values()) / same, 2)},
        "cpus": int(CPUS), "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
