"""Stored tables and live jobs: repeated, late and interrupted deliveries."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions.ranges import date_range
from footfall.operators import audience, traffic
from footfall.operators.sessions import sessionise_by_id
from footfall.plans import rollup, session_table, tables
from footfall.sources import fixture, raw_fixture
from footfall.sources.synthetic import synth_events
from footfall.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    kept = fixture.web_events(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp")).cache()
    yield kept
    kept.unpersist(blocking=True)


def same(a, b):
    columns = sorted(a.columns)
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_append_twice_and_restart(spark, events, tmp_path):
    path = str(tmp_path / "events")
    early = events.filter("timestamp < '2024-01-12'")
    tables.append_new(spark, early.union(early), path)
    tables.append_new(spark, events.filter("timestamp > '2024-01-10'"), path)
    tables.append_new(spark, events, path)
    tables.append_new(spark, events.limit(0), path)
    assert same(tables.read_events(spark, path).drop("event_date"), events)


def test_partitions_prune(spark, events, tmp_path):
    path = str(tmp_path / "events")
    tables.write_events(events, path)
    stored = tables.read_events(spark, path)
    from footfall.functions.ranges import DateRange, within

    day = within(stored, DateRange(datetime(2024, 1, 5), datetime(2024, 1, 6))).filter("site_id = 'site_a'")
    plan = day._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line][0]
    assert "event_date" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    pushed = scan.split("PushedFilters")[1]
    assert "GreaterThanOrEqual(timestamp" in pushed and "EqualTo(site_id,site_a)" in pushed


def test_upsert_ignores_old_and_repeated_changes(spark):
    schema = "k int, at int, v string"
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], schema)
    new = spark.createDataFrame([(1, 4, "x"), (2, 6, "y"), (2, 6, "y"), (3, 1, "z")], schema)
    once = tables.upsert_by_key(old, new, ["k"], ["at"])
    want = [(1, 5, "a"), (2, 6, "y"), (3, 1, "z")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, tables.upsert_by_key(once, new, ["k"], ["at"]).collect())) == want


def test_retention_is_idempotent_and_not_undone(spark, events):
    policies = spark.createDataFrame(
        [("1", "site_a", 5, True, None), ("2", "site_b", None, True, None), ("3", "site_c", 30, False, None)], schemas.RETENTION_POLICIES)
    cutoffs = tables.retention_cutoffs(policies, datetime(2024, 2, 14))
    limits = {r.site_id: r.cutoff for r in cutoffs.collect()}
    assert limits == {"site_a": datetime(2024, 1, 15), "site_b": datetime(2024, 2, 14) - timedelta(days=365)}
    kept = tables.apply_retention(events, cutoffs)
    assert same(tables.apply_retention(kept, cutoffs), kept)
    redelivered = kept.union(tables.unseen(events, kept))
    assert same(tables.apply_retention(redelivered, cutoffs), kept)
    days = rollup.daily_rollup(events)
    left = tables.apply_retention(days, cutoffs, "date")
    assert left.filter("site_id = 'site_a' AND date < '2024-01-15'").count() == 0
    assert left.filter("site_id <> 'site_a'").count() == days.filter("site_id <> 'site_a'").count()


def test_archive_can_be_repeated(spark, events, tmp_path):
    cold, hot, hot2 = (str(tmp_path / n) for n in ("cold", "hot", "hot2"))
    now = datetime(2024, 2, 10)
    tables.archive_cold(events, cold, hot, now)
    tables.archive_cold(events, cold, hot2, now)
    union = tables.read_events(spark, hot2, cold)
    assert same(union.drop("event_date"), events)
    assert tables.unified_view(events) is events


def test_late_rows_join_an_archived_day(spark, events, tmp_path):
    cold, hot, hot2 = (str(tmp_path / n) for n in ("cold", "hot", "hot2"))
    now = datetime(2024, 2, 10)
    first = events.filter("timestamp < '2024-01-05'").orderBy("id").limit(1)
    late = first.withColumn("id", F.lit("late"))
    tables.archive_cold(events, cold, hot, now)
    tables.archive_cold(spark.read.parquet(hot).drop("event_date").unionByName(late), cold, hot2, now)
    assert same(tables.read_events(spark, hot2, cold).drop("event_date"), events.unionByName(late))


def test_a_run_that_failed_while_replacing_can_be_repeated(spark, events, tmp_path, monkeypatch):
    cold, hot, staged = (str(tmp_path / n) for n in ("cold", "hot", "staged"))
    tables.write_events(events.filter("timestamp < '2024-01-05'"), hot)
    tables.archive_stored(spark, hot, cold, datetime(2024, 2, 10))
    tables.write_events(events, hot)

    def lose(rows, path, partitions):
        rows.limit(0).write.mode("overwrite").parquet(path)
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(tables, "overwrite_touched", lose)
        tables.archive_stored(spark, hot, cold, datetime(2024, 2, 10), staged=staged)
    tables.archive_stored(spark, hot, cold, datetime(2024, 2, 10), staged=staged)
    assert same(tables.read_events(spark, hot, cold).drop("event_date"), events)
    assert spark.read.parquet(hot).filter("event_date < '2024-01-11'").isEmpty()


def test_retention_leaves_other_days_alone(spark, events, tmp_path):
    path = str(tmp_path / "events")
    tables.write_events(events, path)
    rows = [("1", "site_a", 30, True, None), ("2", "site_b", 30, True, None), ("3", "site_c", 30, True, None)]
    cutoffs = tables.retention_cutoffs(spark.createDataFrame(rows, schemas.RETENTION_POLICIES), datetime(2024, 2, 14, 12))
    before = {f.name for f in (tmp_path / "events" / "event_date=2024-01-20").iterdir()}
    for _ in range(2):
        tables.delete_expired(spark, path, cutoffs)
        assert same(spark.read.parquet(path).drop("event_date"), events.filter("timestamp >= '2024-01-15 12:00:00'"))
    assert not (tmp_path / "events" / "event_date=2024-01-14").exists()
    assert {f.name for f in (tmp_path / "events" / "event_date=2024-01-20").iterdir()} == before


def test_archived_events_are_not_appended_again(spark, events, tmp_path):
    cold, hot = (str(tmp_path / n) for n in ("cold", "hot"))
    tables.archive_cold(events, cold, hot, datetime(2024, 2, 10))
    tables.append_new(spark, events, hot, cold)
    assert same(tables.read_events(spark, hot, cold).drop("event_date"), events)


def test_local_folders_are_for_local_sessions(spark):
    class Far:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.scratch_path(Far, "x")


def test_tail_is_that_of_the_last_batch(spark, events, tmp_path):
    work = jobs.event_tail(str(tmp_path / "rows"), limit=5)
    parts = [events.filter("timestamp < '2024-01-10'"), events.filter("timestamp >= '2024-01-10'")]
    for n, part in enumerate(parts):
        work(part, n)
    kept = spark.read.parquet(str(tmp_path / "rows"))
    last = kept.filter(F.col("batch") == kept.agg(F.max("batch")).first()[0])
    want = events.selectExpr("id", "row_number() over (partition by site_id order by timestamp desc, id desc) as r").filter("r <= 5")
    assert {r.id for r in last.collect()} == {r.id for r in want.collect()}


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', None, "line\nbreak"), ("plain", "1", "x")], "a string, b string, c string")
    tables.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv"), header=True, schema="a string, b string, c string")
    assert same(back, df)
    tables.export_json(df, str(tmp_path / "json"))
    assert same(spark.read.schema(df.schema).json(str(tmp_path / "json")), df)


def test_rollup_of_touched_days_equals_full_rollup(spark, events, tmp_path):
    full = rollup.daily_rollup(events)
    batch = events.filter("timestamp between '2024-01-10' and '2024-01-11'")
    days = batch.select("site_id", F.to_date("timestamp").alias("date")).distinct()
    part = rollup.daily_rollup(events, days=days)
    assert same(part, full.join(days, ["site_id", "date"], "left_semi"))


def files_out_of_order(events, path):
    """Four files: a late, a middle, an early part of the events, and the middle part again."""
    day = F.dayofmonth("timestamp")
    for part in (day > 20, (day > 10) & (day <= 20), day <= 10, (day > 10) & (day <= 20)):
        events.filter(part).coalesce(1).write.mode("append").parquet(path)


def test_live_ingest_and_rollup_equal_batch(spark, events, tmp_path):
    source, stored, out = (str(tmp_path / n) for n in ("in", "events", "out"))
    files_out_of_order(events, source)

    def run(trigger=None):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.stream_ingest(jobs.dedupe(stream, "60 days"), stored, f"{out}/c1").awaitTermination()
        landed = spark.readStream.schema(spark.read.parquet(stored).schema).option("maxFilesPerTrigger", 7).parquet(stored)
        work = jobs.rollup_updates(stored, f"{out}/days", f"{out}/sessions", f"{out}/alerts")
        jobs.for_each_batch(landed, work, f"{out}/c2").awaitTermination()

    run()
    assert same(jobs.read_stored(spark, stored).drop("event_date"), events)
    want = rollup.daily_rollup(events)
    assert same(spark.read.parquet(f"{out}/days").drop("event_date"), want)
    late = events.limit(1).withColumns({"id": F.lit("late"), "timestamp": F.lit("2024-01-03 12:00:00").cast("timestamp"), "user_id": F.lit("nobody")})
    late.coalesce(1).write.mode("append").parquet(source)
    run()
    assert same(spark.read.parquet(f"{out}/days").drop("event_date"), rollup.daily_rollup(events.union(late)))


def long_sessions(events):
    """One session a visitor and week, so that sessions run over several midnights."""
    return events.withColumn("session_id", F.concat("user_id", F.lit("_"), F.weekofyear("timestamp").cast("string")))


def test_sessions_over_midnights_do_not_depend_on_batches(spark, events, tmp_path):
    rows, stored, out = long_sessions(events), str(tmp_path / "events"), str(tmp_path / "out")
    work = jobs.rollup_updates(stored, f"{out}/days", f"{out}/sessions")
    day = F.dayofmonth("timestamp")
    for n, part in enumerate((day % 3 == 2, day % 3 == 0, day % 3 == 1)):
        tables.write_events(rows.filter(part), stored)
        work(rows.filter(part), n)
    work(rows.filter(day % 3 == 1), 2)
    assert same(spark.read.parquet(f"{out}/days").drop("event_date"), rollup.daily_rollup(rows))
    kept = session_table.read_sessions(spark, f"{out}/sessions")
    assert same(kept.drop("session_date"), sessionise_by_id(rows))
    assert kept.filter("session_date <> to_date(started_at)").count() == 0


def test_a_moved_session_leaves_its_old_day_even_after_a_failure(spark, events, tmp_path, monkeypatch):
    stored, path, staged = (str(tmp_path / n) for n in ("events", "sessions", "staged"))
    one = events.filter("type = 'pageview'").orderBy("id").limit(1).withColumn("session_id", F.lit("s")).cache()
    first, early = (one.withColumns({"id": F.lit(i), "timestamp": F.lit(t).cast("timestamp")})
                    for i, t in (("b", "2024-01-20 10:00:00"), ("a", "2024-01-05 10:00:00")))

    def merge(batch, n):
        return session_table.merge_sessions(batch, jobs.read_stored(spark, stored), path, f"{staged}/{n}")

    tables.write_events(first, stored)
    merge(first, 0)
    tables.write_events(early, stored)

    def half(rows, path, partitions):
        tables.overwrite_touched(rows.filter("session_date = '2024-01-20'"), path, partitions)
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(session_table, "overwrite_touched", half)
        merge(early, 1)
    assert {str(r.date) for r in merge(early, 1).collect()} == {"2024-01-05", "2024-01-20"}
    kept = session_table.read_sessions(spark, path)
    assert same(kept.drop("session_date"), sessionise_by_id(first.union(early)))
    assert kept.first().pageviews == 2


def test_session_reports_prune_the_stored_sessions(spark, events, tmp_path):
    path = str(tmp_path / "sessions")
    session_table.write_sessions(sessionise_by_id(events), path)
    sessions, period = session_table.read_sessions(spark, path), date_range("7d", datetime(2024, 1, 31))
    reports = [traffic.bounce_rate_trend, traffic.avg_session_trend, traffic.flow_ends, audience.sessions_by_city,
               audience.session_duration_buckets, audience.bounce_by_entry_page, audience.exit_pages, audience.entry_pages]
    for report in reports:
        got = report(sessions, period)
        plan = got._jdf.queryExecution().executedPlan().toString()
        filters = re.findall(r"PartitionFilters: \[([^\]]*)", plan)
        assert filters and all("session_date" in f for f in filters), report.__name__
        assert same(got, report(sessionise_by_id(events), period))


def test_event_tail_over_batches(spark, events, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("timestamp >= '2024-01-15'", "timestamp < '2024-01-15'"):
        events.filter(part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.for_each_batch(stream, jobs.event_tail(f"{out}/rows", 5), f"{out}/state").awaitTermination()
    from footfall.functions.numbers import top_per

    want = top_per(events, ["site_id"], [F.desc("timestamp"), F.desc("id")], 5)
    assert same(spark.read.schema(events.schema).parquet(f"{out}/rows/batch=1"), want)


def test_live_rage_clicks_equal_batch(spark, tmp_path):
    from footfall.operators.engagement import detect_rage_clicks

    clicks = raw_fixture.raw_clicks(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = str(tmp_path / "clicks")
    clicks.repartitionByRange(4, "timestamp").sortWithinPartitions("timestamp").write.parquet(path)
    stream = spark.readStream.schema(clicks.schema).parquet(path)
    jobs.rage_clicks_live(stream).writeStream.format("memory").queryName("rage").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert same(spark.table("rage"), detect_rage_clicks(clicks)) and spark.table("rage").count() > 0


def test_active_visitors_are_close_to_exact(spark, events):
    live = jobs.active_visitors(events, length="1 day", slide="1 day").filter("dimension = 'total'")
    exact = events.groupBy(F.to_date("timestamp").alias("d"), "site_id").agg(F.countDistinct("user_id").alias("v"), F.count("*").alias("n"))
    pairs = live.join(exact, (F.to_date("window_start") == exact["d"]) & (live["site_id"] == exact["site_id"])).collect()
    assert pairs and all(abs(p.visitors - p.v) <= max(1, 0.1 * p.v) and p.events == p.n for p in pairs)


def test_late_events(spark, events):
    received = events.withColumn("received_at", F.col("timestamp") + F.expr("INTERVAL 2 HOURS"))
    assert jobs.late_events(received, "1 HOUR").count() == events.count()
    assert jobs.late_events(received, "3 HOURS").count() == 0


def test_synthetic_events_are_repeatable_and_skewed(spark):
    a, b = synth_events(spark, 20_000, 7, 3), synth_events(spark, 20_000, 7, 5)
    assert same(a, b) and not same(a, synth_events(spark, 20_000, 8))
    sites = {r.site_id: r["count"] / 20_000 for r in a.groupBy("site_id").count().collect()}
    assert 0.66 < sites["bench_site_a"] < 0.74 and sorted(a.columns) == sorted(schemas.EVENTS.names)
    first, last = a.agg(F.min("timestamp"), F.max("timestamp")).first()
    assert first >= datetime(2025, 10, 3) and last < datetime(2026, 1, 2)


def folders(path, depth):
    return sorted(str(p.relative_to(path)) for p in path.glob("/".join(["*"] * depth)) if p.is_dir())


def test_latest_rows_stay_in_few_runs(spark, tmp_path):
    path, keys = tmp_path / "rows", ["k"]
    work, want = jobs.latest_rows(str(path), keys, fan=3), {}
    for n in range(20):
        rows = [(k, n * 100 + k) for k in range(n % 4, n + 1, 3)]  # empty batches too
        want |= dict(rows)
        batch = spark.createDataFrame(rows, "k int, v int").coalesce(1)
        work(batch, n)
        if n in (8, 17):  # a batch that merged is repeated
            work(batch, n)
    assert {r.k: r.v for r in jobs.read_latest(spark, str(path), keys).collect()} == want
    runs = folders(path, 2)
    assert len(runs) <= 2 * 3 * 3 and "level=2/run=17" in runs and "level=0/run=0" not in runs


def test_a_merge_that_failed_is_repeated(spark, tmp_path):
    path, keys = tmp_path / "rows", ["k"]
    work = jobs.latest_rows(str(path), keys, fan=2)
    batches = [spark.createDataFrame([(n % 2, n)], "k int, v int").coalesce(1) for n in range(4)]
    for n, batch in enumerate(batches):
        work(batch, n)
    before = jobs.read_latest(spark, str(path), keys).collect()
    tables.drop_path(spark, str(path / "level=2"))  # as if the last merge had not been written
    work(batches[3], 3)
    assert sorted(jobs.read_latest(spark, str(path), keys).collect()) == sorted(before) and (path / "level=2/run=3").exists()


def test_live_files_are_packed_between_batches(spark, events, tmp_path):
    path = str(tmp_path / "events")
    parts = [events.filter(F.pmod(F.xxhash64("id"), F.lit(6)) == i) for i in range(6)]
    work = jobs.ingest_compacted(path, every=5)
    for n in range(5):
        work(parts[n], n)
    files = lambda: {d: len(list((tmp_path / "events" / d).glob("*.parquet"))) for d in folders(tmp_path / "events", 1)}
    crowded = files()
    assert min(crowded.values()) >= 3
    work(parts[5], 5)
    assert max(files().values()) <= 2  # one of the packed rows, one of the batch
    kept = tables.stored_at(spark, path, tables.with_event_date(events).schema)
    assert same(kept.select(events.columns), events)
    # the same batch again, after a failure that had lost a day half way
    tables.drop_path(spark, f"{path}/{sorted(crowded)[0]}")
    work(parts[5], 5)
    kept = tables.stored_at(spark, path, tables.with_event_date(events).schema)
    assert same(kept.select(events.columns), events)
    # sorted by site: a file's rows change site at most as often as it has sites
    one = spark.read.parquet(str(next((tmp_path / "events" / sorted(crowded)[-1]).glob("*.parquet")))).select("site_id").collect()
    sites = [r[0] for r in one]
    assert sum(a != b for a, b in zip(sites, sites[1:])) == len(set(sites)) - 1
    work(parts[0], 6)
    assert not (tmp_path / "events-packed/batch=5").exists()


def test_event_tail_keeps_few_folders(spark, events, tmp_path):
    path = tmp_path / "tail"
    work = jobs.event_tail(str(path), limit=2)
    for n in range(6):
        work(events.limit(20), n)
    assert folders(path, 1) == [f"batch={n}" for n in (3, 4, 5)]


def test_exact_visitors_keep_open_steps_not_windows(spark, tmp_path):
    """One state row for each event at most before its step is closed, and the windows of a plain count."""
    at = lambda i: datetime(2024, 1, 1, 10) + timedelta(seconds=47 * i)
    rows = [(f"u{i % 3}" if i % 7 else None, at(i), "pageview" if i % 4 else "click", f"/p{i % 2}" if i % 5 else None,
             ["Mobile", "", None][i % 3], "DE" if i % 6 else None) for i in range(60)] * 2
    frame = spark.createDataFrame(rows, "user_id string, timestamp timestamp, type string, path string, device string, country string")
    frame.withColumn("site_id", F.lit("s")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    live = jobs.active_visitors(spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in")), exact=True)
    query = live.writeStream.format("memory").queryName("exact_visitors").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    first = query.recentProgress[0]
    assert sum(s.numRowsTotal for s in first.stateOperators) <= 60
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("label")) for n, c in (
        ("total", F.lit("active")), ("page", F.when(F.col("type") == "pageview", F.col("path"))),
        ("device", F.coalesce(F.nullif("device", F.lit("")), F.lit("Desktop"))), ("country", F.coalesce("country", F.lit("Unknown"))))]))
    plain = stored.withColumn("c", cells).filter("c.label IS NOT NULL").groupBy(
        F.window("timestamp", "5 minutes", "1 minute").alias("w"), "site_id", "c.dimension", "c.label").agg(
        F.countDistinct("user_id").alias("visitors"), F.count("*").alias("events"))
    last = at(59) - timedelta(minutes=15)
    want = plain.filter(F.col("w.start") <= F.lit(last)).select(F.col("w.start").alias("window_start"), "site_id", "dimension", "label", "visitors", "events")
    assert same(spark.table("exact_visitors"), want) and want.count() > 0
    assert jobs.common_step("5 minutes", "2 minutes") == "60000000 microseconds"
    assert jobs.common_step("1 week", "interval 1 day") == "86400000000 microseconds"


def test_live_ingest_writes_a_day_once(spark, events, tmp_path):
    """A batch read by many tasks gives a small day one file, not one from every task."""
    source = str(tmp_path / "in")
    events.repartition(6).write.parquet(source)
    live = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    jobs.stream_ingest(live, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert len(out.inputFiles()) == out.select("event_date").distinct().count()
    assert same(out.drop("event_date"), spark.read.parquet(source))


def test_new_rows_are_appended_without_grouping(spark, events, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    kept, calls = tables.first_per_key, []
    monkeypatch.setattr(tables, "first_per_key", lambda *a: calls.append(1) or kept(*a))
    once = kept(events, ["site_id", "id"]).filter("site_id IS NOT NULL AND id IS NOT NULL")
    early = once.filter("timestamp < '2024-01-15'")
    tables.append_new(spark, early, path)
    tables.append_new(spark, early, path)
    assert not calls
    tables.append_new(spark, once.union(once), path)
    assert calls and same(spark.read.parquet(path).drop("event_date"), once)


def test_a_late_split_makes_its_batch_once(spark, events, tmp_path):
    made = spark.sparkContext.accumulator(0)
    source = events.withColumn("received_at", F.col("timestamp") + F.expr("INTERVAL 2 DAYS"))
    count = F.udf(lambda x: made.add(1) or x, "string").asNondeterministic()
    batch = spark.createDataFrame(source.limit(50).collect(), source.schema).withColumn("path", count("path"))
    jobs.split_late(str(tmp_path / "main"), str(tmp_path / "late"), "1 DAY")(batch, 0)
    assert made.value == 50 and spark.read.parquet(str(tmp_path / "late")).count() == 50
