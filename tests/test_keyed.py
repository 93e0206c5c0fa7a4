"""Tables kept by key: what a batch reads, repeated and interrupted batches, first sessions, as-of joins, late events."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.functions.ordered import asof_join
from footfall.functions.ranges import DateRange
from footfall.operators.sessions import mark_returning, sessionise_by_id
from footfall.plans import first_seen, keyed, session_table, tables
from footfall.sources import fixture
from footfall.streaming import jobs

SF = "/root/testdata/sf0.001"
SCHEMA = "k string, at int, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserts_keep_what_they_do_not_touch(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(f"k{i}", 1, "old") for i in range(60)] + [(None, 1, "old")], SCHEMA)
    second = spark.createDataFrame([("k1", 2, "new"), ("k2", 0, "late"), ("x", 1, "new"), (None, 3, "new")], SCHEMA)
    for batch in (first, second, second, first.limit(0), first):
        keyed.upsert_stored(spark, batch, path, ["k"], ["at"], buckets=16)
    want = {(f"k{i}", 1, "old") for i in range(60)} - {("k1", 1, "old")} | {("k1", 2, "new"), ("x", 1, "new"), (None, 3, "new")}
    assert set(rows(keyed.read_keyed(spark, path, first.schema))) == want
    assert keyed.read_keyed(spark, str(tmp_path / "none"), first.schema).count() == 0


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    every = spark.range(5000).selectExpr("cast(id as string) AS k", "1 AS at", "'x' AS v")
    keyed.upsert_stored(spark, every, path, ["k"], ["at"], buckets=32)
    few = every.filter("k IN ('7', '8')")
    read = keyed.read_buckets(spark, path, every.schema, few, ["k"], 32)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and read.select("bucket").distinct().count() <= 2
    assert read.count() < 5000 / 8


def test_an_interrupted_upsert_is_finished_by_its_repetition(spark, tmp_path, monkeypatch):
    path, staged = str(tmp_path / "t"), str(tmp_path / "staged")
    keyed.upsert_stored(spark, spark.createDataFrame([(f"k{i}", 1, "old") for i in range(40)], SCHEMA), path, ["k"], ["at"], buckets=4)
    change = spark.createDataFrame([(f"k{i}", 2, "new") for i in range(40)], SCHEMA)
    whole = tables.overwrite_touched

    def half(df, path, partitions):
        whole(df.filter("bucket < 2"), path, partitions)
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(tables, "overwrite_touched", half)
        keyed.upsert_stored(spark, change, path, ["k"], ["at"], 4, staged)
    keyed.upsert_stored(spark, change, path, ["k"], ["at"], 4, staged)
    assert rows(keyed.read_keyed(spark, path, change.schema)) == rows(change)


def test_first_sessions_in_any_order(spark, tmp_path):
    sessions = sessionise_by_id(fixture.web_events(spark, SF)).withColumn("user_id", F.when(F.col("user_id") != "u_3", F.col("user_id")))
    path, part = str(tmp_path / "first"), F.pmod(F.xxhash64("id"), F.lit(3))
    for n in (2, 0, 1, 1):
        first_seen.merge_first(spark, sessions.filter(part == n), path, buckets=4)
    first = first_seen.read_first(spark, path, sessions)
    assert rows(first) == rows(first_seen.first_sessions(sessions))
    period = DateRange(datetime(2024, 1, 10), datetime(2024, 1, 20, 23, 59, 59))
    got = first_seen.mark_by_first(sessions, first, period)
    kept = sessions.filter("user_id IS NOT NULL")
    want = mark_returning(kept).filter(F.col("started_at").between(F.lit("2024-01-10"), F.lit("2024-01-20 23:59:59")))
    columns = ["site_id", "id", "user_id", "is_returning"]
    assert rows(got.filter("user_id IS NOT NULL").select(columns)) == rows(want.select(columns))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(timestamp,", plan)


def test_old_sessions_are_found_in_the_buckets_of_a_batch(spark, tmp_path):
    events = fixture.web_events(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path, stored = str(tmp_path / "sessions"), str(tmp_path / "events")
    tables.write_events(events, stored)
    session_table.write_sessions(sessionise_by_id(events), path)
    batch = events.filter("user_id = 'u_5'").limit(3)
    session_table.merge_sessions(batch, jobs.read_stored(spark, stored), path, str(tmp_path / "staged"), buckets=64)
    spans = session_table.stored_spans(spark, path, session_table.session_keys(batch), buckets=64)
    plan = spans._jdf.queryExecution().executedPlan().toString()
    assert "sessions-index" in plan and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert not re.search(r"/sessions\]", plan)
    assert rows(spans.select("id")) == rows(batch.select("session_id").distinct())
    kept = session_table.read_sessions(spark, path).drop("session_date")
    assert rows(kept) == rows(sessionise_by_id(events).select(kept.columns))


@pytest.mark.parametrize("chunk", ["day", "month"])
def test_asof_join_is_the_newest_before(spark, chunk):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    at = lambda: None if rng.random() < 0.05 else start + timedelta(hours=rng.randrange(24 * 70))
    key = lambda: rng.choice(["hot", "hot", "hot", "a", None])
    left = [(i, key(), at()) for i in range(200)]
    right = [(key(), at(), n, f"v{n}") for n in range(60)]
    got = asof_join(spark.createDataFrame(left, "i int, key string, timestamp timestamp"),
                    spark.createDataFrame(right, "key string, seen timestamp, n int, v string"), ["key"], {"value": "v", "seen_at": "seen"},
                    right_time="seen", right_order=["n"], chunk=chunk)
    assert got.columns == ["i", "key", "timestamp", "value", "seen_at"]
    for r in got.collect():
        able = sorted((s, n, v) for k, s, n, v in right if k is not None and k == r["key"] and s is not None and r["timestamp"] is not None and s <= r["timestamp"])
        assert (r["value"], r["seen_at"]) == ((able[-1][2], able[-1][0]) if able else (None, None))
    assert got.count() == 200


def test_events_without_an_id_are_known_by_content(spark, tmp_path):
    path = str(tmp_path / "events")
    events = fixture.web_events(spark, SF).limit(30).withColumn("id", F.lit(None).cast("string"))
    tables.append_new(spark, events, path)
    tables.append_new(spark, events, path)
    stored = tables.read_events(spark, path)
    assert stored.count() == events.distinct().count() == stored.select("id").distinct().count()


def test_late_events_go_to_their_own_table_once(spark, tmp_path):
    events = fixture.web_events(spark, SF).limit(60).withColumn("n", F.xxhash64("id") % 3)
    batch = events.withColumn("received_at", F.when(F.col("n") == 0, F.col("timestamp") + F.expr("INTERVAL 5 DAYS")).when(F.col("n") == 1, F.col("timestamp")))
    work = jobs.split_late(str(tmp_path / "main"), str(tmp_path / "late"), "1 DAY")
    work(batch, 0)
    work(batch.unionByName(batch), 0)
    main, late = (tables.read_events(spark, str(tmp_path / n)) for n in ("main", "late"))
    assert late.count() == events.filter("n = 0").count() and main.count() == 60 - late.count()
    assert late.filter("n <> 0").isEmpty()
