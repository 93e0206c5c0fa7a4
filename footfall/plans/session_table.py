"""The stored sessions: Parquet under `session_date=`, the day a session started, so that a period prunes
directories. The table is kept up by the sessions that a batch of events touches, however long they run. Beside it
stands an index by session key of the days that a session covers, so that a batch finds its old sessions in the
buckets of its own keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.operators.sessions import sessionise_by_id
from footfall.plans.keyed import BUCKETS, PARTITIONS as INDEX_PARTITIONS, bucket_of, merge_by_key, read_buckets
from footfall.plans.tables import drop_path, finished, full_rebuild, overwrite_touched, stored_at

KEY = ["site_id", "id", "user_id"]
PARTITIONS = ["session_date"]


def with_session_date(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("session_date", F.to_date("started_at"))


def _spans(sessions: DataFrame) -> DataFrame:
    """The index rows of sessions: their key and the days on which they start and end."""
    return sessions.select(*KEY, "session_date", F.to_date("ended_at").alias("last_date"))


def index_path(path: str) -> str:
    return f"{path.rstrip('/')}-index"


def write_sessions(sessions: DataFrame, path: str) -> None:
    """Write the whole table anew. Its index is made by the first batch that asks for it."""
    drop_path(sessions.sparkSession, index_path(path))
    full_rebuild(with_session_date(sessions), path, PARTITIONS)


def stored_spans(spark: SparkSession, path: str, keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The days of the stored sessions with these keys, read from the buckets of the keys. A table that has no
    index yet gets one."""
    schema = _spans(with_session_date(spark.createDataFrame([], f"{', '.join(f'{k} string' for k in KEY)}, started_at timestamp, ended_at timestamp"))).schema
    rows = read_buckets(spark, index_path(path), schema, keys, KEY, buckets)
    if rows is None and finished(spark, path):
        full_rebuild(_spans(read_sessions(spark, path)).withColumn("bucket", bucket_of(KEY, buckets)), index_path(path), INDEX_PARTITIONS)
        rows = read_buckets(spark, index_path(path), schema, keys, KEY, buckets)
    return spark.createDataFrame([], schema) if rows is None else _of(rows.drop("bucket"), keys, {}, "left_semi")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions under the path. Rows without a start only mark a partition as replaced."""
    return spark.read.parquet(path).filter("started_at IS NOT NULL")


def _of(rows: DataFrame, keys: DataFrame, names: dict[str, str], how: str) -> DataFrame:
    """Semi or anti join with session keys; absent parts of a key are equal to each other."""
    same = reduce(lambda a, b: a & b, [rows[names.get(k, k)].eqNullSafe(keys[k]) for k in KEY])
    return rows.join(keys, same, how)


def session_keys(batch: DataFrame) -> DataFrame:
    return batch.select("site_id", F.col("session_id").alias("id"), "user_id").distinct()


def _dates(*frames: DataFrame) -> list:
    """The distinct dates of one-column frames: a list that grows with days, not with rows."""
    return [r[0] for r in reduce(DataFrame.union, frames).distinct().collect()]


def _stage(batch: DataFrame, events: DataFrame, path: str, staged: str, buckets: int) -> None:
    spark, keys = batch.sparkSession, session_keys(batch)
    schema = with_session_date(sessionise_by_id(events)).schema
    table = stored_at(spark, path, schema)
    table = spark.createDataFrame([], schema) if table is None else table.filter("started_at IS NOT NULL")
    old = stored_spans(spark, path, keys, buckets)
    days = _dates(
        batch.select(F.to_date("timestamp")),
        old.select(F.explode(F.sequence("session_date", "last_date"))))
    theirs = _of(events.filter(F.col("event_date").isin(days)), keys, {"id": "session_id"}, "left_semi")
    with_session_date(sessionise_by_id(theirs)).write.mode("overwrite").parquet(f"{staged}/fresh")
    fresh = spark.read.schema(schema).parquet(f"{staged}/fresh").withColumn("touched", F.lit(True))
    left = old.select("site_id", "session_date").distinct().withColumn("touched", F.lit(True))
    dates = _dates(fresh.select("session_date"), old.select("session_date"))
    stay = _of(table.filter(F.col("session_date").isin(dates)), keys, {}, "left_anti")
    rows = fresh.unionByName(stay.withColumn("touched", F.lit(False))).unionByName(left, allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(f"{staged}/rows")


def _index(spark: SparkSession, path: str, staged: str, buckets: int) -> None:
    """Days of the batch's sessions. A session only ever grows: its first and last day of all batches are right."""
    def widest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", *KEY).agg(F.min("session_date").alias("session_date"), F.max("last_date").alias("last_date"))

    merge_by_key(spark, index_path(path), _spans(spark.read.parquet(f"{staged}/fresh")), KEY, widest, buckets, f"{staged}/index")


def merge_sessions(batch: DataFrame, events: DataFrame, path: str, staged: str, buckets: int = BUCKETS) -> DataFrame:
    """Bring the sessions of a batch up to date and return the (site, day) pairs on which they started
    before or start now.

    A touched session is computed anew from the stored `events` of its old span and the batch's days, so a
    repeated batch changes nothing. Only partitions in which touched sessions start or started are replaced;
    a session whose start moved leaves its old one. They are written to `staged` first, a folder of this
    batch alone: a job that fails while it replaces partitions finds them there when the batch is repeated.
    The old rows are found in the index, in the buckets of the batch's own sessions."""
    spark = batch.sparkSession
    if not finished(spark, f"{staged}/rows"):
        _stage(batch, events, path, staged, buckets)
    rows = spark.read.parquet(f"{staged}/rows")
    overwrite_touched(rows.drop("touched"), path, PARTITIONS)
    _index(spark, path, staged, buckets)
    return rows.filter("touched").select("site_id", F.col("session_date").alias("date")).distinct()
