"""First sessions of visitors, kept as a table: what tells a new visitor from a returning one without a look at
all sessions there ever were. Files are sorted by time, so a period reads the row groups of its own days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from footfall.functions.ranges import DateRange
from footfall.plans.keyed import BUCKETS, merge_by_key, read_keyed

KEY = ["site_id", "user_id"]


def first_sessions(sessions: DataFrame) -> DataFrame:
    """The first session of each (site, visitor); of several at one time that with the smallest id."""
    return sessions.groupBy(*KEY).agg(F.min(F.struct("started_at", "id")).alias("_r")).select(
        *KEY, F.col("_r.started_at").alias("timestamp"), F.col("_r.id").alias("id"))


def merge_first(spark: SparkSession, sessions: DataFrame, path: str, buckets: int = BUCKETS, staged: str | None = None) -> None:
    """Bring the sessions of a batch in. A minimum: repeated, late and reordered batches give the same table."""
    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", *KEY).agg(F.min(F.struct("timestamp", "id")).alias("_r")).select(
            *KEY, F.col("_r.timestamp").alias("timestamp"), F.col("_r.id").alias("id"), "bucket")

    merge_by_key(spark, path, first_sessions(sessions), KEY, least, buckets, staged)


def read_first(spark: SparkSession, path: str, sessions: DataFrame) -> DataFrame:
    """The table; `sessions` gives the types of its columns."""
    return read_keyed(spark, path, StructType(first_sessions(sessions).schema.fields))


def mark_by_first(sessions: DataFrame, first: DataFrame, period: DateRange) -> DataFrame:
    """`is_returning` for the sessions of a period: all but the visitor's first one. Only first sessions of the
    period itself are read: a visitor without one in it was there before."""
    at = F.lit(period.start.isoformat(sep=" ")), F.lit(period.end.isoformat(sep=" "))
    start, end = (a.cast(first.schema["timestamp"].dataType) for a in at)
    mine = first.filter(F.col("timestamp").between(start, end)).select(
        *[F.col(c).alias(f"_{c}") for c in (*KEY, "timestamp", "id")])
    same = [sessions[a].eqNullSafe(mine[b]) for a, b in
            (("site_id", "_site_id"), ("user_id", "_user_id"), ("started_at", "_timestamp"), ("id", "_id"))]
    inside = sessions.filter(F.col("started_at").between(start, end))
    return inside.join(mine, same, "left").withColumn("is_returning", F.col("_timestamp").isNull()).drop(*mine.columns)
