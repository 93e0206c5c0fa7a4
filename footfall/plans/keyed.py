"""Tables kept by key: Parquet under `bucket=<n>`, a hash of the key, of a number of buckets that is fixed when
the table is made. A batch reads and replaces the buckets of its own keys and leaves the others alone, so its
cost follows the batch and the bucket size, not the table. A hot key is a row, like any other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from footfall.plans.tables import latest_per_key, replace_partitions, stored_at

BUCKETS = 256
PARTITIONS = ["bucket"]


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    return stored_at(spark, path, StructType([f for f in schema if f.name != "bucket"]).add("bucket", IntegerType()))


def read_buckets(spark: SparkSession, path: str, schema: StructType, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame | None:
    """The stored rows in the buckets of these rows' keys; None before the first batch. The numbers of
    those buckets, `buckets` at most, come to the driver and prune directories."""
    table = _table(spark, path, schema)
    if table is None:
        return None
    touched = [r[0] for r in rows.select(bucket_of(keys, buckets).alias("bucket")).distinct().collect()]
    return table.filter(F.col("bucket").isin(touched))


def merge_by_key(
    spark: SparkSession, path: str, batch: DataFrame, keys: list[str], combine: Callable[[DataFrame], DataFrame],
    buckets: int = BUCKETS, staged: str | None = None,
) -> None:
    """Bring a batch into the table. `combine` makes one row a key of the old and new rows of the touched buckets;
    it must give the same if new rows come again, so that a repeated batch changes nothing. `staged`: see
    `replace_partitions`."""
    old = read_buckets(spark, path, batch.schema, batch, keys, buckets)

    def build() -> DataFrame:
        marked = batch.withColumn("bucket", bucket_of(keys, buckets))
        both = marked if old is None else old.select(*marked.columns).unionByName(marked)
        return combine(both).select(*marked.columns)

    replace_partitions(spark, build, path, PARTITIONS, staged)


def upsert_stored(
    spark: SparkSession, changes: DataFrame, path: str, keys: list[str], newest: list[str], buckets: int = BUCKETS,
    staged: str | None = None,
) -> None:
    """Apply changes to a stored table of one row a key; the newest row of a key stays, by the columns `newest`."""
    merge_by_key(spark, path, changes, keys, lambda rows: latest_per_key(rows, keys, newest), buckets, staged)


def read_keyed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The whole table."""
    table = _table(spark, path, schema)
    return spark.createDataFrame([], schema) if table is None else table.drop("bucket")
