"""Helpers of the subpackage: tables, shared folders, prefix sums over range partitions, Arrow pieces."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: ASCII white space as the contracts write it: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_PER_PART = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (`spark.checkpoint.dir`). Only a session that
    runs on one machine may go without that setting; it then gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="run-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stored(frame: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """The frame as a written table in the shared folder: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    path = shared_path(spark, name)
    writer = frame.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def around(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`stage` over documents none of whose columns begins with `_`, as the stage's own do: such columns are
    called otherwise meanwhile."""
    names = docs.columns
    taken, meanwhile = {n.lower() for n in names}, []
    for name in names:
        new = name
        while new.startswith("_") or (new != name and new.lower() in taken):
            new = f"other{new}"
        taken.add(new.lower())
        meanwhile.append(new)
    return stage(docs) if meanwhile == names else stage(docs.toDF(*meanwhile)).toDF(*names)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def parts_for(rows: int, rows_per_part: int = ROWS_PER_PART) -> int:
    return max(16, -(-rows // rows_per_part))


def with_offsets(frame: DataFrame, part: str, order: list[Column], sums: dict[str, str],
                 within: list[str] | None = None) -> DataFrame:
    """Running sums over a table that is cut into ordered parts, without a task that holds it all.

    `part` numbers the parts in order. `sums` maps a new column to the summed column; the new column
    holds the sum of all rows before this one. Totals per part (map-side aggregated, one row a part)
    are summed over the parts, then each part is summed on its own. `within` restarts the sums per
    key; a hot key is still split over its parts."""
    keys = within or []
    totals = frame.groupBy(*keys, part).agg(*[F.sum(c).alias(f"_{new}") for new, c in sums.items()])
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(part).alias("_part"),
                           *[F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums])
    same = F.col(part) == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    own = W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = frame.join(starts, same, "left")
    return joined.withColumns({new: F.col(f"_{new}") + F.coalesce(F.sum(c).over(own), F.lit(0))
                               for new, c in sums.items()}).drop(
        "_part", *[f"_{new}" for new in sums], *[f"_key_{k}" for k in keys])


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the text of each is about `limit` bytes; a longer text is alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            used = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, used + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
