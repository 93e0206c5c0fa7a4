"""Neighbouring rows and running totals per key, without putting a whole key in one task.

A plain window ordered by time sends all rows of a key to one task. Here a key is cut into time
chunks: the window runs per (key, chunk), and one summary row per chunk, built with map-side
aggregation, carries the value across the chunk border. A hot key is spread over its chunks. Only
keys that really cross a border have anything to carry, so the join with the summary is small and
Spark usually broadcasts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _with_chunk(df: DataFrame, chunk: str, time: str) -> DataFrame:
    return df.withColumn("_chunk", F.date_trunc(chunk, F.col(time)))


def _neighbour(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], chunk: str,
    time: str, forward: bool,
) -> DataFrame:
    pick, shift, edge = (F.min, F.lead, "_head") if forward else (F.max, F.lag, "_tail")
    cut = _with_chunk(df, chunk, time)
    held = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    edges = cut.groupBy(*keys, "_chunk").agg(
        pick(F.struct(F.struct(*order).alias("at"), held.alias("held"))).alias(edge)
    )
    carried = edges.withColumn(
        "_carry", shift(F.col(edge)["held"]).over(Window.partitionBy(*keys).orderBy("_chunk"))
    ).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
             F.col("_chunk").alias("_c"), "_carry").filter("_carry IS NOT NULL")
    local = cut.withColumn(
        "_near", shift(held).over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    )
    on: Column = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(carried, on, "left").withColumn("_near", F.coalesce("_near", "_carry"))
    for name in values:
        joined = joined.withColumn(name, F.col("_near")[name])
    return joined.drop("_near", "_carry", "_chunk", "_c", *[f"_k{i}" for i in range(len(keys))])


def next_row(df, keys, order, values, chunk="hour", time="timestamp") -> DataFrame:
    """Adds for each {new name: column} the value in the following row of the same key."""
    return _neighbour(df, keys, order, values, chunk, time, forward=True)


def previous_row(df, keys, order, values, chunk="hour", time="timestamp") -> DataFrame:
    """Adds for each {new name: column} the value in the preceding row of the same key."""
    return _neighbour(df, keys, order, values, chunk, time, forward=False)


def running_total(
    df: DataFrame, keys: list[str], order: list[str], measure: str, name: str,
    chunk: str = "hour", time: str = "timestamp",
) -> DataFrame:
    """Adds the sum of `measure` over this and all earlier rows of the key."""
    cut = _with_chunk(df, chunk, time)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_chunk").agg(F.sum(measure).alias("_total")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_chunk").alias("_c"),
        F.sum("_total").over(before).alias("_base"),
    ).filter("_base <> 0")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    on: Column = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        cut.withColumn("_inside", F.sum(measure).over(inside))
        .join(totals, on, "left")
        .withColumn(name, F.col("_inside") + F.coalesce("_base", F.lit(0)))
        .drop("_inside", "_base", "_chunk", "_c", *[f"_k{i}" for i in range(len(keys))])
    )


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], values: dict[str, str], left_time: str = "timestamp",
    right_time: str = "timestamp", right_order: list[str] | None = None, chunk: str = "month",
) -> DataFrame:
    """Adds to each row on the left, for each {new name: column}, the value in the newest row on the right with the
    same keys that is not later; NULL where there is none. Of several at one time the last by `right_order` counts.

    Both sides are put in one order per (key, chunk). What a chunk begins with comes from one summary row for each
    chunk of the right side, carried over empty chunks; so a hot key is spread over its chunks. Absent
    keys and times match nothing."""
    kind = left.schema[left_time].dataType
    held = F.struct(F.struct(F.col(right_time).alias("t"), *(right_order or [])).alias("at"),
                    *[F.col(source).alias(name) for name, source in values.items()])
    right = right.dropna(subset=[*keys, right_time])
    theirs = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_time).cast(kind).alias("_at"), held.alias("_held"))
    mine = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("_at"), F.struct(*left.columns).alias("_row"))
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("_chunk", F.date_trunc(chunk, "_at"))
    keyed = [f"_k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*keyed).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = both.groupBy(*keyed, "_chunk").agg(F.max("_held").alias("_last")).withColumn(
        "_carry", F.last("_last", ignorenulls=True).over(before)).filter("_carry IS NOT NULL").select(
        *[F.col(k).alias(f"{k}c") for k in keyed], F.col("_chunk").alias("_c"), "_carry")
    # at one time the right side comes first, in its own order
    inside = Window.partitionBy(*keyed, "_chunk").orderBy("_at", F.col("_row").isNotNull(), "_held").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    on: Column = F.col("_chunk") == F.col("_c")
    for k in keyed:
        on &= F.col(k) == F.col(f"{k}c")
    filled = both.withColumn("_near", F.last("_held", ignorenulls=True).over(inside)).filter("_row IS NOT NULL").join(edges, on, "left")
    found = F.coalesce("_near", "_carry")
    return filled.select("_row.*", *[found[name].alias(name) for name in values])
