"""Exact percentiles of groups of any size.

Equal values are counted first (map-side), giving a histogram. Its values fall into cells of a
logarithmic scale; a running count over the few cells of a group finds the cells that hold the
wanted ranks, and only the values of those cells are put in order. A task holds the distinct values of one
cell: those within 0.3 % of each other, or within 0.003 near zero.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

CELLS_PER_DOUBLING = 256


def histogram(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, v, n): how often each value occurs; unreadable values are counted under NULL."""
    return df.groupBy(*keys, value.alias("v")).agg(F.count("*").alias("n"))


def _cell(v: Column) -> Column:
    return F.floor(F.signum(v) * F.log2(1 + F.abs(v)) * CELLS_PER_DOUBLING)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def values_at(hist: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group the value at each wanted rank (counted from 0 in ascending order). A rank is given
    as a function of the group's number of values."""
    n = F.when(F.col("v").isNull(), 0).otherwise(F.col("n"))
    celled = hist.withColumn("_cell", _cell(F.col("v")))
    by_cell = Window.partitionBy(*keys).orderBy("_cell")
    before = F.coalesce(F.sum("_n").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    cells = celled.groupBy(*keys, "_cell").agg(F.sum(n).alias("_n")).withColumns(
        {"_before": before, "_total": total}).withColumns(
        {f"_rank_{name}": rank(F.col("_total")) for name, rank in ranks.items()})
    holds = reduce(lambda a, b: a | b, [
        (F.col(f"_rank_{name}") >= F.col("_before"))
        & (F.col(f"_rank_{name}") < F.col("_before") + F.col("_n")) for name in ranks])
    wanted = cells.filter(holds).drop("_n", "_total")
    inside = Window.partitionBy(*keys, "_cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = join_on(celled, wanted, [*keys, "_cell"]).withColumn(
        "_reached", F.col("_before") + F.sum("n").over(inside))
    return values.groupBy(*keys).agg(*[
        F.min(F.when(
            (F.col("_reached") > F.col(f"_rank_{name}")) & (F.col(f"_rank_{name}") >= F.col("_before")),
            F.col("v"))).alias(name)
        for name in ranks])


def with_percentile(
    df: DataFrame, keys: list[str], value: Column, q: float, extra: list[Column]
) -> DataFrame:
    """Per group the exact percentile (linear between neighbours) and further aggregates over the
    histogram columns `v` and `n`."""
    hist = histogram(df, keys, value)
    n = F.when(F.col("v").isNull(), 0).otherwise(F.col("n"))
    place = lambda total: (total - 1) * F.lit(q)
    found = values_at(hist, keys, {
        "_low": lambda total: F.floor(place(total)), "_high": lambda total: F.ceil(place(total))})
    sums = hist.groupBy(*keys).agg(F.sum(n).alias("_values"), *extra)
    part = place(F.col("_values")) - F.floor(place(F.col("_values")))
    both = join_on(sums, found, keys, "left")
    return both.withColumn(
        "percentile", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
            (1 - part) * F.col("_low") + part * F.col("_high"))
    ).drop("_low", "_high", "_values")
