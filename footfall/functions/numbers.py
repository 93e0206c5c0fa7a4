"""Rounding, shares, exact sums and per-group top-k used across the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards +infinity (-2.5 -> -2), unlike SQL `round`."""
    if digits == 0:
        return F.floor(x + F.lit(0.5))
    scale = F.lit(float(10 ** digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def round_interpolated(x: Column, digits: int) -> Column:
    """`round_half_up` for interpolated values: a value that is a half up to floating-point noise
    counts as a half, whichever way the interpolation was written."""
    scale = 10.0 ** digits
    return F.floor(F.round(x * scale, 6) + 0.5) / scale


def percent(part: Column, total: Column, digits: int = 0) -> Column:
    """`part` of `total` in percent, 0 for an empty total."""
    ratio = part.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    if digits == 0:
        return F.coalesce(F.floor(ratio * 100.0 + 0.5), F.lit(0).cast("bigint"))
    return F.coalesce(F.floor(ratio * 100.0 * 10 ** digits + 0.5) / 10.0 ** digits, F.lit(0.0))


def trend(current: Column, previous: Column) -> Column:
    """Change in percent with one decimal; from zero it is 100 when there is anything now."""
    change = F.floor((current - previous) / F.nullif(previous, F.lit(0.0)) * 1000.0 + 0.5) / 10.0
    return F.when(previous == 0, F.when(current > 0, 100.0).otherwise(0.0)).otherwise(change)


def exact(x: Column) -> Column:
    """Decimal form of a measure: sums do not depend on the order in which tasks finish."""
    return x.try_cast("decimal(28,6)")


def exact_sum(x: Column) -> Column:
    return F.coalesce(F.sum(exact(x)).cast("double"), F.lit(0.0))


def exact_mean(x: Column) -> Column:
    return F.sum(exact(x)).cast("double") / F.nullif(F.count(exact(x)), F.lit(0))


def shown_number(x: Column) -> Column:
    """Text of a number without a trailing `.0`."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def and_list(phrases: Column) -> Column:
    """An array of phrases as running text: `a`, `a and b`, `a, b, and c`."""
    n = F.size(phrases)
    return (
        F.when(n <= 2, F.array_join(phrases, " and "))
        .otherwise(F.concat(
            F.array_join(F.slice(phrases, 1, F.greatest(n - 1, F.lit(1))), ", "),
            F.lit(", and "),
            F.try_element_at(phrases, F.lit(-1)),
        ))
    )


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark cuts each input partition to k rows per group
    before the shuffle (WindowGroupLimit), so a hot group costs k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def with_share(
    df: DataFrame, keys: list[str], measure: str, name: str = "percentage", digits: int = 0
) -> DataFrame:
    """Share of the rows present. Apply after `top_per`, or on a small set of labels."""
    total = F.sum(measure).over(Window.partitionBy(*keys))
    return df.withColumn(name, percent(F.col(measure), total, digits))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def desc_then(measure: str, *names: str) -> list[Column]:
    """Largest first, then the names in ascending order with NULL last."""
    return [F.col(measure).desc(), *[F.col(n).asc_nulls_last() for n in names]]


def present(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value in `column`. Written as an explode, because a filter on a costly column is
    pushed below it and the column would be computed twice."""
    return df.withColumn(column, F.explode(F.array_compact(F.array(column))))
