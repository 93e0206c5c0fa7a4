"""Significance of a difference between two conversion rates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.numbers import round_half_up
from footfall.functions.ranks import histogram, join_on, values_at

# Abramowitz & Stegun 7.1.26, coefficients of t^1 .. t^5 and the factor in t.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_T = 0.3275911
MIN_CELL, ALPHA = 5, 0.05


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_ERF_T) * x)
    poly: Column = F.lit(0.0)
    for coefficient in reversed(_ERF):
        poly = (poly + F.lit(coefficient)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.when(z < 0, -erf).otherwise(erf))


def two_proportion_test(
    control_hits: Column, control_n: Column, hits: Column, n: Column
) -> dict[str, Column]:
    """Two-sided z-test of a variant against the control; NULL statistics when a group is empty or
    nothing varies. `reliable` needs an expected count of 5 in each of the four cells."""
    d1, d2 = F.nullif(control_n.cast("double"), F.lit(0.0)), F.nullif(n.cast("double"), F.lit(0.0))
    p1, p2 = control_hits / d1, hits / d2
    pooled = (control_hits + hits) / (d1 + d2)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / d1 + 1 / d2))
    z = (p2 - p1) / F.nullif(spread, F.lit(0.0))
    p_value = 2 * (1 - normal_cdf(F.abs(z)))
    enough = (
        (d1 * pooled >= MIN_CELL) & (d1 * (1 - pooled) >= MIN_CELL)
        & (d2 * pooled >= MIN_CELL) & (d2 * (1 - pooled) >= MIN_CELL)
    )
    reliable = F.coalesce(z.isNotNull() & enough, F.lit(False))
    return {
        "z_score": round_half_up(z, 3),
        "p_value": round_half_up(p_value, 4),
        "confidence": F.floor((1 - p_value) * 1000 + 0.5) / 10,
        "significant": F.coalesce(reliable & (p_value < ALPHA), F.lit(False)),
        "uplift": F.floor((p2 - p1) / F.nullif(p1, F.lit(0.0)) * 1000 + 0.5) / 10,
        "reliable": reliable,
    }


def timing_summary(samples: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """Number, extremes, mean, nearest-rank percentiles and sample deviation per group."""
    v = F.col(value)
    exact = F.sum(v.cast("decimal(28,6)")).cast("double") / F.count(v)
    sums = samples.groupBy(*keys).agg(
        F.count(v).alias("n"),
        round_half_up(F.min(v), 3).alias("min"), round_half_up(F.max(v), 3).alias("max"),
        round_half_up(exact, 3).alias("mean"),
        F.coalesce(F.round(F.stddev_samp(v), 3), F.lit(0.0)).alias("stddev"))

    def nearest(q: float):
        return lambda total: F.greatest(F.ceil(total * F.lit(q)) - 1, F.lit(0))

    found = values_at(
        histogram(samples, keys, v), keys, {"median": nearest(0.5), "p95": nearest(0.95), "p99": nearest(0.99)})
    return join_on(sums, found, keys, "left").withColumns(
        {name: round_half_up(F.col(name), 3) for name in ("median", "p95", "p99")})
