"""Percentiles from merged sketches: rank error within the stated bound on many more samples than a sketch holds."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from footfall.functions.ranges import DateRange
from footfall.plans import rollup


@pytest.mark.parametrize("share", [0.5, 0.75, 0.99])
def test_merged_sketches_stay_within_the_stated_rank_error(spark, share):
    n, days = 60_000, 20
    rows = spark.range(n).select(
        F.lit("s").alias("site_id"), F.lit("web_vital").alias("type"), F.concat(F.lit("/p"), (F.col("id") % 2).cast("string")).alias("path"),
        F.expr(f"timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % {days} AS int))").alias("timestamp"),
        F.concat(F.lit('{"name":"LCP","value":'), ((F.col("id") * 7919) % n).cast("string"), F.lit("}")).alias("properties"))
    sketches = rollup.daily_vital_sketches(rows)
    assert sketches.count() == 2 * days if days % 2 else sketches.filter("path IS NULL").count() == days
    got = {r["path"]: r for r in rollup.vitals_from_sketches(sketches, DateRange(datetime(2024, 1, 1), datetime(2024, 2, 1)), share=share).collect()}
    assert set(got) == {None, "/p0", "/p1"} and got[None]["samples"] == n
    # the values are 0 to n - 1, each once, so a value is its own rank
    assert abs(got[None]["percentile"] / n - share) <= rollup.VITALS_RANK_ERROR
    half = rollup.vitals_from_sketches(sketches, DateRange(datetime(2024, 1, 1), datetime(2024, 1, 5)), share=share).filter("path IS NULL").first()
    assert half["samples"] == n // days * 5


def test_no_vitals_no_sketches(spark):
    empty = spark.createDataFrame([], "site_id string, type string, path string, timestamp timestamp, properties string")
    assert rollup.vitals_from_sketches(rollup.daily_vital_sketches(empty), DateRange(datetime(2024, 1, 1), datetime(2024, 2, 1))).count() == 0
