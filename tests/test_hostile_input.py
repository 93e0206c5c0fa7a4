"""Numbers that no report can use, and tenant SQL that reaches for more than its tables."""

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from footfall.catalog import _goals, sessions_of
from footfall.functions.ranges import DateRange
from footfall.operators import engagement, issues
from footfall.plans import dashboard
from footfall.plans.site_sql import site_sql
from footfall.sources import fixture

SF = "/root/testdata/sf0.001"
MONTH = DateRange(datetime(2024, 1, 1), datetime(2024, 2, 1))


@pytest.fixture(scope="module")
def events(spark):
    kept = fixture.web_events(spark, SF).cache()
    yield kept
    kept.unpersist(blocking=True)


@pytest.mark.parametrize("value", ["1e300", '"NaN"', '"Infinity"', '"-1e400"', '"x"'])
def test_one_bad_number_does_not_fail_a_report(spark, events, value):
    bad = F.lit(f'{{"seconds":{value},"depth":{value},"count":{value},"x":{value},"y":{value}}}')
    hostile = events.withColumn("properties", F.when(F.xxhash64("id") % 3 == 0, bad).otherwise(F.col("properties")))
    for report in (engagement.scroll_depth, engagement.heatmap_points, engagement.rage_clicks, engagement.time_on_page, engagement.engagement_summary):
        report(hostile, MONTH).collect()


def test_issue_counts_of_odd_numbers(spark):
    rows = [("a", "p", "[[1704067200, 3], [1e300, 4], [1704067200, 1e300], [1704067200, 2]]")]
    got = issues.daily_issue_counts(spark.createDataFrame(rows, "site_id string, project_slug string, stats string")).collect()
    assert {(str(r["date"]), r["events"]) for r in got} == {("2024-01-01", 5), ("None", 4)}


def test_all_report_sources_run(spark, events):
    sources = dashboard.report_sources(events, sessions_of(events), _goals(spark), MONTH)
    assert len(sources) == 19
    for source in sources.values():
        source().limit(1).collect()


def run(spark, events, text, **given):
    return site_sql(spark, text, "site_a", lambda s: {"events": s.read.parquet(given["path"])}).collect()


def test_tenant_sql_stays_inside(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.write.parquet(path)
    spark.sql("CREATE OR REPLACE GLOBAL TEMP VIEW foreign_rows AS SELECT 1 AS x")
    spark.range(3).write.mode("overwrite").option("path", str(tmp_path / "other")).saveAsTable("other_tenant")
    own = events.filter("site_id = 'site_a'").count()
    assert run(spark, events, "SELECT count(*) AS n FROM events;", path=path)[0].n == own
    assert run(spark, events, "WITH e AS (SELECT * FROM events) SELECT count(*) AS n FROM e -- done", path=path)[0].n == own
    for text in ("CREATE TABLE zz AS SELECT 1", "DROP TABLE other_tenant", "SELECT 1; DROP TABLE other_tenant", "INSERT INTO events SELECT * FROM events", "SHOW TABLES"):
        with pytest.raises((ParseException, AnalysisException)):
            run(spark, events, text, path=path)
    for text in ("SELECT * FROM other_tenant", "SELECT * FROM default.other_tenant", "SELECT * FROM global_temp.foreign_rows",
                 f"SELECT count(*) FROM parquet.`{path}`", "SELECT * FROM events WHERE site_id IN (SELECT CAST(id AS STRING) FROM other_tenant)"):
        with pytest.raises((PermissionError, AnalysisException)):
            run(spark, events, text, path=path)
    assert spark.table("other_tenant").count() == 3
