"""Reports from one scan equal the same reports one by one, for hostile rows too."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from footfall.catalog import _goals, sessions_of
from footfall.functions.ranges import DateRange
from footfall.plans import dashboard
from footfall.plans.shared import shared_reports
from footfall.sources import fixture

SF = "/root/testdata/sf0.001"
WEEK, AS_OF = DateRange(datetime(2024, 1, 24), datetime(2024, 1, 31)), datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def odd_events(spark, tmp_path_factory):
    """Events without visitor, session, page or type, of a site with nothing in the period, and after its end."""
    path = str(tmp_path_factory.mktemp("odd") / "events")
    h = F.abs(F.xxhash64("id"))
    rows = fixture.web_events(spark, SF)
    for i, c in enumerate(["user_id", "session_id", "path", "type", "device", "country", "utm_source", "referrer", "properties"]):
        rows = rows.withColumn(c, F.when(h % 23 == i, F.lit(None)).when(h % 23 == i + 10, F.lit("")).otherwise(F.col(c)))
    early = F.to_timestamp(F.lit("2024-01-18 10:00:00")).cast(rows.schema["timestamp"].dataType)
    rows = rows.withColumn("site_id", F.when(h % 29 == 0, "only_before").otherwise(F.col("site_id"))).withColumn(
        "timestamp", F.when(F.col("site_id") == "only_before", early).otherwise(F.col("timestamp")))
    rows.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted((r.site_id, r.report, r.item, r.metric, None if r.value is None else round(r.value, 9)) for r in df.collect())


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


@pytest.mark.parametrize("site", [None, "site_b"])
def test_dashboard_in_one_scan_equals_its_reports(spark, odd_events, site):
    sessions = sessions_of(odd_events)
    last = odd_events.filter((F.col("timestamp") < WEEK.end) & (F.col("site_id") == "site_b")).agg(F.max("timestamp")).first()[0]
    got = dashboard.dashboard_table(odd_events, sessions, WEEK, last, site)
    want = rows_of(dashboard.long_form(dashboard.dashboard_all(odd_events, sessions, WEEK, last, site, keep=False)))
    assert scans(got) == 1 + scans(sessions)  # asked before it runs; the plan of a run query has both forms
    assert rows_of(got) == want and len({r[1] for r in want}) == 10


def test_report_sources_in_few_scans_equal_their_reports(spark, odd_events):
    sessions = sessions_of(odd_events).withColumn("user_id", F.when(F.length("id") % 5 == 0, F.lit(None)).otherwise(F.col("user_id")))
    sources = dashboard.report_sources(odd_events, sessions, _goals(spark), WEEK)
    got = dashboard.report_table(odd_events, sessions, _goals(spark), WEEK)
    want = rows_of(dashboard.long_form({name: build() for name, build in sources.items()}))
    # counts, goals, and the vitals' histogram, which its three readers share when it runs
    assert scans(got) == 5 + 2 * scans(sessions)
    assert rows_of(got) == want and len({r[1] for r in want}) == 19


def test_shared_reports_of_nothing(spark, odd_events):
    none = odd_events.limit(0)
    assert dashboard.dashboard_table(none, sessions_of(none), WEEK, AS_OF).count() == 0


def test_long_lists_are_cut_before_the_shuffle(spark, odd_events):
    found = shared_reports(odd_events, sessions_of(odd_events), WEEK, {"top_pages": 3, "entry_pages": 2})
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    per = found.select("site_id", "report", "item").distinct().groupBy("site_id", "report").count().collect()
    assert per and all(r["count"] <= {"top_pages": 3, "entry_pages": 2}[r.report] for r in per)
