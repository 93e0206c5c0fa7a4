"""Jobs on small literal tables and against plain Python."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from footfall import schemas
from footfall.functions.ordered import next_row, previous_row, running_total
from footfall.functions.ranges import DateRange
from footfall.functions.ranks import with_percentile
from footfall.functions.stats import timing_summary
from footfall.operators import audience, conversion, engagement, explain, ingest, issues, search, traffic
from footfall.operators.sessions import gap_sessions, mark_returning, sessionise_by_id
from footfall.plans import site_sql

T0 = datetime(2024, 5, 6)
YEAR = DateRange(datetime(2024, 1, 1), datetime(2024, 12, 31))


def events(spark, *rows):
    """Rows of (user, minutes, type, path, extra columns)."""
    full = []
    for n, (user, minutes, kind, path, *extra) in enumerate(rows):
        row = {name: None for name in schemas.EVENTS.names}
        row.update(id=f"{n:03}", site_id="s", user_id=user, session_id=user, type=kind, path=path,
                   properties="{}", timestamp=T0 + timedelta(minutes=minutes))
        for e in extra:
            row.update(e)
        full.append(tuple(row[c] for c in schemas.EVENTS.names))
    return spark.createDataFrame(full, schemas.EVENTS)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", T0 + timedelta(seconds=rng.randrange(200_000)), i, rng.randrange(3))
            for i in range(600)]
    return spark.createDataFrame(rows, "k string, timestamp timestamp, id int, v int").cache()


@pytest.mark.parametrize("helper, plain", [(next_row, F.lead), (previous_row, F.lag)])
def test_neighbours_equal_plain_window(series, helper, plain):
    got = helper(series, ["k"], ["timestamp", "id"], {"other": "v"}, "hour")
    want = series.withColumn("other", plain("v").over(Window.partitionBy("k").orderBy("timestamp", "id")))
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == 600


def test_running_total_equals_plain_window(series):
    got = running_total(series, ["k"], ["timestamp", "id"], "v", "total", "hour")
    w = Window.partitionBy("k").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = series.withColumn("total", F.sum("v").over(w))
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == 600


def test_sessions_from_events(spark):
    e = events(
        spark, ("u", 0, "click", "/x", {"referrer": "r0"}), ("u", 1, "pageview", "/a"), ("u", 3, "pageview", "/b"),
        ("v", 0, "pageview", "/c"), ("w", 5, "click", "/d"))
    s = {r.user_id: r for r in sessionise_by_id(e).collect()}
    assert (s["u"].entry_page, s["u"].exit_page, s["u"].pageviews, s["u"].duration) == ("/a", "/b", 2, 180)
    assert s["u"].referrer == "r0" and not s["u"].is_bounce and s["v"].is_bounce
    assert s["w"].entry_page is None and s["w"].pageviews == 0 and s["w"].is_bounce


def test_returning_breaks_ties_by_id(spark):
    e = events(spark, ("u", 0, "pageview", "/", {"session_id": "b"}), ("u", 0, "pageview", "/", {"session_id": "a"}),
               ("u", 9, "pageview", "/", {"session_id": "c"}))
    got = {r.id: r.is_returning for r in mark_returning(sessionise_by_id(e)).collect()}
    assert got == {"a": False, "b": True, "c": True}


def test_gap_sessions_across_midnight(spark):
    e = events(spark, ("u", -20, "pageview", "/"), ("u", 5, "pageview", "/"), ("u", 35, "click", "/"), ("u", 66, "pageview", "/"))
    got = [(r.session_no, r.events, r.duration) for r in gap_sessions(e).orderBy("session_no").collect()]
    assert got == [(1, 3, 55 * 60), (2, 1, 0)]


def test_exact_percentile(spark):
    rng = random.Random(1)
    rows = [(f"g{i % 3}" if i % 4 else None, rng.choice([0.5, -1.25, 7.0, rng.uniform(-9, 900)])) for i in range(300)]
    rows += [("g0", None), ("lone", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.percentile for r in with_percentile(df, ["g"], F.col("x"), 0.75, [F.sum("n").alias("rows")]).collect()}
    assert got.pop("none") is None and got["lone"] == 3.5
    for g, value in got.items():
        assert value == pytest.approx(np.percentile([x for k, x in rows if k == g and x is not None], 75))


def python_rage(clicks):
    """The rule, click by click: third click within a second, then five quiet seconds."""
    out = []
    for key in sorted({c[:5] for c in clicks}):
        recent, quiet = [], None
        for t in sorted(c[5] for c in clicks if c[:5] == key):
            recent = [r for r in recent if t - r < 1000] + [t]
            if len(recent) >= 3 and (quiet is None or t >= quiet):
                quiet = t + 5000
                out.append((*key, t, len(recent)))
    return sorted(out)


def test_rage_clicks_equal_click_by_click_rule(spark):
    rng = random.Random(3)
    clicks = []
    for i in range(1500):
        user = "hot" if i % 3 else f"u{i % 7}"
        t = rng.randrange(0, 400_000) if i % 2 else rng.randrange(59_000, 62_500)
        clicks.append(("s", user, "x", "/", "a", t))
    for block in (3_600_000, 60_000, 5_000):
        got = reported_clicks(clicks_frame(spark, clicks), block_ms=block)
        assert got == python_rage(clicks) and len(got) > 20


def clicks_frame(spark, clicks):
    return spark.createDataFrame(
        [(*c[:5], str(n), c[5]) for n, c in enumerate(clicks)],
        "site_id string, user_id string, session_id string, path string, selector string, id string, ms bigint",
    ).withColumn("timestamp", F.timestamp_millis("ms"))


def reported_clicks(df, **how):
    found = engagement.detect_rage_clicks(df, **how).withColumn("ms", F.unix_millis("timestamp")).collect()
    return sorted((r.site_id, r.user_id, r.session_id, r.path, r.selector, r.ms, r["count"]) for r in found)


def test_a_run_without_pause_is_followed_over_its_blocks(spark):
    rng = random.Random(5)
    t, clicks = -90_000, []  # before 1970 too
    while t < 900_000:
        t += rng.choice([0, 7, 130, 290, 333])
        clicks.append(("s", "bot", "x", "/", "a", t))
    clicks += [("s", "after", "x", "/", "a", 59_000 + 400 * i) for i in range(30)]
    for block in (3_600_000, 60_000, 5_000):
        assert reported_clicks(clicks_frame(spark, clicks), block_ms=block) == python_rage(clicks)
    assert len(python_rage(clicks)) > 150
    plan = engagement.detect_rage_clicks(clicks_frame(spark, clicks))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan  # no group of clicks is one Python call


def test_rage_clicks_of_absent_keys_and_no_clicks(spark):
    clicks = [("s", None, None, "/", "a", 100 * i) for i in range(4)]
    df = clicks_frame(spark, clicks)
    assert [r["count"] for r in engagement.detect_rage_clicks(df).collect()] == [3]
    assert engagement.detect_rage_clicks(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        engagement.detect_rage_clicks(df, block_ms=1000)


def test_clusters_equal_greedy_rule(spark):
    rng = random.Random(5)
    points = [("s", "/", float(rng.randrange(20)), float(rng.randrange(20)), 0, 0, f"b{i}", rng.randrange(1, 9)) for i in range(80)]
    df = spark.createDataFrame(
        points, "site_id string, path string, rel_x double, rel_y double, abs_x bigint, abs_y bigint, selector string, clicks bigint")
    left = sorted(points, key=lambda p: (-p[7], p[2], p[3], p[4], p[5], p[6]))
    want = []
    while left:
        head = left[0]
        near = [p for p in left if (p[2] - head[2]) ** 2 + (p[3] - head[3]) ** 2 <= 9]
        want.append((head[2], head[3], head[6], sum(p[7] for p in near), len(near)))
        left = [p for p in left if p not in near]
    got = engagement.heatmap_clusters(df).collect()
    assert sorted((r.rel_x, r.rel_y, r.selector, r.clicks, r.members) for r in got) == sorted(want)


def daily(spark, *values):
    return spark.createDataFrame(
        [("s", date(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)], "site_id string, date date, visitors bigint")


def test_alerts_need_three_days_and_variance(spark):
    assert traffic.traffic_alerts(None, None, daily=daily(spark, 1, 100, 1)).count() == 0
    assert traffic.traffic_alerts(None, None, daily=daily(spark, 5, 5, 5, 500)).count() == 0
    [spike] = traffic.traffic_alerts(None, None, daily=daily(spark, 10, 12, 11, 50)).collect()
    assert (spike.type, spike.severity, spike.average, spike.change) == ("spike", "warning", 11, 355)
    assert spike.message == "Traffic spike: 50 visitors (avg: 11)"
    [drop] = traffic.traffic_alerts(None, None, daily=daily(spark, 10, 12, 11, 1)).collect()
    assert (drop.type, drop.severity) == ("drop", "error")


def test_error_alerts_only_report_spikes(spark):
    errors = daily(spark, 10, 12, 11, 1, 90).withColumnRenamed("visitors", "events")
    [spike] = traffic.error_alerts(errors).collect()
    assert spike.type == "error_spike" and spike.message == "Error spike: 90 events (avg: 9)"


def test_rollup_covers_periods_without_today():
    now = datetime(2024, 3, 10, 15)
    assert not traffic.covered_by_rollup(DateRange(datetime(2024, 3, 1), now), now)
    assert traffic.covered_by_rollup(DateRange(datetime(2024, 3, 1), datetime(2024, 3, 9)), now)


def test_kpi_from_zero(spark):
    e = events(spark, ("u", 0, "pageview", "/"), ("u", 2, "pageview", "/"))
    [k] = traffic.kpi_summary(e, sessionise_by_id(e), DateRange(T0, T0 + timedelta(days=1))).collect()
    assert (k.total_visitors, k.visitors_trend, k.avg_session_duration, k.pages_per_session) == (1, 100.0, "2m 0s", "2.00")
    assert k.bounce_rate == 0.0 and k.bounce_rate_trend == 0.0


def test_funnel_is_unordered_and_ordered_funnel_is_not(spark):
    steps = [("one", "pageview", "/1"), ("two", "click", None)]
    e = events(spark, ("u", 0, "click", "/x"), ("u", 1, "pageview", "/1"), ("v", 0, "pageview", "/1"), ("v", 1, "click", "/x"))
    loose = {r.step: r.visitors for r in conversion.funnel(e, YEAR, steps=steps).collect()}
    strict = {r.step: r.visitors for r in conversion.funnel_ordered(e, YEAR, steps=steps).collect()}
    assert loose == {"one": 2, "two": 2} and strict == {"one": 2, "two": 1}


def test_ordered_funnel_equals_event_by_event_rule(spark):
    rng = random.Random(5)
    steps = [("A", "pageview", "/a"), ("B", "pageview", "/b"), ("A again", "pageview", "/a"), ("Paid", "purchase", None)]
    rows = [(f"{i}", f"u{rng.randrange(60)}", rng.choice(["pageview", "pageview", "purchase"]), rng.choice(["/a", "/b", "/c"]),
             T0 + timedelta(minutes=rng.choice([0, 1, 30]) + 60 * rng.randrange(5))) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, user_id string, type string, path string, timestamp timestamp").withColumn("site_id", F.lit("s"))
    want = [0] * len(steps)
    for user in {r[1] for r in rows}:
        reached, since = 0, None
        for when in sorted({r[4] for r in rows if r[1] == user}):
            _, kind, path = steps[reached]
            if any(r[2] == kind and path in (None, r[3]) for r in rows if r[1] == user and r[4] == when):
                want[reached] += 1
                reached += 1
                if reached == len(steps):
                    break
    got = conversion.funnel_ordered(df, DateRange(T0, T0 + timedelta(days=1)), steps=steps).orderBy("step_no").collect()
    assert [r.visitors for r in got] == want and want[-1] > 0


def test_blank_labels_are_one_group(spark):
    e = events(spark, ("u", 0, "pageview", "/", {"device": ""}), ("u", 0, "pageview", "/"), ("v", 0, "pageview", "/", {"device": "Desktop"}))
    assert [(r.device, r.visitors, r.percentage) for r in audience.devices(e, YEAR).collect()] == [("Desktop", 2, 100)]


def test_unknown_event_types_and_missing_ids(spark):
    e = events(spark, ("u", 0, "nonsense", ""), ("", 0, "click", "/")).withColumn("props", F.lit(None).cast("string"))
    [clean] = ingest.ingest_clean(e).collect()
    assert (clean.type, clean.path, clean.device, clean.referrer) == ("custom", "/", "Desktop", None)
    assert ingest.ingest_rejects(e).first().reason == "no user_id"


def test_opt_out_needs_exactly_one(spark):
    df = spark.createDataFrame([("1", None), ("yes", "0"), (None, "1"), (None, None)], "dnt string, gpc string")
    assert ingest.opt_out_filter(df).count() == 2


def test_geo_only_fills_blanks(spark):
    ranges = spark.createDataFrame([(16777216, 16910000, "DE", None, "Berlin", 0.0, 0.0)], schemas.IP_RANGES)
    e = spark.createDataFrame(
        [("1", "1.1.1.1", "", ""), ("2", "1.1.1.1", "Spain", ""), ("3", "9.9.9.9", None, ""), ("4", "bad", "X", "Y")],
        "id string, ip string, country string, city string")
    got = {r.id: (r.country, r.city) for r in ingest.enrich_geo_ip(e, ranges).collect()}
    assert got == {"1": ("Germany", "Berlin"), "2": ("Spain", "Berlin"), "3": (None, ""), "4": ("X", "Y")}


def test_zone_table(spark, tmp_path):
    file = tmp_path / "zone.tab"
    file.write_text("# comment\nDE\t+5230+01322\tEurope/Berlin\tmost\nIN\t+2232+08822\tAsia/Kolkata\n")
    got = {r.timezone: r.country for r in ingest.read_zone_table(spark, str(file)).collect()}
    assert got == {"Europe/Berlin": "Germany", "Asia/Kolkata": "India"}


# ── search ──────────────────────────────────────────────────────────────────────────────────────

def test_empty_poll_changes_nothing(spark):
    raw = spark.createDataFrame([("s", "p", '{"id":"1","count":"3"}'), ("s", "q", '{"id":"2"}')], "site_id string, project_slug string, issue string")
    stored = issues.normalise_issues(raw).withColumn("stale", F.lit(False))
    nothing = issues.upsert_issues(stored, issues.normalise_issues(raw.limit(0)))
    assert [r.stale for r in nothing.collect()] == [False, False]
    again = {r.sentry_id: (r.stale, r.changed) for r in issues.upsert_issues(
        stored, issues.normalise_issues(raw.filter("project_slug = 'p'"))).collect()}
    assert again == {"1": (False, False), "2": (False, False)}
    other = raw.filter("project_slug = 'p'").withColumn("issue", F.lit('{"id":"9"}'))
    after = {r.sentry_id: (r.stale, r.changed) for r in issues.upsert_issues(stored, issues.normalise_issues(other)).collect()}
    assert after == {"1": (True, False), "2": (False, False), "9": (False, True)}


def test_issue_title_fallbacks_and_release(spark):
    docs = ['{"id":"1","metadata":{"type":"T"},"lastRelease":"1.2"}', '{"id":"2","title":"","metadata":{"value":"V","type":"T"},"lastRelease":{"version":"3"}}',
            '{"id":"3","isRegression":true,"isUnhandled":true}']
    df = spark.createDataFrame([("s", None, d) for d in docs], "site_id string, project_slug string, issue string")
    got = [(r.title, r.last_release, r.is_regression, r.is_unhandled) for r in issues.normalise_issues(df).orderBy("sentry_id").collect()]
    assert got == [("T", "1.2", False, False), ("V", "3", False, False), ("Unknown error", None, True, True)]


def observation(day, position, organic, ai=False, cited=False, features=(), citations=()):
    rows = [(p, d, f"https://{d}/{p}", None) for p, d in organic]
    quoted = [(i + 1, d, f"https://{d}/", None) for i, d in enumerate(citations)]
    return ("s", "shoes", "US", "desktop", T0 + timedelta(days=day), "me.com", position, None, ai, cited, rows, quoted, list(features), "serpapi")


OBSERVED = ("site_id string, keyword string, location string, device string, checked_at timestamp, domain string, position bigint, "
            f"url string, ai_overview boolean, is_cited boolean, organic {schemas.ORGANIC.simpleString()}, "
            f"citations {schemas.CITATIONS.simpleString()}, features array<string>, source string")


def diffs(spark, *observed):
    return search.serp_diff(search.rank_changes(spark.createDataFrame(list(observed), OBSERVED)))


BEFORE = observation(0, 3, [(1, "a.com"), (2, "b.com"), (3, "me.com"), (5, "c.com")])


def test_overtakers_and_features(spark):
    after = observation(7, 6, [(1, "c.com"), (2, "a.com"), (3, "new.com"), (4, "c.com"), (6, "me.com")],
                        features=["videos", "ai_overview", "people_also_ask"])
    first, second = diffs(spark, BEFORE, after).orderBy("checked_at").collect()
    assert first.overtaken_by == [] and first.citation_change == "unknown" and first.features_added == []
    assert [(o.domain, o.previous_position, o.position) for o in second.overtaken_by] == [("c.com", 5, 1), ("new.com", None, 3)]
    assert second.features_added == ["videos", "people_also_ask"] and second.position_change == -3


def test_search_alerts_texts(spark):
    after = observation(7, 12, [(1, "a.com"), (3, "c.com"), (12, "me.com")], ai=True, features=["videos"])
    got = {r.type: (r.severity, r.message) for r in search.search_alerts(diffs(spark, BEFORE, after)).collect()}
    assert got == {
        "page_one_exit": ("critical", "“shoes” fell off page one: #3 → #12. Now above you: c.com."),
        "ai_overview_appeared": ("warning", "Google now shows an AI answer for “shoes”, and it doesn't quote you.")}
    assert search.search_alerts(diffs(spark, BEFORE)).count() == 0


def test_alerts_are_stored_once_and_pruned(spark):
    after = observation(7, 12, [(12, "me.com")])
    fresh = search.search_alerts(diffs(spark, BEFORE, after))
    empty = fresh.withColumns({"created_at": F.col("checked_at"), "read_at": F.col("checked_at")}).limit(0)
    now = T0 + timedelta(days=10)
    stored = search.store_alerts(empty, fresh, now)
    assert stored.count() == 1 == search.store_alerts(stored, fresh, now).count()
    assert search.store_alerts(stored, fresh, now + timedelta(days=200)).count() == 0
    assert search.unread_count(stored).first().unread == 1


def weeks(spark, *totals, path="/p"):
    first = date(2026, 6, 1)
    rows = [("s", path, first + timedelta(days=7 * i + d), t // 7 + (t % 7 if d == 0 else 0)) for i, t in enumerate(totals) for d in range(7)]
    return spark.createDataFrame(rows, "site_id string, path string, date date, views bigint")


def test_weekly_change(spark):
    drop = explain.weekly_change(weeks(spark, 410, 500, 350, 70)).first()
    assert (drop.current_week, drop.previous_week, drop.change_pct, drop.direction, drop.significant) == (350, 500, -30.0, "drop", True)
    small = explain.weekly_change(weeks(spark, 3, 6, 1)).first()
    assert not small.significant and small.reason == "Change of 100% (3 views) is below the 15% / 20-view significance floor."
    one = explain.weekly_change(weeks(spark, 50)).first()
    assert (one.direction, one.previous_week, one.reason) == ("unknown", None, "Not enough weekly history to compare.")
    two = explain.weekly_change(weeks(spark, 0, 50)).first()
    assert (two.change_pct, two.direction) == (100.0, "spike")


def explained(spark, totals, observed, mapped=True, as_of=T0 + timedelta(days=8)):
    keywords = spark.createDataFrame([("s", "/p" if mapped else "/other", "shoes", "US", True)], schemas.PAGE_KEYWORDS)
    findings = explain.latest_findings(diffs(spark, *observed))
    return explain.explain_traffic(explain.weekly_change(weeks(spark, *totals)), findings, keywords, as_of).first()


def test_explains_a_drop_with_the_winner(spark):
    after = observation(7, 6, [(1, "c.com"), (2, "a.com"), (6, "me.com")])
    r = explained(spark, (410, 500, 350, 1), [BEFORE, after])
    assert r.explanation == ("Traffic to /p dropped 30% this week (500 → 350 views). Likely cause: rank slipped #3 → #6 on 'shoes', "
                             "with c.com moving above you.")
    assert r.confidence == "high" and r.cause_codes == ["rank_drop"] and r.caveats == []
    assert r.next_text == "Compare your page against c.com, which moved above you and now ranks #1 for this term."
    old = explained(spark, (410, 500, 350, 1), [BEFORE, after], as_of=T0 + timedelta(days=40))
    assert old.confidence == "medium" and "more than 14 days old" in old.caveats[0]


def test_explains_an_ai_answer(spark):
    same = [(1, "a.com"), (2, "b.com"), (3, "me.com"), (5, "c.com")]
    after = observation(7, 3, same, ai=True, citations=["a.com", "x.com"])
    r = explained(spark, (410, 500, 350, 1), [BEFORE, after])
    assert "Google's new AI answer box now quotes a.com and x.com instead of you" in r.explanation
    assert r.next_text.startswith("Compare your page against a.com, which now ranks #1 and is quoted in Google's AI answer — ")


def test_says_when_search_did_not_change(spark):
    r = explained(spark, (410, 500, 350, 1), [BEFORE, observation(7, 3, [(1, "a.com"), (2, "b.com"), (3, "me.com"), (5, "c.com")])])
    assert r.explanation.endswith("unchanged across 1 tracked keyword, so the cause is probably not search — "
                                  "check referrers, campaigns, or a recent deploy.")
    assert (r.confidence, r.next_action, r.cause_codes) == ("low", "look_beyond_search", ["unexplained_by_serp"])


def test_crowded_page_and_spike_advice(spark):
    same = [(1, "a.com"), (2, "b.com"), (3, "me.com"), (5, "c.com")]
    crowded = explained(spark, (410, 500, 350, 1), [BEFORE, observation(7, 3, same, features=["videos", "shopping"])])
    assert crowded.cause_codes == ["serp_feature_added"] and crowded.next_text.startswith("Google is now favouring video")
    assert "Google added a video carousel and shopping results to the results for 'shoes'" in crowded.explanation
    better = explained(spark, (200, 210, 420, 1), [BEFORE, observation(7, 1, [(1, "me.com")])])
    assert better.explanation == (
        "Traffic to /p rose 100% this week (210 → 420 views). Search position and AI answer status are unchanged across 1 tracked "
        "keyword, so the cause is probably not search — check referrers, campaigns, or a recent deploy.")
    far = observation(0, 9, [(9, "me.com")])
    gained = explained(spark, (200, 210, 420, 1), [far, observation(7, 2, [(2, "me.com")])])
    assert gained.cause_codes == ["rank_gain"] and gained.next_action == "reinforce"


def test_steady_unknown_and_unmapped_pages(spark):
    steady = explained(spark, (100, 100, 101, 1), [BEFORE], mapped=False)
    assert steady.explanation == ("Traffic to /p held roughly steady this week (100 → 101 views, +1%). No significant change to explain.")
    assert steady.confidence == "high" and steady.next_text is None
    assert steady.caveats == ["No target keywords are mapped to /p. Map one to get a search-side explanation."]
    new = explained(spark, (100,), [BEFORE])
    assert new.explanation == "Not enough weekly history for /p to compare week over week yet (90d window)."
    first = explained(spark, (410, 500, 350, 1), [BEFORE])
    assert first.caveats == ["This is the first rank snapshot for 'shoes', so there is no prior week to compare against."]


def test_more_than_two_features_in_a_sentence(spark):
    same = [(3, "me.com")]
    r = explained(spark, (410, 500, 350, 1), [observation(0, 3, same), observation(7, 3, same, features=["videos", "shopping", "knowledge_graph"])])
    assert "added a video carousel, shopping results, and a knowledge panel to" in r.explanation


def test_site_sql_sees_one_tenant(spark):
    def tables(session):
        return {"events": session.range(3000).selectExpr("if(id % 2 = 0, 'a', 'b') AS site_id", "id")}

    run = lambda text, **v: site_sql.site_sql(spark, text, "a", tables, v)
    assert [r.site_id for r in run("SELECT DISTINCT site_id FROM events").collect()] == ["a"]
    assert run("SELECT * FROM events LIMIT 5000").count() == 1000
    assert run("SELECT {{ site_id }} AS s, {{x}} AS x, {{none}} AS n", x="1' OR '1'='1").first() == ("a", "1' OR '1'='1", None)
    assert run("SELECT COUNT(*) AS c FROM events e JOIN events f ON e.id = f.id WHERE e.id < {{x}}", x=10).first().c == 5


def test_timing_summary_nearest_rank(spark):
    df = spark.createDataFrame([("q", float(v)) for v in range(1, 101)], "q string, ms double")
    r = timing_summary(df, ["q"]).first()
    assert (r.n, r.min, r.max, r.mean, r.median, r.p95, r.p99, r.stddev) == (100, 1.0, 100.0, 50.5, 50.0, 95.0, 99.0, 29.011)
