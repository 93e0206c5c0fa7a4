"""The external error tracker's feed: issues, daily counts, single error events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall import schemas
from footfall.functions.classify import filled
from footfall.functions.numbers import top_per
from footfall.operators.traffic import period_rows
from footfall.functions.ranges import for_site

MAX_FRAMES, MAX_CRUMBS, MAX_TAGS = 100, 20, 30


def _first_text(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def normalise_issues(raw: DataFrame) -> DataFrame:
    """Raw (site_id, project_slug, issue JSON) to issue rows."""
    i = F.col("_i")
    meta = i["metadata"]
    release = F.get_json_object("issue", "$.lastRelease.version")
    release = _first_text(release, F.when(~i["lastRelease"].startswith("{"), i["lastRelease"]))

    def text(c: Column, default: str, limit: int) -> Column:
        return F.substring(F.coalesce(_first_text(c), F.lit(default)), 1, limit)

    def number(c: Column) -> Column:
        return F.coalesce(c.try_cast("bigint"), F.lit(0))

    return raw.withColumn("_i", F.from_json("issue", schemas.RAW_ISSUE)).select(
        F.concat_ws(":", "site_id", i["id"]).alias("issue_id"), "site_id",
        i["id"].alias("sentry_id"), _first_text(i["shortId"]).alias("short_id"),
        text(_first_text(i["title"], meta["value"], meta["type"]), "Unknown error", 1000).alias("title"),
        text(i["culprit"], "", 500).alias("culprit"),
        text(i["level"], "error", 16).alias("level"),
        text(i["status"], "unresolved", 16).alias("status"),
        F.coalesce(i["isUnhandled"], meta["isUnhandled"], F.lit(False)).alias("is_unhandled"),
        number(i["count"]).alias("count"), number(i["userCount"]).alias("user_count"),
        _first_text(i["permalink"]).alias("permalink"),
        _first_text(F.col("project_slug")).alias("project_slug"),
        (F.coalesce(i["substatus"] == "regressed", F.lit(False))
         | F.coalesce(i["isRegression"], F.lit(False))).alias("is_regression"),
        F.substring(release, 1, 255).alias("last_release"),
        i["firstSeen"].try_cast("timestamp_ntz").alias("first_seen"),
        i["lastSeen"].try_cast("timestamp_ntz").alias("last_seen"),
    )


def upsert_issues(stored: DataFrame, polled: DataFrame) -> DataFrame:
    """Stored issues after a poll. Polled rows replace stored ones and are fresh; stored rows of a
    polled project that the poll does not list become stale; projects without any polled row stay
    as they are. `changed` marks new rows and rows whose meaning changed."""
    columns = [c for c in polled.columns if c != "issue_id"]
    key = ["site_id", F.coalesce("project_slug", F.lit("")).alias("_project")]
    covered = polled.select(*key).distinct().withColumn("_covered", F.lit(True))
    old = stored.select("issue_id", "stale", F.struct(*columns).alias("_old"))
    new = polled.select("issue_id", F.struct(*columns).alias("_new"))
    both = old.join(new, "issue_id", "full_outer")
    row = F.coalesce("_new", "_old")
    differs = F.col("_old").isNull()
    for c in ("count", "status", "is_regression", "last_seen"):
        differs |= ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    merged = both.select(
        "issue_id", row.alias("_row"), F.col("_new").isNotNull().alias("_listed"),
        F.coalesce("stale", F.lit(False)).alias("_was_stale"),
        (F.col("_new").isNotNull() & differs).alias("changed"),
    ).select("issue_id", "_row.*", "_listed", "_was_stale", "changed").withColumn(
        "_project", F.coalesce("project_slug", F.lit("")))
    marked = merged.join(covered, ["site_id", "_project"], "left")
    stale = F.when(F.col("_listed"), False).when(F.col("_covered"), True).otherwise(F.col("_was_stale"))
    return marked.withColumn("stale", stale).select("issue_id", *columns, "stale", "changed")


#: The end of the year 9999 in unix seconds; a time beyond it is no time.
LAST_SECOND = 253_402_300_799


def daily_issue_counts(raw: DataFrame) -> DataFrame:
    """Raw (site_id, project_slug, JSON list of [unix seconds, count]) to counts per day. Numbers that are
    no time or no 64-bit count are NULL."""
    pairs = F.from_json("stats", "array<array<double>>")
    long = raw.select("site_id", F.coalesce("project_slug", F.lit("")).alias("project_slug"),
                      F.explode(pairs).alias("p")).filter(F.size("p") >= 2)
    seconds = F.col("p")[0].try_cast("bigint")
    day = F.to_date(F.timestamp_seconds(F.when(seconds.between(0, LAST_SECOND), seconds)))
    daily = long.groupBy("site_id", "project_slug", day.alias("date")).agg(
        F.coalesce(F.sum(F.col("p")[1].try_cast("bigint")), F.lit(0)).alias("events"))
    return daily.withColumn(
        "stat_id", F.concat_ws(":", "site_id", "project_slug", F.col("date").cast("string")))


def flatten_events(raw: DataFrame) -> DataFrame:
    """Raw (site_id, event JSON) to message, tags (30), stack frames (100), last 20 breadcrumbs."""
    e = F.col("_e")

    def values_of(kind: str) -> Column:
        hit = F.try_element_at(F.filter(e["entries"], lambda x: x["type"] == kind), F.lit(1))
        return hit["data"]["values"]

    exceptions, crumbs = F.col("_exceptions"), F.col("_crumbs")
    frames = F.flatten(F.transform(exceptions, lambda v: F.coalesce(
        v["stacktrace"]["frames"], F.array().cast("array<struct<filename:string,absPath:string,"
                                                  "function:string,lineNo:bigint,inApp:boolean>>"))))
    shaped = F.transform(frames, lambda f: F.struct(
        F.coalesce(_first_text(f["filename"], f["absPath"]), F.lit("")).alias("filename"),
        F.coalesce(f["function"], F.lit("")).alias("function"), f["lineNo"].alias("line_no"),
        F.coalesce(f["inApp"], F.lit(False)).alias("in_app")))
    last = F.slice(crumbs, F.greatest(F.size(crumbs) - MAX_CRUMBS + 1, F.lit(1)), MAX_CRUMBS)
    trail = F.transform(last, lambda b: F.struct(
        b["timestamp"].alias("timestamp"), F.coalesce(b["category"], F.lit("")).alias("category"),
        F.coalesce(b["level"], F.lit("")).alias("level"),
        F.substring(F.coalesce(b["message"], F.lit("")), 1, 300).alias("message")))
    first = F.try_element_at(exceptions, F.lit(1))

    def listed(c: Column, size: int) -> Column:
        return F.slice(F.coalesce(c, F.filter(c, lambda _: F.lit(False))), 1, size)

    parsed = raw.withColumn("_e", F.from_json("event", schemas.RAW_ISSUE_EVENT)).withColumns(
        {"_exceptions": values_of("exception"), "_crumbs": values_of("breadcrumbs")})
    return parsed.select(
        "site_id", _first_text(e["eventID"], e["id"]).alias("event_id"),
        F.coalesce(_first_text(e["message"], e["title"]), F.lit("")).alias("message"),
        e["dateCreated"].alias("date_created"), e["platform"].alias("platform"),
        listed(e["tags"], MAX_TAGS).alias("tags"),
        first["type"].alias("exception_type"), first["value"].alias("exception_value"),
        listed(shaped, MAX_FRAMES).alias("frames"), trail.alias("breadcrumbs"),
    )


def _live(issues: DataFrame, period, site_id) -> DataFrame:
    return period_rows(issues, period, site_id, "last_seen").filter(
        ~F.coalesce("stale", F.lit(False)))


def issue_list(issues, period, site_id=None, limit=100) -> DataFrame:
    """Live issues seen in the period: regressions first, then the latest, then the most frequent."""
    order = [F.coalesce("is_regression", F.lit(False)).desc(), F.col("last_seen").desc(),
             F.col("count").desc(), F.col("issue_id").asc()]
    top = top_per(_live(issues, period, site_id), ["site_id"], order, limit)
    return top.select(
        "site_id", "sentry_id", filled("short_id", "").alias("short_id"),
        filled("title", "Unknown error").alias("title"), filled("culprit", "").alias("culprit"),
        filled("level", "error").alias("level"), filled("status", "unresolved").alias("status"),
        F.coalesce("is_unhandled", F.lit(False)).alias("is_unhandled"), "count", "user_count",
        "permalink", F.col("project_slug").alias("project"),
        F.coalesce("is_regression", F.lit(False)).alias("is_regression"), "last_release",
        "first_seen", "last_seen")


def issue_summary(issues, period, site_id=None) -> DataFrame:
    level = F.col("level")
    return _live(issues, period, site_id).groupBy("site_id").agg(
        F.count("*").alias("total_issues"),
        F.count_if(F.col("status") == "unresolved").alias("unresolved"),
        F.count_if(F.col("is_regression")).alias("regressions"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("user_count"), F.lit(0)).alias("users_affected"),
        *[F.count_if(level == name).alias(name) for name in ("fatal", "error", "warning")])


def issue_trend(stats, period, site_id=None) -> DataFrame:
    days = F.col("date").between(F.lit(period.start.date()), F.lit(period.end.date()))
    return for_site(stats.filter(days), site_id).groupBy("site_id", "date").agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"))
