"""Search-result pages: normalisation, positions, changes between checks, alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall import schemas
from footfall.functions.numbers import round_half_up, top_per
from footfall.functions.ordered import asof_join
from footfall.functions.urls import extract_domain, same_site

RANK_MOVE, PAGE_ONE = 3, 10
KEY = ["site_id", "keyword", "location", "device"]
# Result-page features that push organic results down, and how a text names them.
DISPLACING_FEATURES = {
    "featured_snippet": "a featured snippet",
    "people_also_ask": "a 'People also ask' box",
    "videos": "a video carousel",
    "shopping": "shopping results",
    "knowledge_graph": "a knowledge panel",
}
ALERT_RETENTION_DAYS, FEED_MAX, RELATED_MAX = 180, 200, 10


def _or_empty(array: Column, ddl: str) -> Column:
    return F.coalesce(array, F.array().cast(ddl))


def normalise_snapshots(raw: DataFrame) -> DataFrame:
    """Raw (keyword, location, device, fetched_at, page JSON) to organic results, AI-answer
    citations, related questions and searches, and the list of features present."""
    doc = F.col("_doc")

    def result(r: Column, position: Column, title: Column) -> Column:
        return F.struct(position.alias("position"), extract_domain(r["link"]).alias("domain"),
                        r["link"].alias("url"), title.alias("title"))

    def with_url(array: Column) -> Column:
        return F.filter(array, lambda r: F.coalesce(r["url"] != "", F.lit(False)))

    organic = with_url(F.transform(
        doc["organic_results"], lambda r: result(r, r["position"], r["title"])))
    ai = doc["ai_overview"]
    references = F.coalesce(ai["references"], ai["sources"])
    citations = with_url(F.transform(references, lambda r, i: result(
        r, F.coalesce(r["index"], i.cast("bigint") + 1), F.coalesce(r["title"], r["snippet"]))))
    questions = F.filter(
        F.transform(F.slice(doc["related_questions"], 1, RELATED_MAX), lambda q: F.struct(
            q["question"].alias("question"), q["snippet"].alias("snippet"),
            extract_domain(q["link"]).alias("source_domain"))),
        lambda q: F.coalesce(q["question"] != "", F.lit(False)))
    searches = F.filter(
        F.slice(doc["related_searches"], 1, RELATED_MAX),
        lambda r: F.coalesce(r["query"] != "", F.lit(False)))

    def part(name: str) -> Column:
        return F.get_json_object("page", f"$.{name}")

    def some(name: str) -> Column:
        return F.coalesce(F.json_array_length(part(name)) > 0, F.lit(False))

    features = F.array_compact(F.array(
        F.when(part("ai_overview").isNotNull(), F.lit("ai_overview")),
        F.when(part("answer_box").isNotNull(), F.lit("featured_snippet")),
        F.when(some("related_questions"), F.lit("people_also_ask")),
        F.when(part("knowledge_graph").isNotNull(), F.lit("knowledge_graph")),
        F.when(some("inline_videos"), F.lit("videos")),
        F.when(some("shopping_results"), F.lit("shopping")),
    ))
    return raw.withColumn("_doc", F.from_json("page", schemas.RAW_SERP)).select(
        "keyword", "location", "device", "fetched_at",
        _or_empty(organic, schemas.ORGANIC.simpleString()).alias("organic"),
        part("ai_overview").isNotNull().alias("has_ai_overview"),
        _or_empty(citations, schemas.CITATIONS.simpleString()).alias("citations"),
        _or_empty(questions, "array<struct<question:string,snippet:string,source_domain:string>>")
        .alias("people_also_ask"),
        _or_empty(searches, "array<struct<query:string,link:string>>").alias("related_searches"),
        features.alias("features"),
        F.when(doc["_source"] == "fixture", "fixture").otherwise("serpapi").alias("source"),
        doc["search_information"]["total_results"].alias("total_results"),
    )


def locate_domain(organic: Column, domain: Column) -> Column:
    """First organic result of the site (struct) or NULL; `domain` is a bare host."""
    return F.try_element_at(F.filter(organic, lambda r: same_site(r["domain"], domain)), F.lit(1))


def site_domain(domain: Column) -> Column:
    """The bare host of a site's configured domain."""
    return extract_domain(domain)


def observe_ranks(snapshots: DataFrame, keywords: DataFrame, sites: DataFrame) -> DataFrame:
    """Where each site stands for its tracked keywords in each snapshot. Keeps the parts of the
    snapshot that later comparisons need."""
    tracked = keywords.select("site_id", "keyword", "location").distinct().join(
        sites.select(F.col("id").alias("site_id"), site_domain(F.col("domain")).alias("domain")), "site_id")
    seen = snapshots.join(tracked, ["keyword", "location"])
    hit = locate_domain(F.col("organic"), F.col("domain"))
    cited = F.exists("citations", lambda c: same_site(c["domain"], F.col("domain")))
    return seen.withColumn("_hit", hit).select(
        *KEY, F.col("fetched_at").alias("checked_at"), "domain",
        F.col("_hit.position").alias("position"), F.col("_hit.url").alias("url"),
        F.col("has_ai_overview").alias("ai_overview"), cited.alias("is_cited"),
        "organic", "citations", "features", "source")


def rank_changes(observations: DataFrame) -> DataFrame:
    """Each observation beside the one before it of the same keyword. A keyword is checked at most
    hourly, so a group is bounded by time."""
    held = ["position", "ai_overview", "is_cited", "checked_at"]
    held += [c for c in ("organic", "features") if c in observations.columns]
    w = Window.partitionBy(*KEY).orderBy("checked_at")
    out = observations.withColumn("_p", F.lag(F.struct(*held)).over(w))
    for c in held:
        out = out.withColumn(f"previous_{c}", F.col("_p")[c])
    none = F.col("_p").isNull()
    was_cited, is_cited = F.col("previous_is_cited"), F.col("is_cited")
    change = (
        F.when(none, "unknown")
        .when(~F.col("previous_ai_overview") & F.col("ai_overview"), "new_overview")
        .when(was_cited & ~is_cited, "lost").when(~was_cited & is_cited, "gained")
        .otherwise("unchanged"))
    return out.withColumns({
        "has_previous": ~none,
        "position_change": F.col("previous_position") - F.col("position"),
        "citation_change": change,
    }).drop("_p")


_OVERTAKER = "struct<domain:string,url:string,previous_position:bigint,position:bigint>"


def serp_diff(changes: DataFrame) -> DataFrame:
    """Displacing features that appeared or vanished, and up to three domains that are above the
    site now and were not before. Without an earlier observation all lists are empty."""
    def displacing(array: Column) -> Column:
        kept = F.filter(array, lambda f: f.isin(list(DISPLACING_FEATURES)))
        return F.when(F.col("has_previous"), kept).otherwise(F.array().cast("array<string>"))

    position, before = F.col("position"), F.col("previous_position")
    rivals = F.filter("organic", lambda c: (
        c["domain"].isNotNull() & c["position"].isNotNull()
        & ~same_site(c["domain"], F.col("domain"))
        & (position.isNull() | (c["position"] < position))))
    first_of_domain = F.filter(
        F.col("_rivals"),
        lambda c, i: ~F.exists(F.slice("_rivals", F.lit(1), i), lambda o: o["domain"] == c["domain"]))

    def earlier(domain: Column) -> Column:
        same = F.filter("previous_organic", lambda o: o["domain"] == domain)
        return F.try_element_at(same, F.lit(1))["position"]

    shaped = F.transform(first_of_domain, lambda c: F.struct(
        c["domain"].alias("domain"), c["url"].alias("url"),
        earlier(c["domain"]).alias("previous_position"), c["position"].alias("position")))
    passed = F.filter(shaped, lambda c: c["previous_position"].isNull() | (c["previous_position"] > before))
    overtaken = F.when(before.isNotNull(), F.slice(passed, 1, 3)).otherwise(F.array().cast(f"array<{_OVERTAKER}>"))
    return (
        changes.withColumn("_rivals", rivals)
        .withColumns({
            "features_added": displacing(F.array_except("features", "previous_features")),
            "features_removed": displacing(F.array_except("previous_features", "features")),
            "overtaken_by": overtaken,
        }).drop("_rivals", "previous_organic", "previous_features"))


def place(position: Column) -> Column:
    return F.coalesce(F.concat(F.lit("#"), position.cast("string")), F.lit("not ranking"))


def search_alerts(changes: DataFrame) -> DataFrame:
    """Alerts from consecutive observations: at most one each about rank, AI answer and features.
    The first observation of a keyword raises none. Feature and rival columns are optional."""
    was, now = F.col("previous_position"), F.col("position")
    quoted = F.concat(F.lit("“"), F.col("keyword"), F.lit("”"))
    move = F.concat(place(was), F.lit(" → "), place(now))
    full = "overtaken_by" in changes.columns
    names = F.transform(F.slice("overtaken_by", 1, 2), lambda o: o["domain"]) if full else None
    above = F.lit("") if not full else F.when(F.size(names) > 0, F.concat(
        F.lit(" Now above you: "), F.array_join(names, ", "), F.lit("."))).otherwise("")

    def on_page_one(p: Column) -> Column:
        return F.coalesce(p <= PAGE_ONE, F.lit(False))

    def alert(kind: str, severity: str, *text: str | Column) -> Column:
        message = F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text])
        return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), message.alias("message"))

    def text(c: Column) -> Column:
        return c.cast("string")

    rank = (
        F.when(on_page_one(was) & ~on_page_one(now),
               alert("page_one_exit", "critical", quoted, " fell off page one: ", move, ".", above))
        .when(was.isNotNull() & now.isNull(),
              alert("ranking_lost", "critical", quoted, " no longer ranks (was ", place(was), ").", above))
        .when(now - was >= RANK_MOVE,
              alert("rank_drop", "warning", quoted, " dropped ", text(now - was), " places: ", move, ".", above))
        .when(~on_page_one(was) & on_page_one(now),
              alert("page_one_entry", "positive", quoted, " reached page one: ", move, "."))
        .when(was.isNull() & now.isNotNull(),
              alert("ranking_found", "positive", quoted, " now ranks at ", place(now), "."))
        .when(was - now >= RANK_MOVE,
              alert("rank_gain", "positive", quoted, " climbed ", text(was - now), " places: ", move, ".")))
    was_cited, cited = F.col("previous_is_cited"), F.col("is_cited")
    answer = (
        F.when(was_cited & ~cited, alert(
            "ai_citation_lost", "warning", "Google's AI answer for ", quoted, " no longer quotes you."))
        .when(~was_cited & cited, alert(
            "ai_citation_gained", "positive", "Google's AI answer for ", quoted, " now quotes you."))
        .when(~F.col("previous_ai_overview") & F.col("ai_overview") & ~cited, alert(
            "ai_overview_appeared", "warning", "Google now shows an AI answer for ", quoted,
            ", and it doesn't quote you.")))
    found = [rank, answer]
    if "features_added" in changes.columns:
        added = F.transform("features_added", feature_name)
        found.append(F.when(on_page_one(now) & (F.size(added) > 0), alert(
            "serp_feature_added", "warning", "Google added ", F.array_join(added, " and "),
            " to the results for ", quoted, " — expect fewer clicks at the same rank.")))
    return changes.filter("has_previous").select(
        *KEY, "checked_at", was.alias("previous_position"), now.alias("position"),
        F.explode(F.array_compact(F.array(*found))).alias("a"),
    ).select(*KEY, "checked_at", "previous_position", "position", "a.*")


def feature_name(code: Column) -> Column:
    return F.coalesce(*[F.when(code == c, n) for c, n in DISPLACING_FEATURES.items()])


def store_alerts(stored: DataFrame, fresh: DataFrame, as_of: datetime) -> DataFrame:
    """Stored and new alerts, one per observation and type, of the last 180 days."""
    key = [*KEY, "checked_at", "type"]
    new = fresh.join(stored.select(*key), key, "left_anti").withColumns(
        {"created_at": F.col("checked_at"), "read_at": F.lit(None).cast(stored.schema["read_at"].dataType)})
    oldest = (as_of - timedelta(days=ALERT_RETENTION_DAYS)).isoformat(sep=" ")
    return stored.unionByName(new).filter(
        F.col("created_at") >= F.lit(oldest).cast(stored.schema["created_at"].dataType))


def alert_feed(alerts: DataFrame, keywords: DataFrame, limit: int = 50, unread_only: bool = False) -> DataFrame:
    """Newest alerts per site (1..200) with the pages mapped to each keyword."""
    rows = alerts.filter("read_at IS NULL") if unread_only else alerts
    newest = top_per(rows, ["site_id"], [
        F.col("created_at").desc(), *[F.col(c).asc_nulls_last() for c in ("keyword", "location", "device", "type")],
    ], min(max(limit, 1), FEED_MAX))
    pages = keywords.groupBy("site_id", "keyword", "location").agg(
        F.sort_array(F.collect_set("path")).alias("paths"))
    return newest.join(pages, ["site_id", "keyword", "location"], "left").withColumns({
        "paths": F.coalesce("paths", F.array().cast("array<string>")),
        "read": F.col("read_at").isNotNull(),
    }).drop("read_at")


def unread_count(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("site_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


def rank_history_series(observations: DataFrame, limit: int = 90) -> DataFrame:
    """The latest observations per keyword; `n` counts them from the oldest."""
    kept = top_per(observations, KEY, [F.col("checked_at").desc()], limit)
    w = Window.partitionBy(*KEY).orderBy("checked_at")
    return kept.select(
        *KEY, "checked_at", "position", "ai_overview", "is_cited", F.row_number().over(w).alias("n"))


def freshest_snapshot(snapshots: DataFrame, as_of: datetime, max_age_hours: int = 24) -> DataFrame:
    """The newest snapshot per keyword, place and device that is young enough to reuse."""
    kind = snapshots.schema["fetched_at"].dataType
    oldest = F.lit((as_of - timedelta(hours=max_age_hours)).isoformat(sep=" ")).cast(kind)
    key = ["keyword", "location", "device"]
    return top_per(snapshots.filter(F.col("fetched_at") > oldest), key, [F.col("fetched_at").desc()], 1)


def rank_as_of(rows: DataFrame, observations: DataFrame, time: str = "timestamp", max_age_days: int | None = None) -> DataFrame:
    """Rows of (site, keyword, time) with the position that was last observed by then, and when; with
    `max_age_days` only if that was not longer ago."""
    found = asof_join(rows, observations, ["site_id", "keyword"], {"position": "position", "observed_at": "checked_at"},
                      time, "checked_at", ["location", "device"], "month")
    if max_age_days is None:
        return found
    young = F.datediff(F.col(time), "observed_at") <= max_age_days
    return found.withColumns({c: F.when(young, F.col(c)) for c in ("position", "observed_at")})


# Default and limits of a site's checking budget.
BUDGET = {"min_hours": (24, 1, 720), "max_per_run": (10, 1, 100)}


def with_budget(sites: DataFrame) -> DataFrame:
    """Effective `min_hours` and `max_per_run`: stored values within their limits, else defaults."""
    return sites.withColumns({
        name: F.least(F.greatest(F.coalesce(F.col(name), F.lit(default)), F.lit(low)), F.lit(high))
        for name, (default, low, high) in BUDGET.items()})


def keywords_due(
    keywords: DataFrame, sites: DataFrame, history: DataFrame, as_of: datetime, limit: int | None = None,
) -> DataFrame:
    """Keywords to check now: never checked or not within the site's `min_hours`, oldest first, at
    most `max_per_run` per site and `limit` in all. `sites` has (id, domain, has_key, min_hours,
    max_per_run); sites without key or domain are skipped, after they took their turn."""
    key = ["site_id", "keyword", "location"]
    tracked = keywords.groupBy(*key).agg(F.min("path").alias("path"))
    checked = history.groupBy(*key).agg(F.max("checked_at").alias("last_checked"))
    known = with_budget(sites).withColumnRenamed("id", "site_id")
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    cutoff = now - F.make_dt_interval(hours=F.col("min_hours").cast("int"))
    due = tracked.join(known, "site_id").join(checked, key, "left").filter(
        F.col("last_checked").isNull() | (F.col("last_checked").cast("timestamp_ntz") < cutoff))
    age = [F.col("last_checked").asc_nulls_first(), *[F.col(k).asc() for k in key]]
    if limit is not None:
        due = due.orderBy(*age).limit(limit)
    turn = F.row_number().over(Window.partitionBy("site_id").orderBy(*age))
    domain = site_domain(F.col("domain"))
    return due.withColumn("turn", turn).filter(
        (F.col("turn") <= F.col("max_per_run")) & F.col("has_key") & domain.isNotNull()
    ).select(*key, "path", domain.alias("domain"), "last_checked", "turn")


def rank_budget(keywords: DataFrame, sites: DataFrame) -> DataFrame:
    """Tracked keywords per site and the checks per month they cost at the site's pace."""
    counted = keywords.groupBy("site_id").agg(F.countDistinct("keyword", "location").alias("keywords"))
    known = with_budget(sites).select(F.col("id").alias("site_id"), "min_hours", "max_per_run")
    joined = known.join(counted, "site_id", "left").na.fill(0, ["keywords"])
    return joined.withColumn("checks_per_month", round_half_up(
        F.col("keywords") * (F.lit(24.0) / F.col("min_hours")) * 30))
