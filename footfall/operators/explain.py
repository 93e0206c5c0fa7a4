"""Why did a page's traffic change? Weekly change, search-side causes, and a sentence about both."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.functions.numbers import and_list, round_half_up, shown_number, top_per
from footfall.functions.urls import same_site
from footfall.operators.search import KEY, PAGE_ONE, RANK_MOVE, feature_name
from footfall.operators.traffic import direction

MIN_CHANGE_PCT, MIN_CHANGE_VIEWS = 15, 20
STALE_DAYS, MAX_KEYWORDS = 14, 5
_PAGE = ["site_id", "path"]


def weekly_change(
    daily: DataFrame, min_pct: float = MIN_CHANGE_PCT, min_views: int = MIN_CHANGE_VIEWS,
) -> DataFrame:
    """From daily page views (site_id, path, date, views): the last complete ISO week against the
    one before. The last week counts as incomplete when there are more than two."""
    weeks = daily.groupBy(*_PAGE, F.to_date(F.date_trunc("week", "date")).alias("week")).agg(
        F.sum("views").alias("views"))
    by_page = Window.partitionBy(*_PAGE)
    n = F.count("*").over(by_page)
    age = F.row_number().over(by_page.orderBy(F.col("week").desc())) - F.when(n > 2, 1).otherwise(0)
    pages = weeks.withColumn("_age", age).groupBy(*_PAGE).agg(
        F.coalesce(F.max(F.when(F.col("_age") == 1, F.col("views"))), F.lit(0)).alias("current_week"),
        F.max(F.when(F.col("_age") == 2, F.col("views"))).alias("previous_week"))
    now, then = F.col("current_week"), F.col("previous_week")
    change = now - then
    exact = F.when(then == 0, F.when(now > 0, 100.0).otherwise(0.0)).otherwise(
        change / F.nullif(then, F.lit(0)) * 100)
    known = then.isNotNull()
    significant = F.coalesce(
        (F.abs(exact) >= min_pct) & (F.abs(change) >= min_views), F.lit(False))
    below = F.concat(
        F.lit("Change of "), round_half_up(exact).cast("string"), F.lit("% ("), change.cast("string"),
        F.lit(f" views) is below the {min_pct}% / {min_views}-view significance floor."))
    return pages.withColumns({
        "change_abs": change,
        "change_pct": round_half_up(exact, 1),
        "direction": F.when(known, direction(change)).otherwise("unknown"),
        "significant": significant,
        "reason": F.when(~known, "Not enough weekly history to compare.").when(~significant, below),
    })


def spot(position: Column) -> Column:
    return F.coalesce(F.concat(F.lit("#"), position.cast("string")), F.lit("unranked"))


def _cause(code: str, *text: str | Column, features: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(code).alias("code"),
        F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("phrase"),
        (none if features is None else features).alias("features"))


def other_cited(citations: Column, domain: Column) -> Column:
    """Domains quoted in the AI answer other than the site's own."""
    domains = F.transform(citations, lambda c: c["domain"])
    return F.filter(domains, lambda d: d.isNotNull() & ~same_site(d, domain))


def attribute_causes(findings: DataFrame) -> DataFrame:
    """Adds `causes`: what changed in search for one keyword, in order of rank, AI answer, page
    features. Upside causes only count when explaining a spike, new features only for a drop."""
    keyword, way = F.col("keyword"), F.col("direction")
    was, now = F.col("previous_position"), F.col("position")
    moved = was - now
    dropped = F.coalesce(moved <= -RANK_MOVE, F.lit(False))
    rivals = F.transform(F.slice("overtaken_by", 1, 2), lambda o: o["domain"])
    passed = F.when(F.size(rivals) > 0, F.concat(
        F.lit(", with "), and_list(rivals), F.lit(" moving above you"))).otherwise("")
    on_one = F.coalesce(now <= PAGE_ONE, F.lit(False))
    off_one = (was <= PAGE_ONE) & ~on_one
    quoted = F.slice(other_cited(F.col("citations"), F.col("domain")), 1, 2)
    change = F.col("citation_change")

    def named(column: str) -> Column:
        return and_list(F.transform(column, feature_name))

    displaced = F.when(
        F.size(quoted) > 0,
        _cause("ai_overview_displacement", "Google's new AI answer box now quotes ", and_list(quoted), " instead of you"),
    ).otherwise(_cause(
        "ai_overview_displacement", "Google now shows an AI answer box for '", keyword, "' and it does not quote you"))
    spike = way == "spike"
    causes = [
        F.when(dropped, _cause(
            "rank_drop", "rank slipped ", spot(was), " → ", spot(now), " on '", keyword, "'", passed)),
        F.when(off_one, _cause(
            "page_one_exit", "you dropped off page one for '", keyword, "'",
            F.when(dropped, "").otherwise(passed))),
        F.when((change == "new_overview") & ~F.col("is_cited"), displaced),
        F.when(change == "lost", _cause(
            "ai_citation_lost", "you were dropped from Google's AI answer box for '", keyword, "'")),
        F.when((way == "drop") & on_one & (F.size("features_added") > 0), _cause(
            "serp_feature_added", "Google added ", named("features_added"), " to the results for '",
            keyword, "', pushing organic listings down", features=F.col("features_added"))),
        F.when(spike & on_one & (F.size("features_removed") > 0), _cause(
            "serp_feature_removed", "Google removed ", named("features_removed"), " from the results for '",
            keyword, "', lifting organic listings", features=F.col("features_removed"))),
        F.when(spike & (moved >= RANK_MOVE), _cause(
            "rank_gain", "rank improved ", spot(was), " → ", spot(now), " on '", keyword, "'")),
        F.when(spike & (change == "gained"), _cause(
            "ai_citation_gained", "Google's AI answer box for '", keyword, "' now quotes you")),
    ]
    return findings.withColumn("causes", F.array_compact(F.array(*causes)))


def pick_rival(findings: DataFrame) -> DataFrame:
    """Adds `rival`: the competitor above the site worth studying. One that just passed it and is
    quoted in the AI answer comes first, then one that passed, then one quoted, then the highest."""
    above = F.filter(F.slice("organic", 1, 10), lambda c: (
        c["domain"].isNotNull() & c["position"].isNotNull()
        & (F.col("position").isNull() | (c["position"] < F.col("position")))))
    prepared = findings.withColumns({
        "_cited": other_cited(F.col("citations"), F.col("domain")),
        "_passed": F.transform("overtaken_by", lambda o: o["domain"])})
    marked = F.transform(above, lambda c: F.struct(
        c["domain"].alias("domain"), c["url"].alias("url"), c["title"].alias("title"),
        c["position"].alias("position"),
        F.array_contains("_cited", c["domain"]).alias("also_cited"),
        F.array_contains("_passed", c["domain"]).alias("overtook")))

    def worth(c: Column) -> Column:
        """Smaller is better: passed and quoted, passed, quoted, neither; then the position."""
        return F.when(c["overtook"] & c["also_cited"], 1).when(c["overtook"], 2).when(
            c["also_cited"], 3).otherwise(4)

    ordered = F.array_min(F.transform(marked, lambda c, i: F.struct(
        worth(c).alias("worth"), i.alias("turn"), c.alias("rival"))))
    return prepared.withColumn("_best", ordered).withColumn("rival", F.col("_best.rival")).drop(
        "_best", "_cited", "_passed")


# Advice texts.
_BEYOND = ("Search looks unchanged, so check referrers, campaigns, and recent deploys before "
           "spending time on SEO.")
_REINFORCE = ("Whatever changed here is working — consider applying the same approach to similar "
              "pages.")
_ANSWER = ("Answer the searcher's question in a short paragraph or list near the top of the page — "
           "that is what Google lifts into snippets and 'People also ask'.")
_VIDEO = ("Google is now favouring video for this search — a short video on the page can win a spot "
          "in the carousel.")
_CROWDED = ("Your position held but the results page got busier, so expect fewer clicks at the same "
            "rank. Title and description are what earn the click now.")


def next_step(pages: DataFrame) -> DataFrame:
    """Adds `next_action` and `next_text` from the causes and keyword findings of a page."""
    codes = F.transform("causes", lambda c: c["code"])

    def fired(code: str) -> Column:
        return F.array_contains(codes, code)

    loser = F.try_element_at(F.filter("findings", lambda f: (
        F.coalesce(f["position_change"] < 0, F.lit(False))
        | f["citation_change"].isin("lost", "new_overview"))), F.lit(1))
    rival = loser["rival"]
    added = F.flatten(F.transform(
        F.filter("causes", lambda c: c["code"] == "serp_feature_added"), lambda c: c["features"]))
    rank = rival["position"].cast("string")
    by_answer = F.concat(
        F.lit("Compare your page against "), rival["domain"], F.lit(", which now ranks #"), rank,
        F.when(rival["also_cited"], " and is quoted in Google's AI answer").otherwise(""),
        F.lit(" — AI answers tend to quote pages that address the question directly and early."))
    by_rank = F.concat(
        F.lit("Compare your page against "), rival["domain"], F.lit(", which "),
        F.when(rival["overtook"], "moved above you and ").otherwise(""),
        F.lit("now ranks #"), rank, F.lit(" for this term."))

    def step(action: str, text: str | Column) -> Column:
        return F.struct(F.lit(action).alias("action"),
                        (F.lit(text) if isinstance(text, str) else text).alias("text"))

    crowded = loser.isNull() & fired("serp_feature_added")
    advice = (
        F.when(~F.col("significant"), None)
        .when(F.size("causes") == 0, step("look_beyond_search", _BEYOND))
        .when(F.col("direction") == "spike", step("reinforce", _REINFORCE))
        .when(crowded & F.arrays_overlap(added, F.array(F.lit("featured_snippet"), F.lit("people_also_ask"))),
              step("target_feature", _ANSWER))
        .when(crowded & F.array_contains(added, "videos"), step("target_feature", _VIDEO))
        .when(crowded, step("target_feature", _CROWDED))
        .when(rival.isNotNull(), step("study_rival", F.when(
            fired("ai_overview_displacement") | fired("ai_citation_lost"), by_answer).otherwise(by_rank))))
    return pages.withColumn("_step", advice).withColumns(
        {"next_action": F.col("_step.action"), "next_text": F.col("_step.text")}).drop("_step")


def latest_findings(changes: DataFrame) -> DataFrame:
    """The newest observation per site and keyword."""
    return top_per(changes, KEY, [F.col("checked_at").desc()], 1)


def chosen_keywords(keywords: DataFrame) -> DataFrame:
    """The (at most five) keywords that stand for a page, primary ones first."""
    return top_per(
        keywords.select(*_PAGE, "keyword", "location", "is_primary").distinct(), _PAGE,
        [F.col("is_primary").desc(), F.col("keyword").asc(), F.col("location").asc()], MAX_KEYWORDS)


def explain_traffic(
    traffic: DataFrame, findings: DataFrame, keywords: DataFrame, as_of: datetime, window: str = "90d",
) -> DataFrame:
    """One row per page of `weekly_change`: causes over its (at most five) keywords, a sentence, how
    sure it is, caveats and a next step. `findings` is the newest `serp_diff` row per keyword. All
    pages in one job; a page carries at most five findings."""
    chosen = chosen_keywords(keywords)
    matched = chosen.join(findings, ["site_id", "keyword", "location"]).join(
        traffic.select(*_PAGE, "direction"), _PAGE)
    judged = pick_rival(attribute_causes(matched))
    packed = judged.groupBy(*_PAGE).agg(F.sort_array(F.collect_list(F.struct(
        (~F.col("is_primary")).alias("o"), "keyword", "location", "position", "previous_position",
        "position_change", "citation_change",
        F.col("previous_checked_at").cast("timestamp_ntz").alias("observed"), "causes", "rival",
    ))).alias("findings"))
    mapped = chosen.groupBy(*_PAGE).agg(F.count("*").alias("tracked"))
    pages = traffic.join(mapped, _PAGE, "left").join(packed, _PAGE, "left").na.fill(0, ["tracked"])
    pages = pages.withColumn("findings", F.coalesce(
        "findings", F.array().cast(packed.schema["findings"].dataType)))
    pages = pages.withColumn("causes", F.when(F.col("significant"), F.flatten(
        F.transform("findings", lambda f: f["causes"]))).otherwise(
        F.array().cast("array<struct<code:string,phrase:string,features:array<string>>>")))
    return _worded(next_step(pages), as_of, window)


def _worded(pages: DataFrame, as_of: datetime, window: str) -> DataFrame:
    path, significant = F.col("path"), F.col("significant")
    views = F.concat(F.col("previous_week").cast("string"), F.lit(" → "), F.col("current_week").cast("string"))
    pct = F.col("change_pct")
    none = F.size("causes") == 0
    headline = F.concat(
        F.lit("Traffic to "), path, F.when(F.col("direction") == "drop", " dropped ").otherwise(" rose "),
        shown_number(F.abs(pct)), F.lit("% this week ("), views, F.lit(" views)."))
    checked = F.size("findings")
    across = F.when(checked > 0, F.concat(
        F.lit(" across "), checked.cast("string"), F.lit(" tracked keyword"),
        F.when(checked == 1, "").otherwise("s"))).otherwise("")
    unexplained = F.concat(
        headline, F.lit(" Search position and AI answer status are unchanged"), across,
        F.lit(", so the cause is probably not search — check referrers, campaigns, or a recent deploy."))
    explained = F.concat(
        headline, F.lit(" Likely cause: "), and_list(F.transform("causes", lambda c: c["phrase"])), F.lit("."))
    steady = F.concat(
        F.lit("Traffic to "), path, F.lit(" held roughly steady this week ("), views, F.lit(" views, "),
        F.when(pct >= 0, "+").otherwise(""), shown_number(pct),
        F.lit("%). No significant change to explain."))
    unknown = F.concat(
        F.lit("Not enough weekly history for "), path,
        F.lit(f" to compare week over week yet ({window} window)."))
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    oldest_ok = now - F.expr(f"INTERVAL {STALE_DAYS} DAYS")
    fresh = F.exists("findings", lambda f: F.coalesce(f["observed"] >= oldest_ok, F.lit(False)))
    confidence = (F.when(~significant, "high").when(none, "low").when(fresh, "high").otherwise("medium"))
    unmapped = F.when(F.col("tracked") == 0, F.concat(
        F.lit("No target keywords are mapped to "), path,
        F.lit(". Map one to get a search-side explanation.")))
    first_seen = F.transform(
        F.filter("findings", lambda f: f["previous_position"].isNull() & f["position"].isNotNull()),
        lambda f: F.concat(F.lit("This is the first rank snapshot for '"), f["keyword"],
                           F.lit("', so there is no prior week to compare against.")))
    stale = F.when(confidence == "medium", F.lit(
        f"The previous SERP snapshot is more than {STALE_DAYS} days old, so the rank change may not "
        "line up exactly with this week."))
    when_significant = F.when(significant, first_seen).otherwise(F.array().cast("array<string>"))
    caveats = F.concat(
        F.array_compact(F.array(unmapped)), when_significant, F.array_compact(F.array(stale)))
    codes = F.when(significant & none, F.array(F.lit("unexplained_by_serp"))).otherwise(
        F.transform("causes", lambda c: c["code"]))
    return pages.withColumns({
        "explanation": F.when(F.col("previous_week").isNull(), unknown).when(~significant, steady)
        .when(none, unexplained).otherwise(explained),
        "confidence": confidence, "caveats": caveats, "cause_codes": codes,
    })


def steady_page_score(pages: DataFrame, findings: DataFrame, keywords: DataFrame) -> DataFrame:
    """Pages without a significant change, scored by what their keywords ask for: AI quote lost 4,
    not quoted 3, rank loss 2, passed by a rival 1. The best keyword represents the page."""
    ai = F.when(~F.col("ai_overview") | F.col("is_cited"), 0).when(
        F.col("citation_change") == "lost", 4).otherwise(3)
    score = (
        ai + F.when(F.col("position_change") < 0, 2).otherwise(0)
        + F.when(F.size("overtaken_by") > 0, 1).otherwise(0))
    scored = findings.withColumn("score", score).select("site_id", "keyword", "location", "score")
    per_page = chosen_keywords(keywords).join(scored, ["site_id", "keyword", "location"])
    lead = per_page.groupBy(*_PAGE).agg(
        F.max("score").alias("score"), F.count("*").alias("_n"),
        F.min(F.struct((-F.col("score")).alias("s"), (~F.col("is_primary")).alias("o"), "keyword"))
        ["keyword"].alias("lead_keyword"))
    steady = pages.filter(~F.col("significant")).select(*_PAGE, "current_week")
    return steady.join(lead, _PAGE, "left").select(
        *_PAGE, "current_week", "lead_keyword", F.coalesce("score", F.lit(0)).alias("score"),
        F.greatest(F.coalesce("_n", F.lit(0)) - 1, F.lit(0)).alias("other_keywords"))
