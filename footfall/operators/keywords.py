"""Search phrases for pages: from the URL path, from traffic, from related searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from footfall.functions.numbers import desc_then, present, top_per
from footfall.operators.traffic import page_search_terms, period_rows, top_pages

# Words of a path that carry no topic (file types included).
STOP_WORDS = [
    "a", "an", "the", "and", "or", "for", "to", "of", "in", "on", "at", "by", "with", "blog", "post", "posts",
    "article", "articles", "page", "pages", "guide", "guides", "docs", "doc", "tutorial", "tutorials", "how",
    "what", "why", "index", "html", "php", "en", "us", "www", "v1", "v2", "amp", "pdf", "doc", "docx", "ppt",
    "pptx", "xls", "xlsx", "zip", "txt", "csv",
]
# Last path segments that are application routes, not content.
APP_ROUTES = [
    "login", "logout", "signin", "sign-in", "signup", "sign-up", "register", "dashboard", "account", "settings",
    "profile", "admin", "search", "cart", "checkout", "privacy", "terms", "reset-password", "forgot-password",
    "404", "contact", "contact-me", "contactus", "contact-us", "about", "about-us", "nous-contacter",
    "contactez-nous", "kontakt", "contacto", "contatti", "impressum", "sitemap", "rss", "feed", "thanks",
    "thank-you",
]
# Words too general to stand alone.
GENERIC_WORDS = [
    "notes", "note", "module", "modules", "subject", "subjects", "sem", "semester", "year", "unit", "units",
    "chapter", "chapters", "part", "papers", "paper", "question", "questions", "file", "files", "folder",
    "download", "downloads", "material", "materials", "book", "books", "lab", "labs", "assignment",
    "assignments", "syllabus", "merged", "new", "old", "final", "misc", "other", "others", "temp", "test",
]
# Words of a person's name in a file name.
HONORIFICS = ["ma", "am", "sir", "madam", "mam", "maam", "by", "prof", "dr"]
MIN_LENGTH, MAX_LENGTH, MAX_SUGGESTIONS = 3, 200, 8


def with_phrase(df: DataFrame, path: str = "path", name: str = "phrase") -> DataFrame:
    """Adds the search phrase of a URL path, NULL when the path names no topic. Built in steps,
    each a column of its own, so that no step is computed twice."""
    bare = F.substring_index(F.substring_index(path, "?", 1), "#", 1)
    raw = F.coalesce(F.try_url_decode(bare), bare)
    segments = F.filter(F.split(raw, "/"), lambda s: (s != "") & ~s.rlike(r"^\d+:?$"))
    last = F.regexp_replace(F.try_element_at(segments, F.lit(-1)), r"(?i)\.[a-z0-9]{1,5}$", "")
    parts = F.transform(F.split("_last", r"[-_+.\s]+"), lambda w: F.regexp_replace(
        F.trim(F.lower(w)), r"^[(\[{]+|[)\]}]+$", ""))
    words = F.filter(parts, lambda w: (w != "") & ~w.isin(STOP_WORDS) & ~w.rlike(r"^\d+$"))
    n, short, titles = F.size("_words"), F.col("_short"), F.col("_titles")
    file_name = (short >= 2) | ((n <= 2) & (short >= 1)) | (titles >= 2)
    folder = (n == 1) & F.try_element_at("_words", F.lit(1)).isin(GENERIC_WORDS)
    usable = (n > 0) & ~F.trim(F.lower("_last")).isin(APP_ROUTES) & ~file_name & ~folder
    return (
        df.withColumn("_last", last).withColumn("_words", words)
        .withColumns({
            "_short": F.size(F.filter("_words", lambda w: F.length(w) <= 2)),
            "_titles": F.size(F.filter("_words", lambda w: w.isin(HONORIFICS)))})
        .withColumn(name, F.when(F.coalesce(usable, F.lit(False)), F.array_join("_words", " ")))
        .drop("_last", "_words", "_short", "_titles"))


def page_phrases(pages: DataFrame) -> DataFrame:
    """Phrase per (site_id, path); each distinct page is looked at once."""
    return with_phrase(pages.select("site_id", "path").distinct())


def _suggestion(rows: DataFrame, step: int, position, keyword, source, confidence, reason) -> DataFrame:
    return rows.select(
        "site_id", "path", F.lit(step).alias("_step"), position.alias("_position"),
        F.trim(keyword).alias("keyword"), F.lit(source).alias("source"),
        F.lit(confidence).alias("confidence"), reason.alias("reason"))


def keyword_suggestions(
    events, mapped: DataFrame, period, snapshots: DataFrame | None = None, site_id=None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """Up to eight keyword proposals per page: search terms of its visitors, its path phrase and,
    with `snapshots` (newest per keyword), related searches and questions for that phrase. Of all
    pages seen in the period, or of the distinct (site_id, path) in `pages` alone."""
    terms = page_search_terms(events, period, site_id).filter("keyword <> '(not set)'")
    if pages is None:
        pages = period_rows(events, period, site_id).select("site_id", "path").distinct()
    else:
        terms = terms.join(pages.select("site_id", "path"), ["site_id", "path"], "left_semi")
    phrases = present(page_phrases(pages), "phrase")
    turn = F.row_number().over(
        Window.partitionBy("site_id", "path").orderBy(*desc_then("visitors", "keyword")))
    arrived = F.concat(
        F.col("visitors").cast("string"), F.lit(" visitor"),
        F.when(F.col("visitors") == 1, "").otherwise("s"), F.lit(" arrived on this search term"))
    found = _suggestion(
        terms.withColumn("_turn", turn), 1, F.col("_turn"), F.col("keyword"), "traffic", "high", arrived
    ).unionByName(_suggestion(
        phrases, 2, F.lit(1), F.col("phrase"), "path", "medium", F.lit("Derived from the page URL")))
    if snapshots is not None:
        related = phrases.join(snapshots, phrases["phrase"] == snapshots["keyword"])
        lists = [
            (3, "related_searches", "query", 5, "medium", "A related search Google shows for this topic"),
            (4, "people_also_ask", "question", 3, "low", "A question people also ask about this topic"),
        ]
        for step, column, field, size, confidence, reason in lists:
            long = related.select("site_id", "path", F.posexplode(F.slice(column, 1, size)).alias("_i", "r"))
            found = found.unionByName(_suggestion(
                long, step, F.col("_i"), F.col(f"r.{field}"), "serp", confidence, F.lit(reason)))
    low = F.lower("keyword")
    fitting = found.withColumn("_key", low).filter(F.length("_key").between(MIN_LENGTH, MAX_LENGTH))
    taken = mapped.select("site_id", "path", F.lower("keyword").alias("_key")).distinct()
    free = fitting.join(taken, ["site_id", "path", "_key"], "left_anti")
    order = [F.col("_step").asc(), F.col("_position").asc()]
    once = top_per(free, ["site_id", "path", "_key"], order, 1)
    rank = F.row_number().over(Window.partitionBy("site_id", "path").orderBy(*order))
    best = top_per(once, ["site_id", "path"], order, MAX_SUGGESTIONS)
    return best.withColumn("rank", rank).drop("_step", "_position", "_key")


def site_suggestions(events, mapped: DataFrame, period, limit=5, busiest=25) -> DataFrame:
    """Suggestions for the busiest pages without a keyword: per site the first `limit` of its
    `busiest` pages that get any. The home page has no single topic."""
    top = top_pages(events, period, limit=busiest).select("site_id", "path", "views")
    open_pages = top.filter("path <> '/'").join(
        mapped.select("site_id", "path").distinct(), ["site_id", "path"], "left_anti")
    proposals = keyword_suggestions(events, mapped, period, pages=open_pages)
    with_any = open_pages.join(
        proposals.select("site_id", "path").distinct(), ["site_id", "path"], "left_semi")
    chosen = top_per(with_any, ["site_id"], desc_then("views", "path"), limit)
    return chosen.join(proposals, ["site_id", "path"])
