"""Seeded, skewed visitor events of any size for scale tests: every row is a function of its number."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Labels and weights of the generated columns.
SITES = {"bench_site_a": 70, "bench_site_b": 20, "bench_site_c": 10}
PAGES = {
    "/": 280, "/pricing": 140, "/docs": 90, "/blog": 80, "/features": 70, "/about": 45, "/signup": 40,
    "/login": 35, "/contact": 25, "/changelog": 20, "/blog/getting-started": 18,
    "/blog/analytics-101": 16, "/docs/api": 14, "/docs/install": 12, "/integrations": 10,
    "/security": 9, "/careers": 7, "/terms": 5, "/privacy": 4, "/status": 3,
}
REFERRERS = {
    "": 420, "https://google.com": 220, "https://news.ycombinator.com": 90, "https://reddit.com": 70,
    "https://twitter.com": 55, "https://linkedin.com": 40, "https://github.com": 35,
    "https://bing.com": 25, "https://duckduckgo.com": 20, "https://producthunt.com": 15,
}
TYPES = {
    "pageview": 520, "click": 170, "scroll_depth": 110, "web_vital": 80, "heatmap_click": 60,
    "js_error": 30, "form_submit": 20, "purchase": 10,
}
DEVICES = {"Desktop": 55, "Mobile": 38, "Tablet": 7}
BROWSERS = {"Chrome": 62, "Safari": 20, "Firefox": 9, "Edge": 7, "Opera": 2}
SYSTEMS = {"macOS": 30, "Windows": 34, "iOS": 16, "Android": 14, "Linux": 6}
COUNTRIES = {
    "United States": 300, "India": 150, "Germany": 90, "United Kingdom": 85, "Canada": 60,
    "France": 45, "Brazil": 40, "Japan": 35, "Australia": 30, "Netherlands": 25,
}
UTM_SOURCES = {"": 560, "google": 160, "newsletter": 90, "twitter": 70, "producthunt": 60, "partner": 40}
UTM_MEDIUMS = {"": 560, "cpc": 150, "email": 110, "social": 100, "referral": 60}
UTM_CAMPAIGNS = {"": 600, "launch": 130, "spring_sale": 110, "retargeting": 90, "brand": 70}
END, DAYS, ROWS_PER_VISITOR, SESSION_ROWS = datetime(2026, 1, 1), 90, 12, 4


def _uniform(key: Column, seed: int, salt: str) -> Column:
    """A number in [0, 1) that depends only on key, seed and salt."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def weighted(key: Column, seed: int, salt: str, weights: dict[str, int]) -> Column:
    u, total, reached, chain = _uniform(key, seed, salt), sum(weights.values()), 0, None
    labels = list(weights)
    for label in labels[:-1]:
        reached += weights[label]
        test = u < reached / total
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(labels[-1])


def synth_events(spark: SparkSession, count: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """`count` events of 90 days: sites 70/20/10 %, few pages with most views, `count`/12 visitors,
    about four events per session, busier afternoons on weekdays."""
    n = F.col("id")
    rows = spark.range(0, count, 1, partitions).withColumn(
        "_session", F.floor(n / SESSION_ROWS))
    s = F.col("_session")
    visitors = max(1, count // ROWS_PER_VISITOR)
    day = F.floor(_uniform(s, seed, "day") * DAYS)
    midnight = F.lit(int((END - datetime(1970, 1, 1)).total_seconds()) - DAYS * 86400) + day * 86400
    weekend = F.pmod(F.floor(midnight / 86400) + 4, F.lit(7)).isin(0, 6)
    bias = _uniform(s, seed, "h1") * _uniform(s, seed, "h2")
    hour = F.when(weekend, F.floor(_uniform(s, seed, "hw") * 24)).otherwise(F.floor(6 + bias * 16))
    step = F.pmod(n, F.lit(SESSION_ROWS)) * 240 + F.floor(_uniform(n, seed, "step") * 240)
    at = F.timestamp_seconds(midnight + hour * 3600 + F.floor(_uniform(s, seed, "s") * 3600) + step)

    def pick(salt: str, weights: dict[str, int], key: Column = n) -> Column:
        return weighted(key, seed, salt, weights).alias(salt)

    drawn = rows.select(
        n.cast("string").alias("id"), pick("site_id", SITES, s),
        F.concat(F.lit("u_"), F.floor(_uniform(s, seed, "user") * visitors).cast("string")).alias("user_id"),
        F.concat(F.lit("s_"), s.cast("string")).alias("session_id"), pick("type", TYPES),
        pick("path", PAGES), pick("referrer", REFERRERS), pick("device", DEVICES, s),
        pick("browser", BROWSERS, s), pick("os", SYSTEMS, s), pick("country", COUNTRIES, s),
        F.lit("").alias("city"), at.alias("timestamp"), F.lit("{}").alias("properties"),
        pick("utm_source", UTM_SOURCES), pick("utm_medium", UTM_MEDIUMS),
        pick("utm_campaign", UTM_CAMPAIGNS), F.lit("").alias("utm_term"), F.lit("").alias("utm_content"))
    host = F.replace(F.col("site_id"), F.lit("_"), F.lit("-"))
    return drawn.withColumn(
        "url", F.concat(F.lit("https://"), host, F.lit(".example.com"), F.col("path")))
