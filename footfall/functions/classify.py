"""Labels for referrers, devices, countries and measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from footfall.functions.urls import domain_matches, extract_domain

# Referrer words per source class, tested in this order.
SOURCE_CLASSES = {
    "Search": ["google", "bing", "yahoo", "duckduckgo", "baidu", "yandex"],
    "Social": [
        "facebook", "twitter", "linkedin", "instagram", "youtube", "reddit", "pinterest", "tiktok",
    ],
    "Email": ["mail", "email", "outlook"],
}
# The coarser classes of the daily rollup (case-sensitive).
ROLLUP_SOURCE_CLASSES = {
    "Search": ["google.", "bing.", "yahoo."],
    "Social": ["facebook.", "twitter.", "linkedin."],
}
# Referrer parts per social platform, tested in this order.
SOCIAL_PLATFORMS = {
    "Facebook": ["facebook", "fb.com"],
    "Twitter/X": ["twitter", "t.co", "x.com"],
    "LinkedIn": ["linkedin"],
    "Instagram": ["instagram"],
    "YouTube": ["youtube"],
    "Reddit": ["reddit"],
    "Pinterest": ["pinterest"],
    "TikTok": ["tiktok"],
    "GitHub": ["github"],
    "Discord": ["discord"],
    "Slack": ["slack"],
}
# The platforms' own host names, for matching by host.
SOCIAL_HOSTS = {
    "Facebook": ["facebook.com", "fb.com"],
    "Twitter/X": ["twitter.com", "t.co", "x.com"],
    "LinkedIn": ["linkedin.com"],
    "Instagram": ["instagram.com"],
    "YouTube": ["youtube.com"],
    "Reddit": ["reddit.com"],
    "Pinterest": ["pinterest.com"],
    "TikTok": ["tiktok.com"],
    "GitHub": ["github.com"],
    "Discord": ["discord.com", "discord.gg"],
    "Slack": ["slack.com"],
}
# Upper bound in seconds (exclusive) and label.
DURATION_BUCKETS = [(10, "0-10s"), (30, "10-30s"), (60, "30s-1m"), (180, "1-3m"), (600, "3-10m")]
LONGEST_BUCKET = "10m+"
# Largest good value, largest value that is not poor.
VITAL_LIMITS = {
    "LCP": (2500.0, 4000.0), "FID": (100.0, 300.0), "CLS": (0.1, 0.25),
    "INP": (200.0, 500.0), "TTFB": (800.0, 1800.0),
}


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _first_label(text: Column, classes: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(_any_of(text, words), label) for label, words in classes.items()])


def filled(column: str | Column, label: str) -> Column:
    """NULL and '' both become the label."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(label))


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def source_class(referrer: Column) -> Column:
    return F.when(is_blank(referrer), "Direct").otherwise(
        F.coalesce(_first_label(F.lower(referrer), SOURCE_CLASSES), F.lit("Referral"))
    )


def rollup_source_class(referrer: Column) -> Column:
    return F.when(is_blank(referrer), "Direct").otherwise(
        F.coalesce(_first_label(referrer, ROLLUP_SOURCE_CLASSES), F.lit("Referral"))
    )


def social_platform(referrer: Column, match: str = "substring") -> Column:
    """Platform or NULL. `substring` tests parts of the text, so `t.co` also finds reddit.com;
    `host` compares whole host names."""
    if match == "substring":
        return _first_label(F.lower(referrer), SOCIAL_PLATFORMS)
    host = extract_domain(referrer)
    return F.coalesce(*[
        F.when(reduce(lambda a, b: a | b, [domain_matches(host, F.lit(h)) for h in hosts]), label)
        for label, hosts in SOCIAL_HOSTS.items()
    ])


def duration_bucket(seconds: Column, minute_label: str = "30s-1m") -> Column:
    labels = [(s, minute_label if label == "30s-1m" else label) for s, label in DURATION_BUCKETS]
    return F.coalesce(*[F.when(seconds < s, label) for s, label in labels], F.lit(LONGEST_BUCKET))


def duration_bucket_order(seconds: Column) -> Column:
    return F.coalesce(
        *[F.when(seconds < s, i) for i, (s, _) in enumerate(DURATION_BUCKETS, start=1)], F.lit(6)
    )


def vital_rating(metric: Column, value: Column, inclusive: bool = True) -> Column:
    """good / needs-improvement / poor; `inclusive` says whether a limit itself still passes."""
    def passes(limit: float) -> Column:
        return value <= limit if inclusive else value < limit

    rated = [
        F.when(metric == name, F.when(passes(good), "good")
               .when(passes(poor), "needs-improvement").otherwise("poor"))
        for name, (good, poor) in VITAL_LIMITS.items()
    ]
    return F.coalesce(*rated, F.lit("unknown"))
