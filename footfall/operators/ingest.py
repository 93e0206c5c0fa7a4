"""Raw visitor records to clean events: validation, privacy, and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.classify import is_blank
from footfall.functions.geo import address_bits, country_name, longest_prefix, networks_of_ranges, with_locale_country
from footfall.functions.numbers import present
from footfall.functions.ordered import previous_row
from footfall.functions.properties import merge_objects, sanitise_properties
from footfall.functions.urls import (
    SEARCH_PARAMETERS, pair_value, query_pairs, sanitise_referrer, sanitise_url, url_path,
)

# Accepted event types; anything else is stored as `custom`.
EVENT_TYPES = [
    "pageview", "click", "impression", "add_to_cart", "checkout", "purchase", "signup", "custom",
    "form_submit", "lead", "scroll_depth", "time_on_page", "button_click", "signup_start",
    "video_play", "web_vital", "js_error", "heatmap_click", "rage_click", "site_search",
    "experiment_view",
]
# Longest stored text per column.
LENGTHS = {
    "site_id": 64, "user_id": 64, "session_id": 64, "url": 2048, "path": 512, "device": 50,
    "browser": 255, "os": 100, "country": 100, "city": 255, "utm_source": 255, "utm_medium": 255,
    "utm_campaign": 255, "utm_term": 255, "utm_content": 255,
}
_DEFAULTS = {"device": "Desktop", "type": "pageview"}
_PLAIN = ["device", "browser", "os", "country", "city",
          "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]


def _cut(c: Column, name: str) -> Column:
    return F.substring(c, 1, LENGTHS[name])


def _usable() -> Column:
    return ~is_blank(F.col("site_id")) & ~is_blank(F.col("user_id"))


def ingest_clean(raw: DataFrame) -> DataFrame:
    """Events that may be stored. Expects the event columns plus `props`; a missing session id is
    derived from site, visitor and time, so a repeated run gives the same id."""
    minted = F.concat(F.lit("s_"), F.substring(F.md5(F.concat_ws(
        "|", "site_id", "user_id", F.col("timestamp").cast("string"))), 1, 16))
    kind = F.coalesce(F.col("type"), F.lit(_DEFAULTS["type"]))
    path = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit("/"))
    plain = {c: F.coalesce(F.col(c), F.lit(_DEFAULTS.get(c, ""))) for c in _PLAIN}
    return raw.filter(_usable()).select(
        "id", _cut(F.col("site_id"), "site_id").alias("site_id"),
        _cut(F.col("user_id"), "user_id").alias("user_id"),
        _cut(F.coalesce(F.nullif(F.col("session_id"), F.lit("")), minted), "session_id")
        .alias("session_id"),
        F.when(kind.isin(EVENT_TYPES), kind).otherwise("custom").alias("type"),
        _cut(sanitise_url(F.col("url")), "url").alias("url"),
        _cut(sanitise_url(path), "path").alias("path"),
        sanitise_referrer(F.col("referrer")).alias("referrer"),
        *[_cut(c, name).alias(name) for name, c in plain.items()],
        "timestamp",
        sanitise_properties(merge_objects(F.col("props"), F.col("properties"))).alias("properties"),
    )


def ingest_rejects(raw: DataFrame) -> DataFrame:
    """Records without site or visitor, with the reason: the side output of `ingest_clean`."""
    return raw.filter(~_usable()).withColumn(
        "reason", F.when(is_blank(F.col("site_id")), "no site_id").otherwise("no user_id"))


def opt_out_filter(requests: DataFrame) -> DataFrame:
    """Drops visitors who sent exactly DNT: 1 or Sec-GPC: 1."""
    said_no = F.coalesce(F.col("dnt") == "1", F.lit(False)) | F.coalesce(F.col("gpc") == "1", F.lit(False))
    return requests.filter(~said_no)


def client_ip(forwarded: Column, real_ip: Column, peer: Column) -> Column:
    """First forwarded hop, else the proxy's real-ip header, else the peer address."""
    first_hop = F.trim(F.substring_index(F.nullif(forwarded, F.lit("")), ",", 1))
    return F.coalesce(first_hop, F.trim(F.nullif(real_ip, F.lit(""))), peer)


def enrich_geo(events: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """Fill blank country and city, and add region, latitude and longitude, from a table of networks of both address
    families (`networks_of_cidr`, `networks_of_ranges`): the smallest network that holds the address counts.

    Each distinct address is looked up once, by equal leading bits, and named back by its text. Events that need
    no lookup get distinct keys that match nothing, so that they spread over all tasks."""
    needs = is_blank(F.col("country")) | is_blank(F.col("city"))
    wanted = F.when(needs, F.col(ip))
    named = networks.withColumn("country", F.when(~is_blank(F.col("country")), country_name(F.col("country")))).select(
        "bits", "length", *[F.col(c).alias(f"_{c}") for c in _PLACE])
    asked = events.select(wanted.alias("_ip")).filter("_ip IS NOT NULL").distinct().withColumn("_bits", address_bits(F.col("_ip")))
    found = asked.join(longest_prefix(asked, named, "_bits"), "_bits").drop("_bits")
    key = F.coalesce(wanted, F.concat(F.lit("none "), F.xxhash64("id").cast("string")))
    joined = events.withColumn("_key", key).join(found, F.col("_key") == F.col("_ip"), "left")
    is_named = F.col("_country").isNotNull()

    def fill(column: str) -> Column:
        value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.when(is_named, F.col(f"_{column}")))
        return F.coalesce(value, F.col(column)).alias(column)

    kept = [c for c in events.columns if c not in _PLACE]
    return joined.select(*kept, fill("country"), fill("city"), *[F.col(f"_{c}").alias(c) for c in _PLACE[2:]])


_PLACE = ["country", "city", "region", "latitude", "longitude"]


def enrich_geo_ip(events: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """`enrich_geo` from a table of IPv4 ranges (first_ip, last_ip, country, region, city, latitude, longitude)."""
    return enrich_geo(events, networks_of_ranges(ranges), ip).drop(*[c for c in _PLACE[2:] if c not in events.columns])


# User-agent words per label, tested in this order.
DEVICE_WORDS = [
    ("Tablet", "tablet|ipad|playbook|silk"),
    ("Mobile", "mobile|iphone|ipod|android|blackberry|opera mini|iemobile"),
]
BROWSER_WORDS = [
    ("Edge", "Edg/"), ("Opera", "OPR|Opera"), ("Chrome", "Chrome"), ("Safari", "Safari"),
    ("Firefox", "Firefox"),
]
OS_WORDS = [
    ("Windows", "Windows"), ("macOS", "Mac OS"), ("Android", "Android"), ("iOS", "iPhone|iPad|iPod"),
    ("Linux", "Linux"),
]


def enrich_user_agent(requests: DataFrame, user_agent: str = "user_agent") -> DataFrame:
    """Device, browser and operating system from the user agent; the first matching label wins."""
    def label(words, default: str) -> Column:
        tests = [F.when(F.col(user_agent).rlike(f"(?i){w}"), name) for name, w in words]
        return F.coalesce(*tests, F.lit(default))

    return requests.withColumns({
        "device": label(DEVICE_WORDS, "Desktop"),
        "browser": label(BROWSER_WORDS, "Other"),
        "os": label(OS_WORDS, "Other"),
    })


def enrich_country(requests: DataFrame, zones: DataFrame) -> DataFrame:
    """Country from `timezone` by a table (timezone, country), else from the region in `locale`,
    else Unknown."""
    table = zones.select(F.col("timezone").alias("_tz"), F.col("country").alias("_by_zone"))
    joined = with_locale_country(requests, "locale", "_by_locale").join(
        table, F.col("timezone") == F.col("_tz"), "left").drop("_tz")
    return joined.withColumn("country", F.coalesce("_by_zone", "_by_locale", F.lit("Unknown"))).drop("_by_zone", "_by_locale")


def read_zone_table(spark, path: str) -> DataFrame:
    """(timezone, country) from an IANA zone.tab file: code, coordinates, zone per line."""
    lines = spark.read.option("sep", "\t").option("comment", "#").csv(
        path, schema="code string, coordinates string, timezone string, note string")
    return lines.select("timezone", country_name(F.col("code")).alias("country"))


def extract_site_search(views: DataFrame) -> DataFrame:
    """On-site searches found in page URLs: the first non-empty known parameter. A search equal to
    the one before it in the same session (same page, parameter and text) is not repeated."""
    known = F.array(*[F.lit(p) for p in SEARCH_PARAMETERS])
    first_of_name = F.transform(known, lambda name: F.struct(
        name.alias("param"),
        F.trim(F.try_element_at(F.filter("_pairs", lambda p: p["name"] == name), F.lit(1))["value"])
        .alias("query")))
    found = F.try_element_at(F.filter(first_of_name, lambda f: f["query"] != ""), F.lit(1))
    with_query = views.filter(F.col("url").contains("?")).withColumn(
        "_pairs", query_pairs(F.col("url")))
    searches = (
        present(with_query.withColumn("_found", found), "_found")
        .select("site_id", "session_id", "user_id", "id", "timestamp",
                url_path(F.col("url")).alias("path"), "_found.*"))
    searches = searches.withColumn(
        "_key", F.concat_ws("", "path", F.lit("?"), "param", F.lit("="), F.lower("query")))
    linked = previous_row(
        searches, ["site_id", "session_id"], ["timestamp", "id"], {"_before": "_key"}, "hour")
    return linked.filter(~F.col("_key").eqNullSafe(F.col("_before"))).drop("_key", "_before")


def extract_utm(events: DataFrame) -> DataFrame:
    """Fill empty campaign columns from the URL's parameters of the same name."""
    names = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]
    return events.withColumn("_pairs", query_pairs(F.col("url"))).withColumns({
        c: F.coalesce(F.nullif(F.col(c), F.lit("")), pair_value(F.col("_pairs"), c), F.lit(""))
        for c in names}).drop("_pairs")
