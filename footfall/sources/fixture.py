"""The driver's tables read as web-analytics tables (mapping: FIXTURES.md part B)."""

from __future__ import annotations

from datetime import datetime
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AS_OF = datetime(2024, 1, 31)

_PATHS = [
    "/", "/products", "/pricing", "/docs", "/blog", "/about", "/signup", "/guides/email-templates",
]
_TYPES = {
    "view": ["pageview"],
    "purchase": ["purchase", "checkout", "add_to_cart", "pageview"],
    "signup": ["signup", "site_search", "time_on_page", "web_vital"],
    "click": ["heatmap_click", "heatmap_click", "scroll_depth", "rage_click"],
    "error": ["js_error", "pageview"],
}
_REFERRERS = [
    None, "", "https://www.google.com/search", "https://facebook.com/post", "https://t.co/x",
    "https://mail.example.com", "https://news.example.org",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: str, values: list[str | None]) -> str:
    """SQL for values[number mod len(values)]."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE ({number}) % {len(values)} {whens} END"


def site_of(number: Column) -> Column:
    """70 / 20 / 10 % of the keys."""
    slot = number % 10
    return F.when(slot < 7, "site_a").when(slot < 9, "site_b").otherwise("site_c")


_SITE = "CASE WHEN user_id % 10 < 7 THEN 'site_a' WHEN user_id % 10 < 9 THEN 'site_b' ELSE 'site_c' END"
_KIND = "CASE event_type " + " ".join(
    f"WHEN '{name}' THEN {_pick('event_id', kinds)}" for name, kinds in _TYPES.items() if name != "error"
) + f" ELSE {_pick('event_id', _TYPES['error'])} END"
_DEPTH = "CASE WHEN event_id % 16 < 4 THEN 25 WHEN event_id % 16 < 8 THEN 50 WHEN event_id % 16 < 12 THEN 75 ELSE 100 END"
_PROPERTIES = {
    "scroll_depth": f"""concat('{{"depth":', {_DEPTH}, ',"milestone":"true"}}')""",
    "heatmap_click": """concat('{"selector":"button.b', event_id % 5, '","text":"t', event_id % 3,
        '","tag":"button","relX":', event_id % 100, ',"relY":', user_id % 100, ',"x":', event_id % 1280,
        ',"y":', user_id % 720, '}')""",
    "rage_click": """concat('{"selector":"a.r', event_id % 5, '","count":', 3 + event_id % 4, '}')""",
    "time_on_page": """concat('{"seconds":', event_id % 4000, '}')""",
    "web_vital": f"""concat('{{"name":"', {_pick("event_id", ["LCP", "FID", "CLS", "INP", "TTFB"])},
        '","value":', value, '}}')""",
    "js_error": """concat('{"message":"E', event_id % 6, '","source":"app', user_id % 2, '.js"}')""",
    "site_search": """concat('{"query":"q', event_id % 9, '","param":"q"}')""",
    "purchase": """concat('{"value":', value, '}')""",
}
_COLUMNS = {
    "id": "cast(event_id AS string)",
    "site_id": "site_id",
    "user_id": "concat('u_', user_id)",
    "session_id": "concat('u_', user_id, '_', to_date(ts))",
    "type": "type",
    "url": "concat('https://', site_id, '.example.com', path, if(event_id % 10 = 0, '?token=abc&q=x#frag', ''))",
    "path": "path",
    "referrer": _pick("user_id", _REFERRERS),
    "device": _pick("user_id", ["Desktop", "Mobile", "Tablet", ""]),
    "browser": _pick("user_id", ["Chrome", "Safari", "Firefox"]),
    "os": _pick("user_id", ["macOS", "Windows", "iOS", "Android", "Linux"]),
    "country": _pick("user_id", ["US", "United States", "IN", "Germany", "", None]),
    "city": _pick("user_id", ["Berlin", "London", "Mumbai", "", None]),
    "timestamp": "ts",
    "properties": "CASE type " + " ".join(
        f"WHEN '{kind}' THEN {sql}" for kind, sql in _PROPERTIES.items()) + " ELSE '{}' END",
    "utm_source": _pick("user_id", ["", "", "", "google", "newsletter", None]),
    "utm_medium": _pick("user_id", ["", "", "", "cpc", "email", ""]),
    "utm_campaign": _pick("user_id", ["", "", "", "launch", "", ""]),
    "utm_term": _pick("user_id", ["", "", "", "free templates", "", "email tools", "", ""]),
    "utm_content": "''",
}


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_web_events(table(spark, sf_dir, "events"))


def web_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a stream of files, with a time type that watermarks accept."""
    raw = (spark.readStream.schema(table(spark, sf_dir, "events").schema)
           .option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    return as_web_events(raw).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def as_web_events(raw: DataFrame) -> DataFrame:
    typed = raw.selectExpr(
        "*", f"{_KIND} AS type", f"{_SITE} AS site_id", f"{_pick('event_id + user_id', _PATHS)} AS path")
    return typed.selectExpr(*[f"{sql} AS {name}" for name, sql in _COLUMNS.items()])


def rank_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily search positions per (site, keyword); a NULL position means "not ranking"."""
    lines = table(spark, sf_dir, "lineitem")
    open_line = F.col("l_linestatus") == "O"
    return (
        lines.groupBy(
            site_of(F.col("l_suppkey")).alias("site_id"),
            F.concat(F.lit("kw_"), (F.col("l_partkey") % 20).cast("string")).alias("keyword"),
            F.to_date("l_shipdate").alias("checked_at"),
        )
        .agg(
            F.min(F.when(F.col("l_quantity") <= 45, F.col("l_quantity").cast("int")))
            .alias("position"),
            F.coalesce(F.bool_or(open_line), F.lit(False)).alias("ai_overview"),
            F.coalesce(F.bool_or(open_line & (F.col("l_returnflag") == "A")), F.lit(False))
            .alias("is_cited"),
        )
        .withColumn("location", F.lit("United States"))
        .withColumn("device", F.lit("desktop"))
    )


def page_keywords(observations: DataFrame) -> DataFrame:
    """One page `/p<n>` per tracked keyword `kw_<n>`."""
    return observations.select(
        "site_id",
        F.concat(F.lit("/p"), F.substring_index("keyword", "_", -1)).alias("path"),
        "keyword", "location", F.lit(True).alias("is_primary"),
    ).distinct()
