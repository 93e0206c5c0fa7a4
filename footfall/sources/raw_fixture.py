"""Raw inputs (uncleaned records, requests, feeds, result pages) derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.sources.fixture import site_of, table, web_events


def _number(name: str) -> Column:
    return F.col(name).cast("bigint")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw_events(web_events(spark, sf_dir))


def as_raw_events(events: DataFrame) -> DataFrame:
    """Visitor records as they arrive: gaps, unknown types, secrets in URLs and properties."""
    e = events.withColumn("_n", _number("id"))
    n = F.col("_n")
    nested = F.concat(
        F.lit('{"Email":"a@b.c","list":[1,{"password":"x"}],"plan":"p'), (n % 3).cast("string"),
        F.lit('","z":{"api_key":"k","l2":{"l3":{"l4":{"l5":1}}}}}'))
    return e.select(
        "id", F.when(n % 13 == 0, None).otherwise(F.col("site_id")).alias("site_id"),
        F.when(n % 17 == 0, "").otherwise(F.col("user_id")).alias("user_id"),
        F.when(n % 5 == 0, None).otherwise(F.col("session_id")).alias("session_id"),
        F.when(n % 11 == 0, "mystery").when(n % 7 == 0, None).otherwise(F.col("type")).alias("type"),
        F.concat("url", F.when(n % 4 == 1, "?Access_Token=s3&page=2").otherwise("")).alias("url"),
        F.when(n % 6 == 0, "").otherwise(F.col("path")).alias("path"),
        "referrer", F.when(n % 9 == 0, None).otherwise(F.col("device")).alias("device"),
        "browser", "os", F.repeat(F.col("country"), 60).alias("country"), "city", "timestamp",
        F.when(n % 8 == 0, nested).alias("props"),
        F.when(n % 8 == 1, "broken {").when(n % 8 == 0, '{"plan":"second"}').otherwise("{}")
        .alias("properties"),
        "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with headers, address, user agent, time zone and locale."""
    e = table(spark, sf_dir, "events")
    n, u = F.col("event_id"), F.col("user_id")
    ip = F.concat_ws(".", F.lit("10"), (n % 4).cast("string"), (u % 256).cast("string"), (n % 256).cast("string"))
    return e.select(
        n.cast("string").alias("id"), site_of(u).alias("site_id"),
        F.when(n % 5 == 0, "1").when(n % 5 == 1, "true").alias("dnt"),
        F.when(n % 7 == 0, "1").when(n % 7 == 1, "0").alias("gpc"),
        F.when(n % 3 == 0, F.concat(ip, F.lit(", 172.16.0.1"))).alias("forwarded"),
        F.when(n % 3 == 1, ip).alias("real_ip"), ip.alias("peer"),
        _one_of(n, USER_AGENTS).alias("user_agent"),
        _one_of(u, ["Europe/Berlin", "Asia/Kolkata", "Mars/Base", ""]).alias("timezone"),
        _one_of(n, ["en-IN", "de", "zh-Hant-TW", "xx-QQ", "fr-FR", "en-hk"]).alias("locale"),
        _one_of(n, ["", "Spain", None]).alias("country"), _one_of(n, ["", "Madrid"]).alias("city"),
    )


USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Version/17.0 Safari/605.1",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Mobile Safari/537.36",
    "Mozilla/5.0 (iPad; CPU OS 17_0) Safari/604.1",
    "Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0",
    "Opera/9.80 (Windows NT 6.1)",
    "curl/8.0",
]
ZONES = [("Europe/Berlin", "Germany"), ("Asia/Kolkata", "India")]


def _one_of(number: Column, values: list[str | None]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address range per nation, with gaps between them, some across /16 borders."""
    first = F.lit(10 * 256 ** 3) + F.col("n_nationkey").cast("bigint") * 10_000
    return table(spark, sf_dir, "nation").select(
        first.alias("first_ip"), (first + 7_999).alias("last_ip"),
        F.when(F.col("n_nationkey") % 2 == 0, "DE").otherwise(F.col("n_name")).alias("country"),
        F.lit(None).cast("string").alias("region"),
        F.concat(F.lit("City "), F.col("n_nationkey").cast("string")).alias("city"),
        F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"))


def geo_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of both address families, some inside others, one per nation."""
    k = F.col("n_nationkey").cast("int")
    text, low_hex = k.cast("string"), lambda c: F.lower(F.hex(c))
    network = (
        F.when(k < 4, F.concat(F.lit("10."), text, F.lit(".0.0/16")))
        .when(k < 10, F.concat(F.lit("10.1."), text, F.lit(".0/24")))
        .when(k < 14, F.concat(F.lit("2001:db8:"), low_hex(k - 10), F.lit("::/48")))
        .when(k < 19, F.concat(F.lit("2001:0DB8:1:"), low_hex(k), F.lit("::/64")))
        .otherwise(F.concat(F.lit("2001:db8:2::"), low_hex(k))))
    return table(spark, sf_dir, "nation").select(
        network.alias("network"), F.col("n_name").alias("country"),
        F.when(k % 3 != 0, F.concat(F.lit("Region "), text)).alias("region"), F.concat(F.lit("City "), text).alias("city"),
        (k * 1.5).cast("double").alias("latitude"), (k * -2.0).cast("double").alias("longitude"))


def addressed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from addresses of both families, IPv4 also in its IPv6 form, and some that are none."""
    e = table(spark, sf_dir, "events")
    n, u = F.col("event_id"), F.col("user_id")
    low_hex = lambda c: F.lower(F.hex(c))
    four = F.concat_ws(".", F.lit("10"), (n % 5).cast("string"), (u % 12).cast("string"), (n % 256).cast("string"))
    six = F.concat(F.lit("2001:db8:"), low_hex(n % 5), F.lit(":"), low_hex(u % 20), F.lit("::"), low_hex(n % 30))
    ip = F.when(n % 31 == 0, "10.0.0.256").when(n % 3 == 0, four).when(n % 3 == 1, six).otherwise(F.concat(F.lit("::FFFF:"), four))
    return e.select(n.cast("string").alias("id"), ip.alias("ip"), F.when(n % 7 == 0, "Spain").alias("country"),
                    F.when(n % 14 == 0, "Madrid").otherwise("").alias("city"))


def dirty_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs, a part of them with secrets in the query."""
    p = table(spark, sf_dir, "pages")
    sep = F.when(F.col("url").contains("?"), "&").otherwise("?")
    extra = F.element_at(F.array(
        F.lit(""), F.concat(sep, F.lit("Token=abc&q=x")), F.concat(sep, F.lit("e_mail=a%40b.c&utm_term=t#frag")),
        F.concat(sep, F.lit("api%5Fkey=1&keys=2&empty")),
    ), (F.col("page_id") % 4 + 1).cast("int"))
    return p.select("page_id", F.concat("url", extra).alias("url"))


def search_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views whose URLs carry on-site searches."""
    e = web_events(spark, sf_dir).filter("type = 'pageview'").withColumn("_n", _number("id"))
    n = F.col("_n")
    query = F.element_at(F.array(
        F.lit(""), F.lit("?q=Shoes"), F.lit("?page=1&search=red+hat"), F.lit("?q=%20&term=T%26A"), F.lit("?q=shoes"),
    ), (n % 5 + 1).cast("int"))
    url = F.concat(F.lit("https://"), "site_id", F.lit(".example.com/s"), query)
    return e.select("site_id", "session_id", "user_id", "id", "timestamp", url.alias("url"))


def raw_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw clicks: each click event repeated up to five times within three seconds."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    n, u = F.col("event_id"), F.col("user_id")
    again = F.explode(F.sequence(F.lit(0), (n % 5).cast("int"))).alias("_i")
    base = e.select(
        site_of(u).alias("site_id"), F.concat(F.lit("u_"), u.cast("string")).alias("user_id"),
        F.concat(F.lit("s_"), u.cast("string")).alias("session_id"), F.lit("/").alias("path"),
        F.concat(F.lit("a.r"), (n % 2).cast("string")).alias("selector"), n.alias("_n"),
        F.col("ts").alias("_ts"), again)
    gap = F.when(F.col("_n") % 3 == 0, 300).otherwise(700)
    return base.select(
        "site_id", "user_id", "session_id", "path", "selector",
        F.concat_ws("-", F.col("_n").cast("string"), F.col("_i").cast("string")).alias("id"),
        (F.col("_ts") + F.make_dt_interval(secs=(F.col("_i") * gap / 1000).cast("decimal(18,6)"))).alias("timestamp"))


def _order_level() -> Column:
    return F.element_at(
        F.array(F.lit("fatal"), F.lit("error"), F.lit("warning"), F.lit("")), (F.col("o_orderkey") % 4 + 1).cast("int"))


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw issue per order: customer as site, priority as project, price as event count."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    doc = F.struct(
        k.cast("string").alias("id"), F.concat(F.lit("S-"), k.cast("string")).alias("shortId"),
        F.when(k % 3 != 0, F.concat(F.lit("Error in "), "o_orderpriority")).alias("title"),
        _order_level().alias("level"),
        F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "unresolved").alias("status"),
        F.floor("o_totalprice").cast("string").alias("count"), (k % 50).alias("userCount"),
        F.when(k % 10 == 0, "regressed").alias("substatus"),
        F.struct(F.concat(F.lit("1."), (k % 4).cast("string")).alias("version")).alias("lastRelease"),
        F.struct(F.when(k % 6 == 0, "Meta value").alias("value"), F.lit("MetaType").alias("type")).alias("metadata"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("firstSeen"),
        F.date_format(F.date_add("o_orderdate", 5), "yyyy-MM-dd'T'HH:mm:ss").alias("lastSeen"))
    return o.select(
        k.alias("_k"), site_of(F.col("o_custkey")).alias("site_id"),
        F.substring("o_orderpriority", 1, 1).alias("project_slug"), F.to_json(doc).alias("issue"))


def raw_issue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly error counts per site and source, as one JSON list per day."""
    e = web_events(spark, sf_dir).filter("type = 'js_error'")
    hour = F.unix_seconds(F.date_trunc("hour", "timestamp").cast("timestamp"))
    hourly = e.groupBy(
        "site_id", F.get_json_object("properties", "$.source").alias("project_slug"),
        F.to_date("timestamp").alias("_day"), hour.alias("_at")).agg(F.count("*").alias("_n"))
    return hourly.groupBy("site_id", "project_slug", "_day").agg(
        F.to_json(F.collect_list(F.array("_at", "_n"))).alias("stats"))


def raw_error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One error-tracker event document per script error."""
    e = web_events(spark, sf_dir).filter("type = 'js_error'").withColumn("_n", _number("id"))
    n = F.col("_n")
    frame = lambda i: F.struct(
        F.when(i % 2 == 0, F.concat(F.lit("f"), i.cast("string"), F.lit(".js"))).alias("filename"),
        F.lit("abs.js").alias("absPath"), i.alias("lineNo"), (i % 3 == 0).alias("inApp"))
    crumb = lambda i: F.struct(
        F.lit("nav").alias("category"), F.concat(F.lit("step "), i.cast("string")).alias("message"))
    error = F.struct(
        F.lit("TypeError").alias("type"), F.concat(F.lit("bad "), (n % 9).cast("string")).alias("value"),
        F.struct(F.transform(F.sequence(F.lit(1), (n % 150 + 1).cast("int")), frame).alias("frames")).alias("stacktrace"))
    entries = F.array(
        F.struct(F.lit("exception").alias("type"), F.struct(F.to_json(F.array(error)).alias("v")).alias("data")),
        F.struct(F.lit("breadcrumbs").alias("type"), F.struct(F.to_json(F.transform(
            F.sequence(F.lit(1), (n % 30 + 1).cast("int")), crumb)).alias("v")).alias("data")))
    text = F.array_join(F.transform(entries, lambda x: F.concat(
        F.lit('{"type":"'), x["type"], F.lit('","data":{"values":'), x["data"]["v"], F.lit("}}"))), ",")
    tags = F.to_json(F.transform(F.sequence(F.lit(1), (n % 40 + 1).cast("int")), lambda i: F.struct(
        F.concat(F.lit("k"), i.cast("string")).alias("key"), F.lit("v").alias("value"))))
    return e.select("site_id", F.concat(
        F.lit('{"eventID":"'), "id", F.lit('","title":"T'), (n % 6).cast("string"), F.lit('","platform":"javascript","tags":'),
        tags, F.lit(',"entries":['), text, F.lit("]}")).alias("event"))


SITE_DOMAINS = [("site_a", "https://www.s1.example.com/"), ("site_b", "s2.example.com"), ("site_c", "S3.example.com")]


def _keyword() -> Column:
    slot = F.col("l_partkey") % 20
    return (F.when(slot == 0, "email templates").when(slot == 1, "products").when(slot == 2, "pricing")
            .otherwise(F.concat(F.lit("kw_"), slot.cast("string"))))


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw result page per keyword and month: ten slots, each taken by one of eight hosts."""
    lines = table(spark, sf_dir, "lineitem")
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    slots = lines.groupBy(
        _keyword().alias("keyword"), month.alias("_month"), (F.col("l_orderkey") % 10 + 1).alias("_slot")
    ).agg(
        (F.min(F.col("l_suppkey") + F.col("l_partkey")) % 8).alias("_host"),
        F.max((F.col("l_linestatus") == "O").cast("int")).alias("_open"),
        F.max(((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40)).cast("int")).alias("_quoted"))
    link = F.concat(F.lit("https://www.s"), F.col("_host").cast("string"), F.lit(".example.com/p"), F.col("_slot").cast("string"))
    grouped = slots.groupBy("keyword", "_month").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("_slot").alias("position"), link.alias("link"),
            F.concat(F.lit("T"), F.col("_slot").cast("string")).alias("title")))).alias("organic_results"),
        F.max(F.when(F.col("_slot") <= 3, F.col("_open"))).alias("_ai"),
        F.sort_array(F.collect_list(F.when((F.col("_quoted") == 1) & (F.col("_slot") <= 4), F.struct(
            F.col("_slot").alias("index"), link.alias("link"))))).alias("references"))
    m = F.month("_month")
    ai = F.when((F.col("_ai") == 1) & (m % 3 != 0), F.struct("references"))
    doc = F.struct(
        "organic_results", ai.alias("ai_overview"),
        F.when(m % 2 == 0, F.array(F.struct(F.concat(F.lit("What is "), "keyword", F.lit("?")).alias("question")))).alias("related_questions"),
        F.array(F.struct(F.concat("keyword", F.lit(" tips")).alias("query")),
                F.struct(F.concat(F.lit("best "), "keyword").alias("query"))).alias("related_searches"),
        F.when(m % 4 == 0, F.array(F.struct(F.lit("v").alias("title")))).alias("inline_videos"),
        F.when(m % 5 == 0, F.struct(F.lit("a").alias("answer"))).alias("answer_box"))
    return grouped.select(
        "keyword", F.lit("United States").alias("location"), F.lit("desktop").alias("device"),
        F.col("_month").cast("timestamp_ntz").alias("fetched_at"), F.to_json(doc).alias("page"))


def event_page_keywords(spark: SparkSession) -> DataFrame:
    """Keywords of the fixture's pages: two per page, none for /about."""
    paths = ["/products", "/pricing", "/docs", "/blog", "/signup", "/guides/email-templates", "/"]
    names = ["products", "pricing", "kw_3", "kw_4", "kw_5", "email templates", "kw_7"]
    rows = [
        (site, path, name, "United States", primary)
        for site in ("site_a", "site_b", "site_c")
        for i, path in enumerate(paths)
        for name, primary in ((names[i], True), (f"kw_{i + 8}", False))
    ]
    return spark.createDataFrame(rows, "site_id string, path string, keyword string, location string, is_primary boolean")
