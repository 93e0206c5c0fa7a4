"""Column helpers on literal values."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from footfall.functions import geo, numbers, urls
from footfall.functions.classify import duration_bucket, social_platform, source_class, vital_rating
from footfall.functions.properties import merge_objects, sanitise_properties
from footfall.functions.ranges import date_range, last_days
from footfall.functions.stats import two_proportion_test
from footfall.operators.conversion import assigned_variant, fnv1a
from footfall.operators.keywords import with_phrase


def values(spark, column, *inputs, schema="x string"):
    rows = [(i if isinstance(i, tuple) else (i,)) + (n,) for n, i in enumerate(inputs)]
    df = spark.createDataFrame(rows, schema + ", n int")
    return [r[0] for r in df.select(column.alias("v"), "n").orderBy("n").select("v").collect()]


def test_date_ranges():
    now = datetime(2024, 3, 10, 15, 30)
    assert date_range("today", now).start == datetime(2024, 3, 10)
    assert date_range("7d", now).start == datetime(2024, 3, 3, 15, 30)
    assert date_range("nonsense", now) == date_range("30d", now)
    custom = date_range("custom:2024-01-02:2024-01-03", now)
    assert (custom.start, custom.end) == (datetime(2024, 1, 2), datetime(2024, 1, 3, 23, 59, 59, 999000))
    assert date_range("custom:x:y", now) == date_range("30d", now)
    before = date_range("7d", now).previous()
    assert (before.start, before.end) == (datetime(2024, 2, 25, 15, 30), datetime(2024, 3, 3, 15, 30))
    assert last_days(2, now).start == datetime(2024, 3, 8)


def test_rounding_goes_up_at_halves(spark):
    got = values(spark, numbers.round_half_up(F.col("x")), 2.5, -2.5, 0.4, schema="x double")
    assert got == [3, -2, 0]
    assert values(spark, numbers.round_half_up(F.col("x"), 1), 1.25, -1.25, schema="x double") == [1.3, -1.2]


def test_percent_and_trend(spark):
    pct = numbers.percent(F.col("a"), F.col("b"))
    assert values(spark, pct, (1, 3), (1, 0), schema="a int, b int") == [33, 0]
    trend = numbers.trend(F.col("a"), F.col("b"))
    got = values(spark, trend, (3.0, 0.0), (0.0, 0.0), (3.0, 2.0), (1.0, 2.0), schema="a double, b double")
    assert got == [100.0, 0.0, 50.0, -50.0]


def test_and_list(spark):
    col = numbers.and_list(F.when(F.col("x") == "", F.array().cast("array<string>")).otherwise(F.split("x", ",")))
    assert values(spark, col, "", "a", "a,b", "a,b,c") == ["", "a", "a and b", "a, b, and c"]


@pytest.mark.parametrize("raw, clean", [
    ("https://e.com/p?token=abc&utm_source=g", "https://e.com/p?token=REDACTED&utm_source=g"),
    ("https://e.com/p?TOKEN=abc#frag", "https://e.com/p?TOKEN=REDACTED"),
    ("/search?q=x&E_Mail=a%40b", "/search?q=x&E_Mail=REDACTED"),
    ("/p?monkey=1&keys=2&keyword=3", "/p?monkey=1&keys=2&keyword=3"),
    ("/p?api%5Fkey=1", "/p?api%5Fkey=REDACTED"),
    ("https://e.com/#access_token=1", "https://e.com/"),
    ("ht!tp://bad url?token=1", "ht!tp://bad url?token=REDACTED"),
    ("/p?token", "/p?token=REDACTED"),
    ("", ""), (None, ""),
])
def test_sanitise_url(spark, raw, clean):
    assert values(spark, urls.sanitise_url(F.col("x")), raw) == [clean]


def test_sanitise_referrer_and_length(spark):
    assert values(spark, urls.sanitise_referrer(F.col("x")), None, "", "#only") == [None, None, None]
    assert len(values(spark, urls.sanitise_url(F.col("x")), "/" + "a" * 5000)[0]) == 2048


def test_query_of_an_unparseable_address_goes(spark):
    got = values(spark, urls.sanitise_url(F.col("x")), "http://[bad?x=1&foo=secretvalue", "https://a b/p?x=1#f", "http://h:port/?x=1",
                 "http://[::1]:80/p?x=1", "https://u@h.org:8/p?x=1#f", "//h/[p]?x=1")
    assert got == ["http://[bad", "https://a b/p", "http://h:port/", "http://[::1]:80/p?x=1", "https://u@h.org:8/p?x=1", "//h/[p]?x=1"]


def test_domains(spark):
    got = values(spark, urls.extract_domain(F.col("x")),
                 "https://www.Example.com:8080/p?x", "blog.example.com/a", "http://user@e.com", "", None)
    assert got == ["example.com", "blog.example.com", "e.com", None, None]
    match = urls.domain_matches(F.col("a"), F.col("b"))
    got = values(spark, match, ("www.e.com", "e.com"), ("a.e.com", "E.com"), ("note.com", "e.com"), (None, "e.com"),
                 schema="a string, b string")
    assert got == [True, True, False, False]


def test_properties_are_redacted_to_depth_four(spark):
    deep = {"a": {"b": {"c": {"d": {"e": 1}}}}, "Password": "x", "list": [{"token": "t", "n": 1.5}, None, "s"]}
    [text] = values(spark, sanitise_properties(F.col("x")), json.dumps(deep))
    assert json.loads(text) == {
        "a": {"b": {"c": {"d": {"e": None}}}}, "Password": "REDACTED", "list": [{"token": "REDACTED", "n": 1.5}, None, "s"]}
    assert values(spark, sanitise_properties(F.col("x")), None, "broken", "[1]", "{}") == ["{}"] * 4
    wide = json.dumps({f"k{i:03}": i for i in range(150)})
    assert len(json.loads(values(spark, sanitise_properties(F.col("x")), wide)[0])) == 100


def test_merge_objects(spark):
    got = values(spark, merge_objects(F.col("a"), F.col("b")), ('{"x":1,"y":2}', '{"y":3,"z":4}'), (None, '{"a":1}'),
                 schema="a string, b string")
    assert [json.loads(g) for g in got] == [{"x": 1, "y": 3, "z": 4}, {"a": 1}]


def test_classes(spark):
    got = values(spark, source_class(F.col("x")), None, "", "https://WWW.Google.de", "https://youtube.com", "https://mail.x.de", "https://a.de")
    assert got == ["Direct", "Direct", "Search", "Social", "Email", "Referral"]
    reddit = "https://www.reddit.com/r"
    assert values(spark, social_platform(F.col("x")), reddit, "https://a.de") == ["Twitter/X", None]
    assert values(spark, social_platform(F.col("x"), "host"), reddit, "https://t.co/a") == ["Reddit", "Twitter/X"]
    assert values(spark, duration_bucket(F.col("x")), 9, 10, 59, 60, 600, schema="x int") == ["0-10s", "10-30s", "30s-1m", "1-3m", "10m+"]
    at_limit = [("LCP", 2500.0), ("CLS", 0.26), ("XYZ", 1.0)]
    assert values(spark, vital_rating(F.col("m"), F.col("v")), *at_limit, schema="m string, v double") == ["good", "poor", "unknown"]
    strict = vital_rating(F.col("m"), F.col("v"), inclusive=False)
    assert values(spark, strict, ("LCP", 2500.0), schema="m string, v double") == ["needs-improvement"]


def test_countries(spark):
    assert len(geo.NAME_BY_CODE) == 189 and all(len(c) == 2 for c in geo.NAME_BY_CODE)
    got = values(spark, geo.country_name(F.col("x")), "US", "Germany", "", None, "QQ")
    assert got == ["United States", "Germany", "Unknown", "Unknown", "QQ"]
    assert values(spark, geo.country_code(F.col("x")), "Germany", "Atlantis") == ["DE", "OTHER"]
    locales = spark.createDataFrame([(x, n) for n, x in enumerate(["en-IN", "zh-Hant-TW", "ko-kr", "de", "ca-AD", None, "", "x-IN", "de-Latn-AT-1996"])], "x string, n int")
    found = geo.with_locale_country(locales, "x", "country").orderBy("n").collect()
    assert [r["country"] for r in found] == ["India", "Taiwan", "South Korea", None, None, None, None, "India", "Austria"]
    assert values(spark, geo.ip_number(F.col("x")), "1.2.3.4", "256.1.1.1", "1.2.3", "::1", None) == [16909060, None, None, None, None]


def z_test(spark, *cells):
    stats = two_proportion_test(*[F.col(c) for c in "abcd"])
    df = spark.createDataFrame([cells], "a bigint, b bigint, c bigint, d bigint")
    return df.select(*[c.alias(n) for n, c in stats.items()]).first().asDict()


def test_two_proportions(spark):
    clear = z_test(spark, 100, 1000, 150, 1000)
    assert clear["significant"] and clear["reliable"] and clear["uplift"] == 50.0
    assert clear["z_score"] == 3.381 and clear["p_value"] == 0.0007 and clear["confidence"] == 99.9
    assert not z_test(spark, 100, 1000, 102, 1000)["significant"]
    few = z_test(spark, 1, 10, 3, 10)
    assert not few["reliable"] and not few["significant"] and few["p_value"] is not None
    empty = z_test(spark, 0, 0, 5, 10)
    assert empty == {"z_score": None, "p_value": None, "confidence": None, "significant": False, "uplift": None, "reliable": False}
    assert z_test(spark, 0, 10, 0, 10)["z_score"] is None
    everybody = z_test(spark, 10, 10, 10, 10)
    assert everybody["z_score"] is None and everybody["uplift"] == 0.0


def python_fnv(text):
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def test_variant_assignment(spark):
    texts = ["", "a", "foobar", "u_17:copy"]
    assert values(spark, fnv1a(F.col("x")), *texts) == [python_fnv(t) for t in texts]
    got = values(spark, assigned_variant(F.col("x"), F.lit("t"), ["a", "b", "c"]), "u1", "u2", "u3", "u4")
    assert got == ["abc"[python_fnv(f"u{i}:t") % 3] for i in (1, 2, 3, 4)]


@pytest.mark.parametrize("path, phrase", [
    ("/guides/email-templates", "email templates"), ("/blog/2026/03/best-crm-tools", "best crm tools"),
    ("/0:/7th%20Sem/", "7th sem"), ("/login", None), ("/", None), (None, None), ("/docs", None),
    ("/notes/", None), ("/papers/discrete_mathematics.pdf", "discrete mathematics"), ("/Contact-Us", None),
    ("/PM%20M-1.pdf", None), ("/a/MCN%20Notes%20by%20Annapurna%20ma_am.pdf", None),
    ("/x/waves%20(Derivation)?a=b", "waves derivation"), ("/p/100%25-cotton%zz", "100%25 cotton%zz"),
    ("/p/1234", None), ("/a+b-shirts", None), ("/red+shoes#top", "red shoes"),
])
def test_phrase_from_path(spark, path, phrase):
    df = spark.createDataFrame([(path,)], "path string")
    if path and "%zz" in path:  # a malformed escape leaves the whole path undecoded
        phrase = "100%25 cotton%zz"
    assert with_phrase(df).first().phrase == phrase
