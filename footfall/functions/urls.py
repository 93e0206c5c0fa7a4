"""URL work as column expressions: hosts, query parameters, redaction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: names whose values are never stored (whole name, any case).
SENSITIVE_PATTERN = (
    r"(?i)^(?:token|access_?token|refresh_?token|id_?token|auth|authorization|password|passwd|pwd|secret|"
    r"client_?secret|api_?key|apikey|key|session|session_?id|sid|sso|otp|code|verification_?code|"
    r"confirm(?:ation)?_?token|reset_?token|invite|invitation|email|e_?mail|phone|signature|sig|hash)$"
)
REDACTED = "REDACTED"
MAX_URL = 2048
# Query parameters that hold an on-site search, first non-empty one wins.
SEARCH_PARAMETERS = ["q", "query", "search", "s", "keyword", "keywords", "term", "text", "find"]

_SCHEME = r"(?i)^[a-z][a-z0-9+.\-]*://"


def is_sensitive(name: Column) -> Column:
    return name.rlike(SENSITIVE_PATTERN)


def query_string(url: Column) -> Column:
    """Text between the first `?` and the fragment, NULL without one."""
    return F.nullif(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def _pair_name(pair: Column) -> Column:
    name = F.replace(F.substring_index(pair, "=", 1), F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(name), name)


def query_pairs(url: Column) -> Column:
    """Decoded query parameters in order, as an array of (name, value). Keep it in a column of its
    own when several parameters are looked up, so the URL is taken apart once."""
    def value(p: Column) -> Column:
        text = F.replace(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1), F.lit("+"), F.lit(" "))
        return F.coalesce(F.try_url_decode(text), text)

    return F.transform(F.split(query_string(url), "&"), lambda p: F.struct(
        _pair_name(p).alias("name"), value(p).alias("value")))


def pair_value(pairs: Column, name: str) -> Column:
    """Value of the first parameter of that name, NULL when absent."""
    return F.try_element_at(F.filter(pairs, lambda p: p["name"] == name), F.lit(1))["value"]


_WEB = r"(?i)^https?://"
_HOST = r"([^/?#@]*@)?(\[[0-9a-f:.]+\]|[^\s\[\]<>^|:/?#]+)(:\d{0,5})?([/?#]|\z)"


def sanitise_url(url: Column) -> Column:
    """Redact the values of sensitive parameters and drop the fragment; relative URLs stay
    relative. A web address whose host no parser takes loses its query whole. NULL becomes ''."""
    text = F.coalesce(url, F.lit(""))
    base = F.regexp_extract(text, r"(?s)^([^?#]*)", 1)
    pairs = F.transform(
        F.split(query_string(text), "&"),
        lambda p: F.when(
            is_sensitive(_pair_name(p)),
            F.concat(F.substring_index(p, "=", 1), F.lit("=" + REDACTED)),
        ).otherwise(p),
    )
    broken = text.rlike(_WEB) & ~text.rlike(_WEB + _HOST)
    query = F.when(~broken, F.concat(F.lit("?"), F.array_join(pairs, "&")))
    return F.substring(F.concat(base, F.coalesce(query, F.lit(""))), 1, MAX_URL)


def sanitise_referrer(url: Column) -> Column:
    """As `sanitise_url`, with NULL for nothing usable."""
    return F.nullif(sanitise_url(url), F.lit(""))


def extract_domain(url: Column) -> Column:
    """Host in lower case without `www.`, user and port; NULL when there is none."""
    rest = F.regexp_replace(url, _SCHEME, "")
    authority = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.regexp_extract(F.regexp_replace(authority, r"^.*@", ""), r"(?s)^([^:]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def domain_matches(candidate: Column, target: Column) -> Column:
    """The same site or a sub-domain of it; false when either side is missing."""
    c = F.regexp_replace(F.lower(candidate), r"^www\.", "")
    t = F.regexp_replace(F.lower(target), r"^www\.", "")
    same = (c == t) | c.endswith(F.concat(F.lit("."), t))
    return F.coalesce(same & (c != "") & (t != ""), F.lit(False))


def same_site(host: Column, site: Column) -> Column:
    """`domain_matches` for two hosts that already come from `extract_domain`."""
    return F.coalesce((host == site) | host.endswith(F.concat(F.lit("."), site)), F.lit(False))


def url_path(url: Column) -> Column:
    """Path part of an absolute or relative URL, `/` when empty."""
    rest = F.regexp_replace(url, r"(?i)^[a-z][a-z0-9+.\-]*://[^/?#]*", "")
    return F.coalesce(F.nullif(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit("")), F.lit("/"))
