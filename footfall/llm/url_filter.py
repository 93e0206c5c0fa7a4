"""URL filter: allow and block rules by host and path, and a weighted vocabulary found by Aho-Corasick.

Null or foreign input: a null url, or one without `://`, has an empty host and path and no rule; a null
url holds no term and is allowed. Repeated rows are judged alike, an empty table gives an empty result,
other columns of the input are not looked at, whatever their names. Very long urls are scanned whole, in
time proportional to their length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.llm.common import LOWER, UPPER, lower_ascii, table

#: One strict term rejects.
STRICT = ["adult", "casino", "hentai", "milf", "poker", "porn", "porno", "roulette", "sex", "sexy", "viagra",
          "cialis", "warez", "xxx"]
#: Several distinct soft terms reject: their weights must reach the threshold.
SOFT = ["ad", "ads", "bet", "bets", "betting", "bonus", "cams", "cash", "cheap", "click", "clicks", "crack", "deal",
        "deals", "discount", "dating", "escort", "farm", "free", "gamble", "girls", "hot", "jackpot", "keygen", "loan",
        "loans", "lottery", "nude", "offer", "offers", "pill", "pills", "pharma", "prize", "promo", "replica", "slots",
        "spam", "torrent", "track", "tracker", "tracking", "win", "winner", "x"]
THRESHOLD = 1.0
VOCABULARY = {t: THRESHOLD for t in STRICT} | {t: 0.5 for t in SOFT}
#: (verdict, host, path) of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def term_finder(vocabulary: dict[str, float]):
    """A pandas UDF: url -> distinct terms in it, in order. A term counts only between characters that
    are neither ASCII letters nor digits, or the ends. The vocabulary is a parameter of the job and goes
    to each task with the code; the automaton is built once a task."""
    words = {w.translate(str.maketrans(UPPER, LOWER)) for w in vocabulary if w}

    @F.pandas_udf("array<string>")
    def find(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        inside = frozenset(LOWER + "0123456789")
        fold = str.maketrans(UPPER, LOWER)
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        if words:
            automaton.make_automaton()

        def terms(url: str | None) -> list[str]:
            if not url or not words:
                return []
            text, found = url.translate(fold), set()
            for end, word in automaton.iter(text):
                start = end - len(word) + 1
                if (not start or text[start - 1] not in inside) and (end + 1 == len(text) or text[end + 1] not in inside):
                    found.add(word)
            return sorted(found)

        for batch in urls:
            yield batch.map(terms)

    return find


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (lower_ascii(F.regexp_extract(rest, r"^[^/?#]*+", 0)),
            F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; ties go to the earlier rule."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def judge_urls(pages: DataFrame, vocabulary: dict[str, float] = VOCABULARY, rules=RULES,
               threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, score (sum of the distinct terms' weights), terms. A fitting
    rule decides; else the url is blocked if its score reaches the threshold."""
    weights = F.create_map(*[x for w, v in sorted(vocabulary.items()) for x in (F.lit(w), F.lit(float(v)))]) if vocabulary else None
    host, path = host_and_path(F.col("url"))
    found = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({
        "host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")),
        "terms": term_finder(vocabulary)(F.col("url"))})
    score = F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.element_at(weights, t)) if vocabulary else F.lit(0.0)
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    return found.withColumns({"score": score, "fit": fit}).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "score", "terms")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def _sql() -> str:
    listed = ", ".join(f"('{w}', {v})" for w, v in sorted(VOCABULARY.items()))
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in RULES)
    return rf"""
WITH words(term, weight) AS (VALUES {listed}),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
cut AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT row_number() OVER () AS k, page_id, translate(url, '{UPPER}', '{LOWER}') AS low,
    translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
scores AS (
  SELECT k, sum(weight) AS score FROM parts
  JOIN words ON contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')
  GROUP BY k),
fits AS (
  SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY k)
SELECT page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN coalesce(score, 0) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM parts LEFT JOIN scores USING (k) LEFT JOIN fits USING (k)
"""


SQL = _sql()
