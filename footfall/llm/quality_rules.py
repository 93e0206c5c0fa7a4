"""Quality rules: a decision list learned by sequential covering, applied as Spark expressions.

Null and empty texts have no words and fail the base check. Repeated rows are judged alike, each on its
own. Labels without a quality, or that name no document, are not used; a document labelled twice has the
lower label. Without labels of both kinds there are no rules and the base check alone decides. Ties in
growing a rule go to the first feature and the lowest threshold. Other columns are kept as they are."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.llm.common import around, table

#: Labelled rows that the rules are fitted on at most: those whose doc_id has the lowest MD5.
SAMPLE_ROWS = 20_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A rule must be right about so many of the rows held back for pruning.
MIN_PRECISION = 0.95
MAX_CONDITIONS = 3
MAX_RULES = 12
THRESHOLDS = 64

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines"]
#: name: (numerator, denominator)
FEATURES = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
            "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
            "distinct": ("n_distinct", "n_words"), "words_a_line": ("n_words", "n_lines")}


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight that the list has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    marks = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + marks[k:k + n]
    _, place, counts = np.unique(sums, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    twice = (counts[place] > 1).astype(np.int64)
    steps = np.zeros(len(words) + 1, np.int64)
    steps[:n] += twice
    steps[WINDOW:WINDOW + n] -= twice
    return int((np.cumsum(steps)[:-1] > 0).sum())


def stats_of(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0, 0, 0, 0, 0, 0, 1)
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at [\x20\x09-\x0D]
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    blank = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (len(words), len(text) - blank, sum(map(text.count, "#*$%&|<>")), dup, repeated_words(words),
            len(set(words)), len(lines))


def stats_frame(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stats_of(t) for t in texts], columns=STATS, dtype="int64")


def text_stats(text: str) -> Column:
    """Struct of STATS. Marked as not deterministic, else a filter on it would run it twice."""
    return F.pandas_udf(stats_frame, ", ".join(f"{s} long" for s in STATS)).asNondeterministic()(F.col(text))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] >= self.threshold if self.above else values[self.feature] <= self.threshold

    def column(self, stats: str) -> Column:
        top, bottom = (F.col(f"{stats}.{c}") for c in FEATURES[self.feature])
        ratio = F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))
        return ratio >= F.lit(self.threshold) if self.above else ratio <= F.lit(self.threshold)


def _gain(pos: float, neg: float, pos_before: float, neg_before: float) -> float:
    return pos * (np.log2(pos / (pos + neg)) - np.log2(pos_before / (pos_before + neg_before))) if pos else 0.0


def grow(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule, covered = [], np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad & covered).any():
        pos, neg = int((bad & covered).sum()), int((~bad & covered).sum())
        best, most = None, 1e-9
        for name in FEATURES:
            cuts = np.unique(np.quantile(values[name][covered & bad], np.linspace(0, 1, THRESHOLDS)))
            for above in (True, False):
                for cut in cuts:
                    new = Condition(name, above, float(cut))
                    under = covered & new.holds(values)
                    gain = _gain((bad & under).sum(), (~bad & under).sum(), pos, neg)
                    if gain > most:
                        best, most = new, gain
        if best is None:
            break
        rule.append(best)
        covered &= best.holds(values)
    return rule


def prune(rule: list[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[list[Condition], float]:
    """The leading conditions that do best on the rows held back, and their precision there."""
    best, worth, precision, covered = [], -2.0, 0.0, np.ones(len(bad), bool)
    for k, condition in enumerate(rule, 1):
        covered = covered & condition.holds(values)
        pos, neg = int((bad & covered).sum()), int((~bad & covered).sum())
        if pos + neg and (pos - neg) / (pos + neg) > worth:
            best, worth, precision = rule[:k], (pos - neg) / (pos + neg), pos / (pos + neg)
    return best, precision


def cover(frame: pd.DataFrame) -> list[list[Condition]]:
    """The decision list: each rule is grown on two thirds of the rows that are left and pruned on the
    rest; rows that it covers go. It ends with the first rule that isn't precise enough."""
    values = {f: np.divide(frame[a], frame[b], out=np.zeros(len(frame)), where=frame[b].to_numpy() > 0) for f, (a, b) in FEATURES.items()}
    bad, left = frame["quality"].to_numpy() == 0, np.ones(len(frame), bool)
    held = np.arange(len(frame)) % 3 == 2
    rules: list[list[Condition]] = []
    pick = lambda rows: ({f: v[rows] for f, v in values.items()}, bad[rows])
    while len(rules) < MAX_RULES and (bad & left & ~held).sum() >= 5 and (~bad & left & ~held).any():
        rule, precision = prune(grow(*pick(left & ~held)), *pick(left & held))
        if not rule or precision < MIN_PRECISION:
            break
        rules.append(rule)
        inside = np.logical_and.reduce([c.holds(values) for c in rule])
        left &= ~inside
    return rules


def base_failed(stats: str = "stats") -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < MIN_WORDS) | (r * 100 > n * MAX_REPEAT_PERCENT)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """The rules from at most `sample_rows` labelled documents; only their statistics come to the driver. Of rows
    that repeat a doc_id one counts, that with the smallest text hash."""
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    mark = F.md5(F.col("doc_id").cast("string"))
    sample = named.orderBy(mark, "doc_id").limit(sample_rows)  # its size is bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        "doc_id", "quality", F.struct(F.xxhash64("text").alias("mark"), text_stats("text").alias("stats")).alias("row"))
    once = rows.groupBy("doc_id", "quality").agg(F.min("row").alias("row")).select("doc_id", "quality", "row.stats").where(~base_failed())
    frame = once.select("doc_id", "quality", "stats.*").toPandas()
    if frame["quality"].nunique() < 2:
        return []
    frame["mark"] = frame["doc_id"].map(lambda i: (i * 0x9E3779B97F4A7C15) % (1 << 64))
    return cover(frame.sort_values(["mark", *STATS]).reset_index(drop=True))


def verdict(rules: list[list[Condition]], stats: str = "stats") -> Column:
    """True if the document is kept: the first rule that holds rejects, none keeps."""
    chain = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column(stats)
        chain = chain.when(holds, F.lit(False))
    return chain.otherwise(F.lit(True))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base check nor a rule rejects, all columns as they are."""
    rules = learn(docs, labels)
    return around(docs, lambda own: own.withColumn("_llm_stats", text_stats("text")).where(verdict(rules, "_llm_stats")).drop("_llm_stats"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", text_stats("text").alias("stats")).select(
        "doc_id", *[F.col(f"stats.{s}") for s in STATS[:5]], base_failed().alias("base_failed"), verdict(rules).alias("kept"))
