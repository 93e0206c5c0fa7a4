"""Names that clash with the stages' own, repeated ids, glued and short words."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from footfall.llm import common, decontamination, mixing, quality_rules, simhash, toxicity

OWN = ["_llm_stats", "_llm_words", "_llm_hits", "_llm_items", "_llm_text", "_llm_text2", "_llm_rest", "_mix_n", "_mix_copies", "_mix_part",
       "_kept_doc_id", "other_mix_n", "_MIX_round"]
PROSE = [" ".join(f"word{(i * i * k + 3 * i + k) % 1009}" for i in range(120)) for k in range(1, 9)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 2}", *[100 * k + j for j in range(len(OWN))]) for k, t in enumerate(PROSE)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in OWN)
    return spark.createDataFrame(rows, schema)


def test_stages_keep_columns_that_are_called_like_theirs(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, " ".join(PROSE[5].split()[10:30]))], "item_id long, text string")
    whole = {tuple(r) for r in docs.collect()}
    for stage, kept in ((lambda d: quality_rules.keep_good(d, labels), whole), (lambda d: decontamination.keep_clean(d, benchmark), {r for r in whole if r[0] != 5}),
                        (simhash.keep_one, whole)):
        got = stage(docs)
        assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == kept
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= whole
    assert common.around(docs, lambda d: d).columns == docs.columns


@pytest.mark.parametrize("hot", [300, 1])
def test_equal_rows_share_what_the_mix_takes_of_them(spark, hot):
    rows = [(None if hot > 1 else 7, PROSE[0], "a", 5)] * hot + [(k, PROSE[k % 8], "b" if k % 3 else None, 5) for k in range(1, 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_n int").repartition(6)
    dealt = mixing.fair_queue(frame.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    want = dealt.groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    got = mixing.mix(frame).groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_a_repeated_id_does_not_crowd_out_the_others(spark):
    good = [" ".join(f"w{(k * i + i) % 89}" for i in range(60)) for k in range(60)]
    bad = [" ".join(f"w{(k * i + 2 * i) % 89} #" for i in range(60)) for k in range(60)]
    rows = [(k, t) for k, t in enumerate(good + bad)] + [(0, good[0])] * 600
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)], "doc_id long, quality int")
    assert quality_rules.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels, 130)


def test_glued_and_short_terms_are_found(spark):
    clean = [" ".join(f"w{(k * i + 7 * i) % 211}" for i in range(30)) + " you such a" for k in range(150)]
    toxic = [t + (" clown" if k % 2 else " git") for k, t in enumerate(clean[:120])]
    rows = list(enumerate(clean + toxic))
    labels = spark.createDataFrame([(k, int(k >= len(clean))) for k, _ in rows], "doc_id long, toxic int")
    frame = spark.createDataFrame([*rows, *[(160, toxic[10])] * 300, (None, "clown")], "doc_id long, text string")
    model = toxicity.learn(frame, labels)
    assert {"git", "clown"} <= set(model.words)
    asked = {1: clean[3], 2: clean[3] + " clown,loser", 3: clean[3] + " the clown here", 4: clean[3] + " trash/git...go", 5: clean[3] + " digit", 6: ""}
    scored = toxicity.score(spark.createDataFrame([*asked.items(), (None, "x")], "doc_id long, text string"), model)
    scores = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert min(scores[k] for k in (2, 3, 4)) > 0.5 > max(scores[k] for k in (1, 5, 6, None))
    flags = {r["doc_id"]: r["h"] for r in scored.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert flags == {k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k in flags}
