"""Operator 11 against slices of Python strings."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import fill_in_middle as fim

SCHEMA = "doc_id long, text string, output string, form string, n int"
TEXTS = [None, "", "a", "é", "😀", "漢字と仮名 mixed with ASCII 😀😀 and é", "has <P> inside", "<M>", "<S", "<", ">P<", "S>", "x" * 4000 + "é" * 4000, "line\nline\r\n", "\x00 nul"]


def brute(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k:8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text, text
    p, m, s = text[:i], text[i:j], text[j:]
    if h[3] % 100 < 20:
        return doc_id, len(text), "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(text), "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}", text


def test_same_as_slices(spark):
    rows = [(k if k % 17 else None, TEXTS[k % len(TEXTS)], "o", "f", 1) for k in range(20 * len(TEXTS))] + [(7, TEXTS[5], "o", "f", 1)] * 2
    done = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = done.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(r[0], r[1])) for r in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rates(spark):
    docs = spark.createDataFrame([(k, "some text", None, None, None) for k in range(50)], SCHEMA)
    assert {r["form"] for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(docs, rate=100, suffix_first=100).collect()} == {"spm"}


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("text", ["", "plain", "aé漢😀b" * 50])
def test_index_goes_both_ways(text):
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.Exceptions(data)
    ends = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == ends.tolist()
    assert index.to_points(ends).tolist() == list(range(len(text) + 1))
    assert len(index.bytes) == sum(ord(c) > 127 for c in text)
