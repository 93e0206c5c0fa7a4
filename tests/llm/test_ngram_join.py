"""Operator 12 against all pairs of documents."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from footfall.llm import ngram_join

SCHEMA = "doc_id long, text string, hi long, kind string, n int"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, size=4):
    w = words(text)
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, least=85):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for k, r in enumerate(rows):
        ids = [s[0] for g, s in zip(group, rows, strict=True) if g == group[k] and s[0] is not None]
        out.append((r[0], len(sets[k]), min(ids) if ids else None))
    return sorted(map(repr, out))


def corpus(seed=5, groups=12, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = rng.choices(vocabulary, k=70)
    texts = [None, "", " \t\n", "One two", "one TWO", "one two three", "two one", "a b c d", "A b c d e", "x" * 100 + " y", "x" * 100 + " z", "x" * 100 + " y",
             "Ä b c d", "ä b c d", "é\x0bé\x0cé\té"]
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([5, 20, 60, 200]))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy if rng.random() < 0.8 else copy + passage))
    for _ in range(15):
        texts.append(" ".join(rng.choices(vocabulary, k=30) + passage + rng.choices(vocabulary, k=30)))
    return [(None if k % 31 == 30 else k, t, 1, "doc", 2) for k, t in enumerate(texts)] + [(3, texts[20], 1, "doc", 2), (40, texts[40], 0, "", 0), (None, texts[21], 0, "", 0)]


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 300])
def test_same_as_all_pairs(spark, block):
    rows = corpus()
    got = ngram_join.join_ngrams(spark.createDataFrame(rows, SCHEMA).repartition(4), block=block)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(rows)


def test_large_group_of_near_copies_in_blocks(spark):
    rng = random.Random(2)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(150):
        copy = list(base)
        copy[rng.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(copy), 0, "", 0))
    # a chain that only its last link ties to the group
    far = list(base)
    for k in range(4):
        far[k * 9] = f"far{k}"
        rows.append((200 + k, " ".join(far), 0, "", 0))
    got = ngram_join.join_ngrams(spark.createDataFrame(rows, SCHEMA).repartition(3), block=1500)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(rows)


def test_other_threshold(spark):
    rows = corpus(seed=9, groups=5)
    got = ngram_join.join_ngrams(spark.createDataFrame(rows, SCHEMA), least=60)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(rows, 60)


def test_empty_table(spark):
    assert ngram_join.join_ngrams(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_trie_finds_every_link(seed):
    rng = np.random.default_rng(seed)
    base = np.sort(rng.choice(400, 60, replace=False))
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(30, 60)), replace=False), rng.choice(400, int(rng.integers(0, 12)))])) for _ in range(80)]
    sets += [sets[0], sets[1][:20], np.zeros(0, np.int64)]
    sizes = [len(s) + int(rng.integers(0, 4)) for s in sets]
    for least in (50, 70, 85):
        trie = ngram_join.Trie(sets, sizes, 400)
        for k, mine in enumerate(sets):
            wanted = {j for j, other in enumerate(sets) if len(mine) and len(other)
                      and 100 * (o := len(np.intersect1d(mine, other))) >= least * (sizes[k] + sizes[j] - o)}
            assert set(trie.linked(mine, sizes[k], least)) == wanted


def test_hashes_of_words():
    texts = ["a b", "ab", None, "", "  A\tb ", "z" * 70 + " " + "z" * 71, "é É"]
    found = ngram_join.ngram_sets(pa.array(texts, pa.string()).slice(0), 1)
    assert [len(f) for f in found] == [2, 1, 0, 0, 2, 2, 2]
    assert (found[0] == found[4]).all()
    sliced = ngram_join.ngram_sets(pa.array(texts, pa.string()).slice(4, 2), 1)
    assert all((a == b).all() for a, b in zip(sliced, found[4:6], strict=True))
