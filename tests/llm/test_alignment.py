"""Operator 13 against a plain form that encodes whole texts by the libraries and counts pairs in dictionaries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from footfall.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, chunk int, part int, kind string"
PARTS = ["a", "B", "the", " ", "  ", "\n", "é", "　", "▁", "\x00", "\xa0", "ﬁ", "漢", "😀", "<s>", "</s>", "<0x0A>", "\t", "́", "<|endoftext|>", "12", "'s", " word", "."]


def texts() -> list[str | None]:
    rng = random.Random(7)
    hostile = ["".join(rng.choices(PARTS, k=rng.randint(1, 30))) for _ in range(60)]
    prose = ["The committee's report wasn't finished; it'll follow in 2024.", "Größe und Maß", "x" * 5000, " " * 3000 + "x", "one  two   three\n\nfour "]
    single = [" ".join(rng.choices([p for p in PARTS if p.strip() and "▁" not in p], k=9)) for _ in range(25)]
    return [None, "", " ", *single, *prose, *hostile, prose[0], prose[0]]


def brute(rows: list[tuple]) -> list[tuple]:
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    other = [b for b in range(256) if b not in alignment.PRINTED]
    letter = {chr(b): b for b in alignment.PRINTED} | {chr(256 + k): b for k, b in enumerate(other)}
    found, holders = [], Counter()
    for _, text, *_ in rows:
        raw = (" " + (text or "")).encode()
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(letter[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            found.append(([], [], [], ""))
            continue
        a_ends, b_ends = np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                 if max(a_ends[i] - len(a_bytes[i]), b_ends[j] - len(b_bytes[j])) < min(a_ends[i], b_ends[j])] if len(raw) < 2000 else fast(a, b, a_ends, b_ends)
        groups, last = [], 0
        for end in sorted(set(a_ends) & set(b_ends)):
            groups.append(",".join(str(i) for i, e in zip(a, a_ends, strict=True) if last < e <= end) + "|"
                          + ",".join(str(i) for i, e in zip(b, b_ends, strict=True) if last < e <= end))
            last = end
        found.append((a, b, links, ";".join(groups)))
        holders.update(set(links))
    highest = defaultdict(int)
    for (i, _), n in holders.items():
        highest[i] = max(highest[i], n)
    return [(row[0], len(a), len(b), g.count("|"), len(links), sum(holders[p] == highest[p[0]] for p in links), sum(holders[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for row, (a, b, links, g) in zip(rows, found, strict=True)]


def fast(a, b, a_ends, b_ends):
    return [(a[int(np.searchsorted(a_ends, e))], b[int(np.searchsorted(b_ends, e))]) for e in sorted({*a_ends, *b_ends})]


def test_same_as_brute_force(spark):
    rows = [(k % 60 if k % 13 else None, t, "x", 1, 2, "run") for k, t in enumerate(texts())]
    got = alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def test_one_hot_text(spark):
    rows = [(k, "the same text " * 3 if k % 3 else f"text {k}", "", 0, 0, "") for k in range(90)]
    got = alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(5), A, B, parts=40)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_counts_and_groups_are_kept(spark):
    rows = [(1, "alpha beta", "", 0, 0, ""), (2, "alpha", "", 0, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    told = {r["doc_id"]: r for r in alignment.align(docs, A, B, groups=True).collect()}
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in told.values())
    counts = alignment.pair_counts(alignment.chunks(docs, A, B, 16)).collect()
    assert max(r["docs"] for r in counts) == 2 and all(r["best"] for r in counts if r["docs"] == 2)


@pytest.mark.parametrize("many", [1, 7, 512])
def test_words_together_as_alone(monkeypatch, many):
    monkeypatch.setattr(alignment, "WORDS", many)
    two, words = alignment.pair(A, B), [t for t in [*"ab", "word", "Größe", "ﬁn", "漢字", "it'll", "\x00", "x\ny", "12a", "😀", "<s>", "１"] * 3]
    together, alone = alignment.align_words(words, two), alignment.align_texts(words, two)
    assert together.groups == alone.groups and (together.good == alone.good).all()
    assert (together.figures == alone.figures).all() and (together.pairs == alone.pairs).all()


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_runs_merge_over_blocks(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 7)
    rng = np.random.default_rng(3)
    runs, total = [], Counter()
    for _ in range(9):
        keys = np.unique(rng.integers(0, 300, 80))
        counts = rng.integers(1, 50, len(keys))
        runs.append(alignment.run_of(keys, counts))
        total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    keys, counts = alignment.merged(runs)
    assert keys.tolist() == sorted(total) and counts.tolist() == [total[k] for k in sorted(total)]


@pytest.mark.parametrize("seed", range(3))
def test_ranks_give_the_file_s_ids(seed):
    a_side = alignment.ByteLevel(A)
    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    rng = random.Random(seed)
    for _ in range(1500):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 25)))
        assert a_side.encode(" " + text) == plain.encode(" " + text, add_special_tokens=False).ids
