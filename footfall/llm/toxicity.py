"""Toxicity: misspelled lexicon terms by Levenshtein automata over a trie, scored with their context.

The lexicon is learned from labelled texts: words, and beginnings of words, that toxic texts have and others
hardly do. Every such word is matched with its errors, also where its beginning is a stem. Rows without a label, a text or a doc_id are not learned from. Without labels of both kinds
the lexicon is empty and every score is the share of toxic labels, 0 if there are none. Null and empty
texts have no hits; their score is that of a text without hits. Repeated rows score alike; of rows that repeat a
labelled doc_id one is learned from; terms that tie are all kept. A null doc_id is never held out. Words are parted
by all that is neither letter, digit nor quotation mark, and words of any length may be terms. Very long texts
are searched whole; an empty table gives no rows. Other columns are not looked at, whatever their names."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from footfall.llm.common import pieces, table

#: Labelled texts to learn from at most: those whose doc_id has the lowest MD5.
SAMPLE_ROWS = 20_000
MIN_TEXTS = 8
#: Of the texts that have a term so many are toxic at least; its weight is the log-odds.
MIN_SHARE = 0.5
STEM = (4, 8)
#: So many words on either side decide whether a hit is a quotation.
CONTEXT = 8
FOLDS, HELD_OUT = 5, 0

QUOTES = "\"'“”„‘’‚«»‹›`"
#: Words of saying and naming; a hit near one of them, and between quotes, is reported and not used.
REPORTING = frozenset(["said", "says", "say", "called", "calls", "call", "quote", "quoted", "quotes", "word", "words", "term",
                       "wrote", "writes", "insult", "slur", "dit", "appelé", "mot", "sagte", "nannte", "wort", "dijo", "llamó", "palabra"])


#: Neither letters, digits, marks on letters nor quotation marks: these part words.
_BETWEEN = rf"[^\pL\pN\pM{QUOTES}]+"


def words_of(texts: pa.Array) -> pa.Array:
    """The words of each text, with the quotation marks at their ends."""
    return pc.split_pattern(pc.replace_substring_regex(pc.fill_null(texts, ""), _BETWEEN, " "), " ")


def words_in(word: str) -> str:
    """The word without what isn't a letter or digit at its ends, in lower case."""
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end].lower()


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Trie of terms, searched with a word's Levenshtein automaton.

    A state is the set of (trie node, edits so far) that some spelling error leads to; states are made when
    a word first needs them and kept, so a word costs one look-up a letter. Stems accept every ending and
    no errors."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, float]] = {}
        self.stems: dict[int, float] = {}
        self.room: list[int] = [0]
        for term, weight in words.items():
            self.ends[self._add(term, edits_allowed(term))] = (edits_allowed(term), weight)
        for stem, weight in stems.items():
            self.stems[self._add(stem, 0)] = weight
        self.states: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.stemmed: list[float] = []
        self.start = self._state({0: 0})

    def _add(self, term: str, edits: int) -> int:
        node = 0
        self.room[0] = max(self.room[0], edits)
        for letter in term:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.room.append(0)
            node = self.children[node][letter]
            self.room[node] = max(self.room[node], edits)
        return node

    def _state(self, least: dict[int, int]) -> int:
        """The state of the given nodes with their fewest edits, letters of the term left out included."""
        queue = list(least.items())
        for node, edits in queue:
            if edits < self.room[node]:
                for child in self.children[node].values():
                    if edits + 1 <= self.room[child] and least.get(child, 99) > edits + 1:
                        least[child] = edits + 1
                        queue.append((child, edits + 1))
        key = frozenset(least.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(dict(least))
            self.steps.append({})
            self.stemmed.append(max((self.stems.get(n, 0.0) for n, e in least.items() if e == 0), default=0.0))
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        least: dict[int, int] = {}
        for node, edits in self.states[state].items():
            if edits < self.room[node] and least.get(node, 99) > edits + 1:
                least[node] = edits + 1  # a letter too many
            for own, child in self.children[node].items():
                cost = edits + (own != letter)
                if cost <= self.room[child] and least.get(child, 99) > cost:
                    least[child] = cost
        new = self._state(least) if least else -1
        self.steps[state][letter] = new
        return new

    def match(self, word: str) -> tuple[int, float]:
        """Kind and weight. 0: no term; 1: a term, or an ending of a stem (the longest); 2: a misspelled term."""
        state, begun = self.start, 0.0
        for letter in word:
            known = self.steps[state].get(letter)
            state = self._step(state, letter) if known is None else known
            if state < 0:
                return (1, begun) if begun else (0, 0.0)
            begun = self.stemmed[state] or begun
        close = 0.0
        for node, edits in self.states[state].items():
            if node in self.ends and edits <= self.ends[node][0]:
                if edits == 0:
                    return 1, self.ends[node][1]
                close = max(close, self.ends[node][1])
        return (1, begun) if begun else (2, close) if close else (0, 0.0)


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: list[float]  # of FEATURES, then the constant

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)))


#: weight of exact hits in use, of misspelled hits in use, of quoted hits, and of hits in use for each hundred
#: words; all as log(1 + n)
FEATURES = 4
#: Where the weights are drawn to when the labels say nothing about a feature.
PRIOR = np.array([2.0, 1.0, 0.0, 0.0])
PULL = 0.5


def features_of(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of features a text. Distinct words are matched once; only the words around hits are looked at."""
    lists = words_of(texts)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    matches = [lexicon.match(core) if (core := words_in(w)) else (0, 0.0) for w in words]
    kinds = np.array([m[0] for m in matches], np.int64)
    codes, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    counts = np.zeros((len(texts), 3))
    places = np.nonzero(kinds[codes] > 0)[0] if len(words) else np.zeros(0, np.int64)
    for place, doc in zip(places.tolist(), (np.searchsorted(bounds, places, side="right") - 1).tolist(), strict=True):
        first, last = max(bounds[doc], place - CONTEXT), min(bounds[doc + 1], place + CONTEXT + 1)
        before = [words[c] for c in codes[first:place + 1]]
        after = [words[c] for c in codes[place:last]]
        quoted = any(w[:1] in QUOTES for w in before if w) and any(w.rstrip(".,;:!?)")[-1:] in QUOTES for w in after if w.rstrip(".,;:!?)"))
        near = [words_in(w) for w in before[-4:-1]]
        reported = any(w in REPORTING for w in near)
        counts[doc, 2 if quoted or reported else kinds[codes[place]] - 1] += matches[codes[place]][1]
    used = counts[:, 0] + counts[:, 1]
    share = 100 * used / np.maximum(1, np.diff(bounds))
    return np.log1p(np.column_stack([counts, share]))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id, text, toxic of the labelled rows to learn from; never of a held-out row."""
    named = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = named.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample_rows)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    # of rows that repeat a doc_id one counts, that with the smallest text hash
    once = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("row"))
    return once.select("doc_id", "row.text", "toxic")


def held_out():
    """A row without a doc_id is not held out; nothing is learned from it either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that are mostly in toxic texts, with their weights. Near copies count once: of texts with the same
    smallest hash of five words in a row, one is counted. Counts are summed in the tasks first."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = piece.column("text").to_pylist()
            found = []
            for text in texts:
                words = text.split()
                found.append(min((zlib.crc32(" ".join(words[k:k + 5]).encode()) for k in range(max(1, len(words) - 4))), default=0))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text"), piece.column("toxic").cast(pa.int64()), pa.array(found, pa.int64())],
                                             ["doc_id", "text", "toxic", "mark"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
            for words, toxic in zip(words_of(piece.column("text")).to_pylist(), piece.column("toxic").to_pylist(), strict=True):
                own = {(c, True) for w in set(words) if (c := words_in(w))}
                own |= {(c[:k], False) for c, _ in list(own) for k in range(STEM[0], min(STEM[1], len(c)) + 1)}
                for key in own:
                    found[key][toxic] += 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                 pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.int64())], ["term", "whole", "clean", "toxic"])

    once = rows.mapInArrow(marks, "doc_id long, text string, toxic long, mark long").withColumn(
        "rank", F.row_number().over(W.partitionBy("toxic", "mark").orderBy("doc_id"))).where("rank = 1")
    sums = once.select("text", "toxic").mapInArrow(counts, "term string, whole boolean, clean long, toxic long").groupBy("term", "whole").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1)
    # as many as the sampled rows bear out; a beginning that has the counts of a whole word adds nothing
    best = sums.withColumn("share", share).where((F.col("toxic") >= MIN_TEXTS) & (F.col("share") >= MIN_SHARE)).orderBy(
        F.desc("toxic"), "term", "whole").collect()
    weight = {(r["term"], r["whole"]): float(np.log(r["share"] / (1 - r["share"]))) + 1 for r in best}
    count = {(r["term"], r["whole"]): r["toxic"] for r in best}
    words = {t: w for (t, whole), w in weight.items() if whole}
    # a word without inflected forms needs no stem; a stem beside words catches their other endings
    alone = {t for t in words if len(t) >= STEM[0]
             and all(count[t, True] >= 0.9 * count.get((t[:k], False), 0) for k in range(STEM[0], min(STEM[1], len(t)) + 1))}
    beginnings = {t[:k] for t in alone for k in range(STEM[0], len(t) + 1)}
    stems = {t: w for (t, whole), w in weight.items()
             if not whole and t not in beginnings and not any(t[:k] in alone for k in range(STEM[0], len(t) + 1))}
    return words, stems


def fit(features: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Weights by Newton's method on the logistic loss, drawn to PRIOR."""
    x = np.column_stack([features, np.ones(len(features))])
    prior, pull = np.append(PRIOR, 0.0), np.append(np.full(FEATURES, PULL), 0.0) + 1e-6
    weights = np.append(PRIOR, -2.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - toxic) + pull * (weights - prior)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        weights = weights - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return weights.tolist()


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    rows = training_rows(docs, labels, sample_rows)
    kinds = Counter({bool(r["toxic"]): r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()})
    if not kinds[True] or not kinds[False]:
        share = kinds[True] / max(1, kinds.total())
        return Model({}, {}, [0.0] * FEATURES + [30.0 if share else -30.0])
    words, stems = learn_lexicon(rows.withColumn("toxic", (F.col("toxic") > 0).cast("long")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, stems)
        for piece in pieces(batches):
            found = features_of(piece.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("toxic").cast(pa.int64()), *[pa.array(c) for c in found.T]],
                                             ["doc_id", "toxic", *[f"f{k}" for k in range(FEATURES)]])

    schema = "doc_id long, toxic long, " + ", ".join(f"f{k} double" for k in range(FEATURES))
    frame = rows.mapInArrow(measure, schema).toPandas().sort_values(["doc_id", "toxic"])  # one row of numbers a sampled text
    return Model(words, stems, fit(frame[[f"f{k}" for k in range(FEATURES)]].to_numpy(), (frame["toxic"] > 0).to_numpy().astype(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.words, model.stems)
        for piece in pieces(batches):
            found = model.score(features_of(piece.column("text"), lexicon))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
