"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ten consecutive words of an item, or all words of a shorter one. Its shingles of five words
(or all of it) are ordered by how often the documents have them; a document that holds the window holds
its rarest shingle, so only that one is joined. Length and place bounds and the exact words decide.

Null and empty texts have no words and no hits; items without words have no window; an item without an id
marks words but is not listed. Repeated items and repeated documents are judged alike. Empty tables give
no hits or no rows. Very long texts are searched whole. Other columns are kept as they are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm.common import around, pieces, stored, table

WINDOW = 10
SHINGLE = 5
#: Items go to the tasks in blocks of about so many bytes of text; each block is one more pass of the same job.
BLOCK_BYTES = 16 << 20

_WORD_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
#: Lower-cases A-Z and makes every byte outside [^\x00-\x2F\x3A-\x60\x7B-\x7F] a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _marks(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit mark of each `size` consecutive ids."""
    n = max(0, len(ids) - size + 1)
    marks = np.zeros(n, np.uint64)
    for k in range(size):
        marks = marks * _FACTOR + (ids[k:k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        marks ^= marks >> np.uint64(29)
    return marks


@dataclass
class Index:
    """One block of items: vocabulary, distinct windows and the places of their shingles."""

    vocabulary: dict[bytes, int]
    windows: list[np.ndarray]
    items: list[list[str]]
    shingles: dict[int, np.ndarray]  # size -> sorted marks
    frequency: dict[int, np.ndarray] | None = None

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], window: int = WINDOW, shingle: int = SHINGLE) -> Index:
        vocabulary: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                holders.setdefault(tuple(ids[k:k + size]), set()).add(item)
        windows = [np.array(w, np.int64) for w in holders]
        marks: dict[int, list[np.ndarray]] = {}
        for w in windows:
            marks.setdefault(min(shingle, len(w)), []).append(_marks(w, min(shingle, len(w))))
        return cls(vocabulary, windows, [sorted(i for i in s if i is not None) for s in holders.values()],
                   {size: np.unique(np.concatenate(found)) for size, found in marks.items()})

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts' words, -1 for foreign ones, with a -1 behind each text; and the starts."""
        listed, starts, get = [], [0], self.vocabulary.get
        for text in texts:
            words = words_of(text)
            listed.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
            listed.append(np.array([-1]))
            starts.append(starts[-1] + len(words) + 1)
        return np.concatenate(listed), np.array(starts)

    def found(self, ids: np.ndarray, size: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids whose next `size` words have one of the sorted marks, and which."""
        inside = np.concatenate([[0], np.cumsum(ids >= 0)])
        n = max(0, len(ids) - size + 1)
        places = np.nonzero(inside[size:size + n] - inside[:n] == size)[0]
        if not len(places) or not len(marks):
            return places[:0], places[:0]
        own = _marks(ids, size)[places]
        at = np.minimum(np.searchsorted(marks, own), len(marks) - 1)
        hit = marks[at] == own
        return places[hit], at[hit]

    def prefixes(self, shingle: int = SHINGLE):
        """size -> (marks, first, window, offset): for each necessary shingle the windows that it opens."""
        if not hasattr(self, "_prefixes"):
            rows: dict[int, list[tuple[int, int, int]]] = {}
            for k, w in enumerate(self.windows):
                size = min(shingle, len(w))
                at = np.searchsorted(self.shingles[size], _marks(w, size))
                offset = int(np.argmin(self.frequency[size][at]))
                rows.setdefault(size, []).append((int(at[offset]), k, offset))
            self._prefixes = {}
            for size, listed in rows.items():
                listed.sort()
                at, window, offset = (np.array(x) for x in zip(*listed, strict=True))
                used, first = np.unique(at, return_index=True)
                self._prefixes[size] = (self.shingles[size][used], np.append(first, len(at)), window, offset)
            sizes = np.array([len(w) for w in self.windows])
            width = int(sizes.max()) if len(sizes) else 1
            padded = np.full((len(self.windows), width), -2)
            for k, w in enumerate(self.windows):
                padded[k, :len(w)] = w
            self._sizes, self._padded = sizes, padded
        return self._prefixes

    def search(self, texts: list[str | None]) -> list[tuple[int, list[int], list[str]]]:
        """For each text: number of words, places of hit words, items that occur."""
        ids, starts = self.ids(texts)
        steps = np.zeros(len(ids) + 1, np.int64)
        pairs = []
        for size, (marks, first, window, offset) in self.prefixes().items():
            places, which = self.found(ids, size, marks)
            count = first[which + 1] - first[which]
            rows = np.repeat(first[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            begin, w = np.repeat(places, count) - offset[rows], window[rows]
            within = (begin >= 0) & (begin + self._sizes[w] <= len(ids))
            begin, w = begin[within], w[within]
            for k in range(self._padded.shape[1]):  # the exact words, one place after another
                longer = self._sizes[w] > k
                same = np.ones(len(w), bool)
                same[longer] = ids[begin[longer] + k] == self._padded[w[longer], k]
                begin, w = begin[same], w[same]
            np.add.at(steps, begin, 1)
            np.add.at(steps, begin + self._sizes[w], -1)
            pairs.append(np.stack([np.searchsorted(starts, begin, side="right") - 1, w]))
        hit = np.nonzero(np.cumsum(steps)[:-1] > 0)[0]
        doc = np.searchsorted(starts, hit, side="right") - 1
        places: list[list[int]] = [[] for _ in texts]
        for d, p in zip(doc.tolist(), (hit - starts[doc]).tolist(), strict=True):
            places[d].append(p)
        items: list[set[str]] = [set() for _ in texts]
        for d, w in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist() if pairs else ():
            items[d].update(self.items[w])
        lengths = (np.diff(starts) - 1).tolist()
        return [(n, p, sorted(i)) for n, p, i in zip(lengths, places, items, strict=True)]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The distinct items in blocks of bounded size; only one block at a time comes to the driver. Items with
    the same text are spread over the blocks by their ids."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r[0], r[1]) for r in own.collect()]


def weigh(index: Index, docs: DataFrame) -> None:
    """Counts the block's shingles in all documents: summed in each task, one row a shingle comes back."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {size: np.zeros(len(marks), np.int64) for size, marks in index.shingles.items()}
        for piece in pieces(batches):
            ids, _ = index.ids(piece.column("text").to_pylist())
            for size, marks in index.shingles.items():
                total[size] += np.bincount(index.found(ids, size, marks)[1], minlength=len(marks))
        for size, found in total.items():
            used = np.nonzero(found)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), size)), pa.array(used), pa.array(found[used])], ["size", "shingle", "n"])

    summed = docs.select("text").mapInArrow(counts, "size long, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n"))
    index.frequency = {size: np.zeros(len(marks), np.int64) for size, marks in index.shingles.items()}
    for row in summed.collect():  # at most one row a shingle of the block
        index.frequency[row["size"]][row["shingle"]] = row["n"]


def annotate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with _llm_words, _llm_hits (places) and _llm_items. Every block of items passes over
    the same rows in turn; nothing is shuffled or joined by document. What a block has found is written
    before the next one starts, so a task holds one block's index and a lost executor costs one pass."""
    columns = docs.columns
    found = docs.withColumns({"_llm_words": F.lit(0).cast("long"), "_llm_hits": F.array().cast("array<long>"),
                              "_llm_items": F.array().cast("array<string>")})
    for k, rows in enumerate(item_blocks(benchmark, block_bytes)):
        index = Index.of(rows)
        weigh(index, docs)
        if k:
            found = stored(found, "annotated")

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches):
                new = index.search(piece.column("text").to_pylist())
                hits = [sorted({*a, *b[1]}) for a, b in zip(piece.column("_llm_hits").to_pylist(), new, strict=True)]
                items = [sorted({*a, *b[2]}) for a, b in zip(piece.column("_llm_items").to_pylist(), new, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in columns], pa.array([r[0] for r in new], pa.int64()),
                     pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], found_schema)

        found_schema = [*columns, "_llm_words", "_llm_hits", "_llm_items"]
        found = found.mapInArrow(search, found.schema)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a word inside an item's window, all columns as they are."""
    return around(docs, lambda own: annotate(own, benchmark).where(F.size("_llm_hits") == 0).select(*own.columns))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("_llm_words").alias("n_words"), F.size("_llm_hits").cast("long").alias("n_hit"),
        F.size("_llm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_llm_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_llm_hits") > 0).alias("contaminated"))


SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(10, len(words)) AS size, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS window_text
  FROM (SELECT item, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM item_words WHERE len(words) > 0)),
doc_windows AS (
  SELECT k, size, i, array_to_string(words[i:i + size - 1], ' ') AS window_text
  FROM (SELECT k, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM doc_words, (SELECT DISTINCT size FROM item_windows))),
hits AS (SELECT k, item, i, d.size FROM doc_windows d JOIN item_windows w ON d.size = w.size AND d.window_text = w.window_text),
places AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS p FROM hits) GROUP BY k),
listed AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY k)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN places USING (k) LEFT JOIN listed USING (k)
"""
