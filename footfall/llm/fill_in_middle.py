"""Fill-in-middle: each text is cut at two drawn places and its parts are put in another order.

Cuts are drawn in code points and made in bytes. A sparse index holds, for each multibyte character of a
piece of texts, its place and how many bytes it has beyond one; all else is arithmetic. `searchsorted` over
the index turns code points into bytes and back for all texts of a piece at once.

The draws come from the SHA-256 of the doc_id, so rows that repeat a doc_id and a text come out alike; a null
doc_id draws as an empty one. Null texts are empty. Empty texts and texts that hold a marker stay plain.
Very long texts are cut whole, an empty table gives no rows, other columns are not looked at, whatever
their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.llm.common import pieces, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that are cut, and of those that begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
SALT = 1


class Exceptions:
    """The multibyte characters of a run of UTF-8 bytes: where each is, as a byte and as a code point, and
    how many bytes those before it have beyond one each."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.nonzero(data >= 0xC0)[0]
        lead = data[self.bytes]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
        self.points = self.bytes - self.excess[:-1]

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte; the bytes begin characters."""
        return at - self.excess[np.searchsorted(self.bytes, at)]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """The byte at which each code point begins."""
        return at + self.excess[np.searchsorted(self.points, at)]


def draws(doc_id: object, salt: int = SALT) -> list[int]:
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12)]


def _piece(ids: pa.Array, texts: pa.Array, rate: int, suffix_first: int, salt: int) -> list[pa.Array]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    index = Exceptions(data)
    starts = index.to_points(bounds)
    n = np.diff(starts)
    h = np.array([draws(d, salt) for d in ids.to_pylist()], np.int64).reshape(-1, 4)
    marked = pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}").to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[:, 2] % 100 >= rate)
    spm = ~plain & (h[:, 3] % 100 < suffix_first)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    first, second = np.minimum(one, two), np.maximum(one, two)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    whole, out = data.tobytes(), []
    for a, i, j, b, kept, other in zip(bounds[:-1].tolist(), index.to_bytes(starts[:-1] + first).tolist(),
                                       index.to_bytes(starts[:-1] + second).tolist(), bounds[1:].tolist(),
                                       plain.tolist(), spm.tolist(), strict=True):
        if kept:
            out.append(whole[a:b])
        elif other:
            out.append(b"".join([s, whole[j:b], p, whole[a:i], m, whole[i:j]]))
        else:
            out.append(b"".join([p, whole[a:i], s, whole[j:b], m, whole[i:j]]))
    return [ids, pa.array(n), pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
            pa.array(first, mask=plain), pa.array(second - first, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, salt: int = SALT) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays(_piece(piece.column("doc_id"), piece.column("text"), rate, suffix_first, salt),
                                             ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(
        rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No cut text holds a marker, so the markers are the output's own."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
drawn AS (
    SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
           n = 0 OR regexp_matches(text, '<P>|<S>|<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 AS plain,
           ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 AS suffix_first
    FROM hashed),
cut AS (
    SELECT *, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form, least(a, b) AS i, greatest(a, b) AS j
    FROM drawn),
parts AS (SELECT *, substr(text, 1, i) AS p, substr(text, i + 1, j - i) AS m, substr(text, j + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN i END AS prefix_chars, CASE WHEN NOT plain THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
              ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
