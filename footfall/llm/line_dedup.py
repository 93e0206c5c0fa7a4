"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased; its hash is 128 bits (MD5).
Null and empty texts have one empty line and stay. Rows with a null doc_id keep all lines and are not
counted. Rows that repeat a doc_id are one document: a line that several of them hold counts once, and
where that doc_id keeps a line all its rows do. Ties cannot occur otherwise. Empty tables give empty
results, texts are taken whole, and other columns are not looked at, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm.common import SPACE, pieces, shared_path, stored, table

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
#: So many runs of a level are merged into one of the next.
FANOUT = 2


class SortedRuns:
    """Runs of (key, keeper), each written in key order, on levels. A key is in one run only."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def _write(self, frame: DataFrame, level: int) -> None:
        path = shared_path(self.spark, f"run-{level}")
        frame.repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "zstd").parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, frame: DataFrame) -> None:
        """The frame as a new run; full levels are compacted, from the lowest on."""
        self._write(frame, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self.spark.read.schema("key binary, keeper long").parquet(*full), level + 1)
            level += 1

    def known(self) -> DataFrame:
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "key binary, keeper long")
        return self.spark.read.schema("key binary, keeper long").parquet(*paths)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The batch's keys that no run holds: a merge anti-join on the key."""
        return batch.join(self.known().hint("merge"), "key", "left_anti")


def line_key(line: str, min_chars: int) -> bytes | None:
    """Hash of the line's key; None if the key is too short."""
    core = line.strip(SPACE)
    return hashlib.md5(core.encode("utf-8", "surrogatepass").lower()).digest() if len(core) >= min_chars else None


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, key: each long line's hash once a row of docs."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, found = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {k for line in (text or "").split("\n") if (k := line_key(line, min_chars))}
                ids += [doc_id] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "key"])

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(keys, "doc_id long, key binary")


def keepers(lines: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """key, keeper: the largest doc_id of each key that `min_docs` documents hold at least.

    The documents come in batches of descending doc_id. A batch's lines are reduced to one row a key
    before they meet anything, so a very common line is a few rows. Of a batch's keys only those that no
    earlier run holds are added: their keeper is the largest doc_id of all."""
    spark = lines.sparkSession
    cuts = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    batch = sum((F.when(F.col("doc_id") <= c, 1).otherwise(0) for c in cuts), F.lit(0))
    heads = stored(lines.withColumn("batch", batch).groupBy("key", "batch").agg(
        F.countDistinct("doc_id").alias("docs"), F.max("doc_id").alias("keeper")), "heads")
    often = heads.groupBy("key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("key")
    common = stored(heads.join(often, "key", "left_semi").select("key", "keeper", "batch"), "common")
    runs = SortedRuns(spark)
    for k in range(len(cuts) + 1):
        runs.add(runs.fresh(common.where(F.col("batch") == k).select("key", "keeper")))
    return runs.known()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: the text without the lines that a later document keeps."""
    lines = stored(long_lines(docs, min_chars), "lines")
    goes = lines.join(keepers(lines, min_docs, batches), "key").where("doc_id <> keeper")
    dropped = goes.groupBy("doc_id").agg(F.collect_set("key").alias("dropped"))
    texts = docs.select("doc_id", "text").join(dropped, "doc_id", "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist(), strict=True):
                split = (text or "").split("\n")
                gone = set(gone or ())
                kept = [x for x in split if line_key(x, min_chars) not in gone] if gone else split
                rows.append((len(split), len(split) - len(kept), "\n".join(kept)))
            counts = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts], ["doc_id", "n_lines", "n_dropped", "kept"])

    return texts.mapInArrow(keep, "doc_id long, n_lines long, n_dropped long, kept string")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT doc_id, line, pos, keeper IS NOT NULL AND doc_id <> keeper AS goes FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
