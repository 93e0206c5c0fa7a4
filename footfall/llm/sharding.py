"""Byte-balanced contiguous shards from global prefix sums. DataFrame functions only.

Rows are ordered by doc_id, then size, checksum and text hash; rows equal in all of these are
interchangeable. Null text has no bytes (size: the overhead alone, checksum 0), null doc_id sorts first,
repeated rows are rows of their own, very long texts are never cut, an empty table gives no rows. Other
columns are not looked at, whatever their names. A shard differs from the target by about one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm.common import parts_for, stored, table, with_offsets

SHARDS = 24
#: Bytes that a document takes besides its text.
OVERHEAD = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Only ids, sizes and checksums are shuffled, by range, and written once, so that parts and sums stay
    as they are when a task runs again. Totals per part are summed over the parts, then rows within each
    part; a document goes to the shard in which its middle byte falls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("mark"))
    order = [F.col(c) for c in ("doc_id", "size", "text_crc32", "mark")]
    parted = stored(rows.repartitionByRange(parts_for(docs.count()), *order)
                    .withColumns({"part": F.spark_partition_id(), "one": F.lit(1).cast("long")}), "sizes")
    placed = with_offsets(parted, "part", order, {"before": "size", "row": "one"})
    total = parted.agg(F.sum("size").alias("total"))
    middle = F.expr(f"(2 * before + size) * {shards} div (2 * total)")
    dealt = placed.join(F.broadcast(total)).withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int"))
    first = dealt.groupBy("shard").agg(F.min("row").alias("first"))  # at most one row a shard
    return dealt.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"))
