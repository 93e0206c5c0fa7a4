"""SimHash near-dedup with deletion-variant signatures.

Fingerprints of 64 bits over word shingles; documents link at so many differing bits or fewer. The bits are
cut into three segments: of four differing bits one segment has at most one, so two linked fingerprints
share that segment once one bit is left out. Each fingerprint is indexed under its 64 one-wildcard segments.

Null and empty texts have the fingerprint zero and link like others. Rows that repeat a doc_id are one
node each but share the id; a null doc_id never names a component unless all of its rows are null. Very
long texts are hashed whole, an empty table gives no rows, other columns are kept as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm.common import around, pieces, stored, table

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: (lowest bit, width) of the segments.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
PER_BUCKET = 200_000
#: Larger groups are cut once more before all pairs are compared.
LARGE_GROUP = 2048
_BATCH_EDGES = 1 << 20


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    last = max(1, len(words) - size + 1)
    hashes = np.array([digest(joined[s:e - 1], SEED) for s, e in zip(starts[:last], ends[min(size, len(words)) - 1:], strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, last, 1 << 16):
        bits = np.unpackbits(hashes[k:k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns `also`, which are long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = np.array([fingerprint(t, size) for t in piece.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found), *[piece.column(c) for c in also]], ["doc_id", "fp", *also])

    return docs.select("doc_id", "text", *also).mapInArrow(rows, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


def variant(fps: np.ndarray, low: int, width: int, wild: int) -> np.ndarray:
    """The segment without its bit `wild`."""
    segment = (fps >> np.uint64(low)) & np.uint64((1 << width) - 1)
    return (segment & np.uint64((1 << wild) - 1)) | (segment >> np.uint64(wild + 1) << np.uint64(wild))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, by edges a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return label


def _pairs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal keys, lag by lag over the sorted keys."""
    order = np.argsort(keys, kind="stable")
    change = np.nonzero(np.diff(keys[order]))[0] + 1
    ends = np.repeat(np.append(change, len(keys)), np.diff(np.concatenate([[0], change, [len(keys)]])))
    here, lag = np.arange(len(keys)), 1
    while len(here := here[here + lag < ends[here]]):
        yield order[here], order[here + lag]
        lag += 1


def bucket_links(fps: np.ndarray, keys: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints with keys: (member, root) links that join what equal keys and `max_bits`
    join; at most one link a member, however many pairs there are. Pairs of a large group agree in one of
    max_bits + 1 pieces of the fingerprint exactly, so only those are compared."""
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    large = size[group] > LARGE_GROUP
    tries = [(np.nonzero(~large & (size[group] > 1))[0], group)]
    if large.any():
        width = -(-64 // (max_bits + 1))
        for k in range(max_bits + 1):
            piece = (fps >> np.uint64(min(63, k * width))) & np.uint64((1 << width) - 1)
            _, both = np.unique(np.stack([group.astype(np.uint64), piece]), axis=1, return_inverse=True)
            tries.append((np.nonzero(large)[0], both.ravel()))
    a, b, waiting = [], [], 0
    root = np.arange(len(fps))
    for rows, key in tries:
        for x, y in _pairs(key[rows]):
            x, y = rows[x], rows[y]
            close = np.bitwise_count(fps[x] ^ fps[y]) <= max_bits
            a.append(x[close])
            b.append(y[close])
            waiting += len(a[-1])
            if waiting > _BATCH_EDGES:
                root = roots(len(fps), np.concatenate([*a, np.arange(len(fps))]), np.concatenate([*b, root]))
                a, b, waiting = [], [], 0
    root = roots(len(fps), np.concatenate([*a, np.arange(len(fps))]), np.concatenate([*b, root]))
    member = np.nonzero(root != np.arange(len(fps)))[0]
    return fps[member], fps[root[member]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, per_bucket: int = PER_BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that span every group of linked ones."""
    subs = max(1, -(-distinct.count() // per_bucket))
    segments = [(low, width, wild) for low, width in SEGMENTS for wild in range(width)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            ids, blobs = [], []
            for k, (low, width, wild) in enumerate(segments):
                sub = (variant(fps, low, width, wild) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(subs)
                order = np.argsort(sub, kind="stable")
                cuts = np.searchsorted(sub[order], np.arange(subs + 1, dtype=np.uint64))
                for s in range(subs):
                    if cuts[s] < cuts[s + 1]:
                        ids.append(k * subs + s)
                        blobs.append(fps[order[cuts[s]:cuts[s + 1]]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "fps"])

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(np.frombuffer(b"".join(rows["fps"]), np.uint64))
        a, b = bucket_links(fps, variant(fps, *segments[key[0] // subs]), max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    spreaded = distinct.select("fp").mapInArrow(spread, "bucket long, fps binary")
    return spreaded.groupBy("bucket").applyInPandas(join, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest member) of every node that has an edge a-b. Alternates large and small stars;
    every round is written, so a lost executor costs one round at most."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = sign(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(rest.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, sign(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The distinct fingerprints (column fp) with the root of their component."""
    joined = components(links(nodes, max_bits))
    return nodes.join(joined, nodes["fp"] == joined["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def grouped(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id. Equal fingerprints are one node; a hot one is one row from there on."""
    fps = stored(fingerprints(docs, size), "fingerprints")
    named = rooted(stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes"), max_bits)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(stored(named.join(least, "root").select("fp", "component_id"), "named"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: that with the smallest doc_id, rows without an id last; of several such by
    fingerprint and hashes of the text and of the other columns. Rows equal in these are one document.

    The smallest row key of a group is found by map-side aggregates without texts, and joined back."""
    return around(docs, _keep_one)


def _keep_one(docs: DataFrame) -> DataFrame:
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]
    # 120 bits of the text: a key never names a document of another group
    halves = [F.conv(F.substring(F.md5("text"), k, 15), 16, 10).cast("long") for k in (1, 17)]
    marks = {"_llm_text": halves[0], "_llm_text2": halves[1], "_llm_rest": F.xxhash64(*others) if others else F.lit(0).cast("long")}
    marked = docs.withColumns(marks)
    fps = stored(fingerprints(marked, also=tuple(marks)), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", *marks)
    named = rooted(stored(fps.groupBy("fp").agg(F.min(row).alias("first")), "nodes"))
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(
        *[F.col(f"first.{c}").alias(f"_kept_{c}") for c in ("doc_id", *marks)])
    same = F.lit(True)
    for c in ("doc_id", *marks):
        same = same & F.col(c).eqNullSafe(F.col(f"_kept_{c}"))
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", *marks]).select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
