"""Repeated passages, found by blockwise suffix sorting with difference-cover ranks, and removed.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id.
Only text that can repeat is sorted. Each string of `length` bytes has an anchor: its 24-byte gram with the
smallest hash. Neighbouring strings with one anchor form a stretch; equal strings have equal anchors.

1. Documents are dealt to batches and written once, bucketed by batch, so later steps move no text.
2. Batches ask which of their distinct anchors other batches have; a bit for each comes back.
3. Batches send their distinct stretches with such anchors, each with its smallest doc_id, to buckets by
   anchor. A bucket sorts the suffixes of its stretches, one part of its anchors after another: by 16
   bytes, then by ranks of a difference-cover sample made before. Equal strings are then neighbours, are
   compared byte by byte, and give the smallest doc_id of each string.
4. Batches get these back and cut their documents.

Tasks walk a batch by pieces of its bytes, wherever documents end, and a bucket by parts, so that besides a group's own
bytes they hold what one piece or part needs.

The inside of a very common passage is one stretch a batch, however many documents have it. At its edges, and around
any frequent gram, stretches differ by document: an anchor with more than HOT_STRETCHES of them, counted in step 2
over all batches, is cut into its strings. These meet in buckets by a hash of the whole string and need no sorting,
so that no bucket holds a common anchor. Null and empty texts have
no bytes. Rows with a null doc_id are neither cut nor a reason to cut. Rows that repeat a doc_id are one
document: they never cut each other. Texts are searched whole, however long; texts shorter than `length` stay.
An empty table gives no rows. Other columns are not looked at, whatever their names."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm.common import shared_path, table

LENGTH = 50
GRAM = 24
BATCH_BYTES = 16 << 20
#: Bytes of a batch that are hashed at once.
PIECE_BYTES = 256 << 10
#: Bytes of an Arrow batch that a task returns, when a row does not have more.
RETURN_BYTES = 2 << 20
#: Parts of a bucket's anchors that are sorted one after another.
PARTS = 16
#: Suffixes of a part that are sorted at once.
BLOCK_SUFFIXES = 1 << 19
#: Strings of hot anchors that are made or compared at once.
BLOCK_STRINGS = 1 << 18
#: Anchors with more distinct stretches, summed over the batches, are cut into strings; four a batch are always allowed.
HOT_STRETCHES = 1 << 16
PERIOD = 16
#: A difference cover of 16. Every difference modulo 16 is one of two members.
COVER = (0, 1, 2, 5, 8)
_FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _shifts() -> np.ndarray:
    """For two residues the smallest step that takes both into the cover."""
    return np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
                      for b in range(PERIOD)] for a in range(PERIOD)])


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place on, by doubling; `size` is a sum of two powers of two at most."""
    now, width, parts, place = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, [], 0
    bits = [k for k in range(size.bit_length()) if size >> k & 1]
    for k in range(max(bits) + 1):
        if k in bits:
            parts.append((now, 1 << k))
        if k < max(bits):
            now = now[:-width] * np.uint64(pow(_FACTOR, width, 1 << 64)) + now[width:] if len(now) > width else now[:0]
            width *= 2
    out = None
    for part, width in reversed(parts):
        n = max(0, len(data) - size + 1)
        own = part[place:place + n]
        out = own.copy() if out is None else out * np.uint64(pow(_FACTOR, width, 1 << 64)) + own
        place += width
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


@dataclass
class Stretches:
    """Runs of strings with one anchor, over a piece of a batch."""

    first: np.ndarray  # place in the batch's bytes where the first string starts
    count: np.ndarray  # strings, one byte apart
    doc: np.ndarray  # row of the document
    anchor: np.ndarray
    mark: np.ndarray  # hash of all bytes

    @classmethod
    def joined(cls, pieces: Iterator[Stretches], *names: str) -> list[np.ndarray]:
        """These columns of all pieces."""
        none = {"anchor": np.uint64, "mark": np.uint64}
        columns = list(zip(*([getattr(p, name) for name in names] for p in pieces), strict=True)) or [()] * len(names)
        out = []
        for name in names:
            out.append(np.concatenate([np.zeros(0, none.get(name, np.int64)), *columns.pop(0)]))
        return out


def stretches(data: np.ndarray, starts: np.ndarray, usable: np.ndarray, length: int, gram: int = GRAM) -> Iterator[Stretches]:
    """Of all documents data[starts[k]:starts[k + 1]] that are usable, one piece of the data after another. Where a piece
    ends, a stretch ends."""
    window, strings = length - gram + 1, len(data) - length + 1
    for low in range(0, strings, PIECE_BYTES):
        n = min(PIECE_BYTES, strings - low)
        hashes = gram_hashes(data[low:low + n + length - 1], gram)
        least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width < window:  # the leftmost smallest of the next `window` hashes
            step = min(width, window - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
        k, last = (np.searchsorted(starts, [low, low + n - 1], side="right") - 1).tolist()
        sizes = np.diff(np.clip(starts[k:last + 2], low, low + n))
        doc = np.repeat(np.arange(k, last + 1), sizes)
        inside = np.arange(low, low + n) <= np.repeat(np.where(usable[k:last + 1], starts[k + 1:last + 2] - length, -1), sizes)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.nonzero(begins)[0]
        if not len(first):
            continue
        group = np.cumsum(begins)[inside] - 1
        count = np.bincount(group, minlength=len(first))
        end = first + count - 1 + length
        mark = count.astype(np.uint64)
        for place in (first, first + gram, end - 2 * gram, end - gram):
            mark = (mark ^ hashes[place]) * np.uint64(_FACTOR)
            mark ^= mark >> np.uint64(31)
        yield Stretches(first + low, count, doc[first], hashes[at[first]], mark)


@dataclass
class Batch:
    ids: np.ndarray
    null: np.ndarray
    data: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Batch:
        ids = rows.column("doc_id").cast(pa.int64())
        texts = pc.fill_null(rows.column("text").cast(pa.large_binary()), pa.scalar(b"", pa.large_binary())).combine_chunks()
        starts, data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        if len(texts):
            starts = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        if starts[-1] > starts[0]:
            data = np.frombuffer(texts.buffers()[2], np.uint8, int(starts[-1] - starts[0]), int(starts[0]))
        return cls(pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(), data, starts - starts[0])

    def stretches(self, length: int) -> Iterator[Stretches]:
        return stretches(self.data, self.starts, ~self.null, length)


def distinct_anchors(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, 32-bit print) of the anchors, in order, and the place of each anchor among them."""
    both = (anchor % np.uint64(buckets)) << np.uint64(32) | anchor >> np.uint64(32)
    pairs, place = np.unique(both, return_inverse=True)
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), place


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    found, first = np.unique(bucket, return_index=True)
    if not len(bucket):
        return
    yield from zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True)


class CoverRanks:
    """Order of a text's suffixes by at least `depth` bytes, for places in the difference cover."""

    def __init__(self, data: np.ndarray, depth: int):
        n = len(data)
        padded = np.concatenate([data, np.zeros(depth + 4 * PERIOD + 8, np.uint8)])
        self.eight = np.zeros(len(padded) - 7, np.uint64)  # eight bytes from each place on, as a number
        for k in range(8):
            self.eight |= padded[k:len(padded) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
        places = np.arange(n)
        places = places[np.isin(places % PERIOD, COVER)]
        order = np.lexsort((self.eight[places + 8], self.eight[places]))
        self.rank = np.full(n + depth + 4 * PERIOD, -1, np.int64)  # behind the end: before all others
        self._name(places[order], self.eight[places[order]], self.eight[places[order] + 8])
        reach = 16
        while reach < depth:
            ahead = np.minimum(places + reach, len(self.rank) - 1)
            order = np.lexsort((self.rank[ahead], self.rank[places]))
            self._name(places[order], self.rank[places[order]], self.rank[ahead[order]])
            reach *= 2

    def _name(self, places: np.ndarray, *keys: np.ndarray) -> None:
        new = np.zeros(len(places), bool)
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        self.rank[places] = np.cumsum(new)


def sort_suffixes(places: np.ndarray, ranks: CoverRanks) -> np.ndarray:
    """The places in the order of their suffixes: by 16 bytes, then ties by cover ranks. Ties are split in
    three around a pivot, all groups of ties in step; two places need one look-up, at the step that takes
    both into the cover."""
    shifts = _shifts()
    order = places[np.lexsort((ranks.eight[places + 8], ranks.eight[places]))]
    new = np.ones(len(order), bool)
    new[1:] = (ranks.eight[order[1:]] != ranks.eight[order[:-1]]) | (ranks.eight[order[1:] + 8] != ranks.eight[order[:-1] + 8])
    group = np.cumsum(new) - 1
    rows = np.arange(len(order))
    while True:
        size = np.bincount(group)
        open_ = size[group] > 1
        rows, group = rows[open_], group[open_]
        if not len(rows):
            return order
        first = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
        number = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
        size = np.diff(np.append(first, len(rows)))
        here = order[rows]
        pivot = here[first + size // 2][number]
        step = shifts[here % PERIOD, pivot % PERIOD]
        side = np.sign(ranks.rank[here + step] - ranks.rank[pivot + step]) + 1
        key = number * 3 + side
        moved = np.argsort(key, kind="stable")
        order[rows] = here[moved]
        key = key[moved]
        left = key % 3 != 1
        rows = rows[left]
        group = np.unique(key[left], return_inverse=True)[1] if left.any() else key[:0]


def smallest_ids(data: np.ndarray, places: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each place the smallest id among the places with the same `length` bytes."""
    out = ids.copy()
    ranks = CoverRanks(data, length)
    lead = ranks.eight[places]
    cuts = np.unique(np.quantile(lead, np.linspace(0, 1, len(places) // BLOCK_SUFFIXES + 2)[1:-1], method="nearest")) if len(places) > BLOCK_SUFFIXES else []
    part = np.searchsorted(cuts, lead, side="left")
    by_place = np.full(len(data) + 1, -1, np.int64)
    by_place[places] = np.arange(len(places))
    for k in range(len(cuts) + 1):
        own = places[part == k]
        if not len(own):
            continue
        order = sort_suffixes(own, ranks)
        same = np.ones(len(order), bool)
        same[0] = False
        for offset in [*range(0, length - 7, 8), length - 8]:
            same[1:] &= ranks.eight[order[1:] + offset] == ranks.eight[order[:-1] + offset]
        first = np.nonzero(~same)[0]
        rows = by_place[order]
        least = np.minimum.reduceat(ids[rows], first)
        out[rows] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


@dataclass
class Request:
    """Stretches of one batch for one bucket: mark, strings, smallest and largest id, bytes; one part of the bucket after
    another, each with that many stretches."""

    mark: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    data: np.ndarray
    sizes: np.ndarray

    def pack(self) -> bytes:
        return b"".join([len(self.mark).to_bytes(8, "little"), self.mark.tobytes(), self.low.tobytes(), self.high.tobytes(),
                         self.count.astype(np.uint32).tobytes(), self.sizes.astype(np.uint32).tobytes(), self.data.tobytes()])

    @classmethod
    def unpack(cls, blob: pa.Buffer) -> Request:
        n = int.from_bytes(blob[:8], "little")
        return cls(np.frombuffer(blob, np.uint64, n, 8), np.frombuffer(blob, np.uint32, n, 8 + 24 * n),
                   np.frombuffer(blob, np.int64, n, 8 + 8 * n), np.frombuffer(blob, np.int64, n, 8 + 16 * n),
                   np.frombuffer(blob, np.uint8, -1, 8 + 28 * n + 4 * PARTS), np.frombuffer(blob, np.uint32, PARTS, 8 + 28 * n))

    def parts(self, length: int) -> Iterator[Request]:
        i = at = 0
        for k, size in enumerate(self.sizes.tolist()):
            count = self.count[i:i + size].astype(np.int64)
            end = at + int(count.sum()) + size * (length - 1)
            yield Request(self.mark[i:i + size], count, self.low[i:i + size], self.high[i:i + size], self.data[at:end],
                          self.sizes[k:k + 1])
            i, at = i + size, end


def string_marks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Two 64-bit hashes of the `length` bytes from each start, as two rows."""
    out = np.zeros((2, len(starts)), np.uint64)
    for k in range(0, len(starts), 1 << 16):
        own = starts[k:k + (1 << 16)]
        wide = np.zeros((len(own), -(-length // 8) * 8), np.uint8)
        wide[:, :length] = data[own[:, None] + np.arange(length)]
        for word in wide.view("<u8").T:
            for row, factor, shift in ((0, _FACTOR, 32), (1, 0xD6E8FEB86659FD93, 29)):
                now = (out[row, k:k + len(own)] ^ word) * np.uint64(factor)
                out[row, k:k + len(own)] = now ^ now >> np.uint64(shift)
    return out


@dataclass
class Strings:
    """Distinct strings of one batch for one bucket: two marks, anchor, smallest and largest id. In answers
    `low` is the smallest id of all batches."""

    marks: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def pack(self) -> bytes:
        return b"".join([self.marks.tobytes(), self.anchor.tobytes(), self.low.tobytes(), self.high.tobytes()])

    @classmethod
    def unpack(cls, blob: pa.Buffer) -> Strings:
        n = len(blob) // 40
        return cls(np.frombuffer(blob, np.uint64, 2 * n).reshape(2, n), np.frombuffer(blob, np.uint64, n, 16 * n),
                   np.frombuffer(blob, np.int64, n, 24 * n), np.frombuffer(blob, np.int64, n, 32 * n))

    def part(self, rows: np.ndarray) -> Strings:
        return Strings(self.marks[:, rows], self.anchor[rows], self.low[rows], self.high[rows])

    @classmethod
    def joined(cls, parts: list[Strings]) -> Strings:
        return cls(np.concatenate([p.marks for p in parts], axis=1), *(
            np.concatenate([getattr(p, name) for p in parts]) for name in ("anchor", "low", "high")))

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of the strings by marks, and where in it each distinct string begins."""
        order = np.lexsort(self.marks)
        new = np.ones(len(order), bool)
        new[1:] = (self.marks[:, order[1:]] != self.marks[:, order[:-1]]).any(axis=0)
        return order, np.nonzero(new)[0]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after another."""
    before = np.cumsum(sizes) - sizes
    out = np.repeat(starts - before, sizes)
    out += np.arange(len(out))
    return out


def _bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one span after another."""
    cuts = np.nonzero(np.diff(np.cumsum(sizes) // PIECE_BYTES))[0] + 1
    return np.concatenate([data[_spans(*own)] for own in zip(np.split(starts, cuts), np.split(sizes, cuts), strict=True)])


def _rows(schema: list[tuple[str, pa.DataType]], rows: Iterable[tuple]) -> pa.Table:
    """The last column has the bytes."""
    batches, part, size = [], [], 0

    def close() -> None:
        batches.append(pa.record_batch([pa.array([r[k] for r in part], t) for k, (_, t) in enumerate(schema)], names=[n for n, _ in schema]))

    for row in rows:
        part.append(row)
        size += len(row[-1])
        if size >= RETURN_BYTES:
            close()
            part, size = [], 0
    close()
    return pa.Table.from_batches(batches)


def _blobs(rows: pa.Table) -> list[pa.Buffer]:
    return [b.as_buffer() for b in rows.column("blob")]


_BLOB = [("bucket", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())]
_BLOB_TYPE = "bucket long, batch long, blob binary"


def bucketed(docs: DataFrame, batches: int) -> DataFrame:
    """doc_id, text (bytes), batch; written in the shared folder so that grouping by batch shuffles nothing."""
    spark = docs.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    unnamed = F.when(F.col("doc_id").isNull(), F.col("text"))  # rows without an id are spread by their texts
    dealt = docs.select("doc_id", F.col("text").cast("binary").alias("text"),
                        F.pmod(F.xxhash64("doc_id", unnamed), F.lit(batches)).alias("batch"))
    dealt.repartition(batches, "batch").write.bucketBy(batches, "batch").option("compression", "zstd").option(
        "path", shared_path(spark, "batches")).saveAsTable(name)
    return spark.table(name)


def requests(texts: DataFrame, buckets: int, length: int, hot_stretches: int) -> DataFrame:
    """What the batches send to the buckets that compare: stretches, and in buckets from `buckets` on the strings of
    hot anchors."""

    def ask(rows: pa.Table) -> pa.Table:
        anchor, mark = Stretches.joined(Batch.of(rows).stretches(length), "anchor", "mark")
        bucket, prints, place = distinct_anchors(anchor, buckets)
        batch = rows.column("batch")[0].as_py()
        several = np.nonzero((np.bincount(place, minlength=len(prints)) > 1)[place])[0]
        order = several[np.lexsort((mark[several], place[several]))]
        new = np.ones(len(order), bool)
        new[1:] = (place[order[1:]] != place[order[:-1]]) | (mark[order[1:]] != mark[order[:-1]])
        more = np.maximum(np.bincount(place[order[new]], minlength=len(prints)) - 1, 0)  # distinct stretches but one
        out = []
        for b, i, j in _cuts(bucket):
            at = np.nonzero(more[i:j])[0]
            out.append((b, batch, b"".join([(j - i).to_bytes(8, "little"), prints[i:j].tobytes(), at.astype(np.uint32).tobytes(),
                                            more[i:j][at].astype(np.uint32).tobytes()])))
        return _rows(_BLOB, out)

    def answer(rows: pa.Table) -> pa.Table:
        asked, many = [], []
        for blob in _blobs(rows):
            n = int.from_bytes(blob[:8], "little")
            at, more = np.frombuffer(blob, np.uint32, -1, 8 + 4 * n).reshape(2, -1)
            asked.append(np.frombuffer(blob, np.uint32, n, 8))
            many.append(np.ones(n, np.int64))
            many[-1][at] += more
        prints, place, times = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        total = np.zeros(len(prints), np.int64)
        np.add.at(total, place, np.concatenate(many))
        ends = np.cumsum([len(a) for a in asked])[:-1]
        shared, hot = np.split(times[place] > 1, ends), np.split(total[place] > max(hot_stretches, 4 * buckets), ends)
        return _rows(_BLOB, [(b, k, np.packbits(s).tobytes() + (np.packbits(h).tobytes() if h.any() else b"")) for b, k, s, h in zip(
            rows.column("bucket").to_pylist(), rows.column("batch").to_pylist(), shared, hot, strict=True)])

    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows(_BLOB, [])
        batch, number = Batch.of(rows), rows.column("batch")[0].as_py()
        names = ("first", "count", "doc", "anchor", "mark")
        found = Stretches(*Stretches.joined(batch.stretches(length), *names))
        if not len(found.first):
            return _rows(_BLOB, [])
        bucket, prints, place = distinct_anchors(found.anchor, buckets)
        bits = dict(zip(answers.column("bucket").to_pylist(), _blobs(answers), strict=True))
        shared, hot = np.zeros(len(prints), bool), np.zeros(len(prints), bool)
        for b, i, j in _cuts(bucket):
            own, size = np.frombuffer(bits[b], np.uint8), -(-(j - i) // 8)
            shared[i:j] = np.unpackbits(own[:size], count=j - i)
            if len(own) > size:
                hot[i:j] = np.unpackbits(own[size:], count=j - i)
        ids = batch.ids[found.doc]
        low, high = np.full(len(prints), np.iinfo(np.int64).max), np.full(len(prints), np.iinfo(np.int64).min)
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        wanted = (shared | (low < high))[place]
        cut_up, rows_ = np.nonzero(wanted & hot[place])[0], np.nonzero(wanted & ~hot[place])[0]
        marks, first, own = np.unique(found.mark[rows_], return_index=True, return_inverse=True)
        low, high = np.full(len(marks), np.iinfo(np.int64).max), np.full(len(marks), np.iinfo(np.int64).min)
        np.minimum.at(low, own, ids[rows_])
        np.maximum.at(high, own, ids[rows_])
        one = rows_[first]
        to = (found.anchor[one] % np.uint64(buckets)).astype(np.int64)
        part = (found.anchor[one] // np.uint64(buckets) % np.uint64(PARTS)).astype(np.int64)
        order = np.lexsort((found.anchor[one], part, to))

        def whole() -> Iterator[tuple]:
            for b, i, j in _cuts(to[order]):
                k = order[i:j]
                start, count = found.first[one[k]], found.count[one[k]]
                yield b, number, Request(marks[k], count, low[k], high[k], _bytes(batch.data, start, count + length - 1),
                                         np.bincount(part[k], minlength=PARTS)).pack()

        def strings() -> Iterator[tuple]:
            by_anchor = cut_up[np.argsort(found.anchor[cut_up], kind="stable")]  # equal strings close together
            block = np.cumsum(found.count[by_anchor]) // BLOCK_STRINGS
            for own in np.split(by_anchor, np.nonzero(np.diff(block))[0] + 1) if len(by_anchor) else ():
                of = np.repeat(own, found.count[own])
                every = Strings(string_marks(batch.data, _spans(found.first[own], found.count[own]), length), found.anchor[of],
                                ids[of], ids[of])
                order, first = every.groups()
                one = every.part(order[first])
                one.low, one.high = np.minimum.reduceat(every.low[order], first), np.maximum.reduceat(every.high[order], first)
                to = (one.marks[0] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                for b, i, j in _cuts(to[order]):
                    yield buckets + b, number, one.part(order[i:j]).pack()

        return _rows(_BLOB, itertools.chain(whole(), strings()))

    answers = texts.groupBy("batch").applyInArrow(ask, _BLOB_TYPE).groupBy("bucket").applyInArrow(answer, _BLOB_TYPE)
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(send, _BLOB_TYPE)


def remove_repeats(docs: DataFrame, length: int = LENGTH, batch_bytes: int = BATCH_BYTES,
                   hot_stretches: int = HOT_STRETCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-size // batch_bytes))
    texts = bucketed(docs, buckets)

    def meet(rows: pa.Table) -> Iterator[tuple]:
        """The strings of hot anchors: for each batch those that start in a document with a smaller id."""
        asked = [Strings.unpack(b) for b in _blobs(rows)]
        batches = rows.column("batch").to_pylist()
        blocks = np.uint64(1 + sum(len(a.low) for a in asked) // BLOCK_STRINGS)
        for k in range(int(blocks)):
            parts = [a.part(np.nonzero((a.marks[0] >> np.uint64(32)) % blocks == k)[0]) for a in asked]
            every = Strings.joined(parts)
            order, first = every.groups()
            if not len(order):
                continue
            least = np.empty(len(order), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(every.low[order], first), np.diff(np.append(first, len(order))))
            for a, own, batch in zip(parts, np.split(least, np.cumsum([len(a.low) for a in parts])[:-1]), batches, strict=True):
                cuts = np.nonzero(own < a.high)[0]  # else no document of the batch loses anything
                if len(cuts):
                    yield rows.column("bucket")[0].as_py(), batch, Strings(a.marks, a.anchor, own, a.high).part(cuts).pack()

    def sort_part(asked: tuple[Request, ...], found: list[list[tuple[np.ndarray, ...]]]) -> None:
        """For each batch the runs of strings that start in a document with a smaller id: mark, id, first string, strings."""
        mark = np.concatenate([a.mark for a in asked])
        if not len(mark):
            return
        count = np.concatenate([a.count for a in asked])
        low = np.concatenate([a.low for a in asked])
        marks, first, own = np.unique(mark, return_index=True, return_inverse=True)
        least = np.full(len(marks), np.iinfo(np.int64).max)
        np.minimum.at(least, own, low)
        begin = np.cumsum(count + length - 1) - (count + length - 1)
        sizes = count[first]
        data = _bytes(np.concatenate([a.data for a in asked]), begin[first], sizes + length - 1)
        begin = np.cumsum(sizes + length - 1) - (sizes + length - 1)
        ids = smallest_ids(data, _spans(begin, sizes), np.repeat(least, sizes), length)
        # runs of strings of a stretch with the same smallest id
        offset = _spans(np.zeros(len(sizes), np.int64), sizes)
        starts = np.nonzero((offset == 0) | np.concatenate([[True], ids[1:] != ids[:-1]]))[0]
        run_from, run_id = offset[starts], ids[starts]
        run_size = np.diff(np.append(starts, len(ids)))
        run_of = np.searchsorted(np.cumsum(sizes), starts, side="right")
        firsts = np.searchsorted(run_of, np.arange(len(marks)))
        many = np.diff(np.append(firsts, len(run_of)))
        done = 0
        for a, cuts in zip(asked, found, strict=True):
            k = own[done:done + len(a.mark)]
            done += len(a.mark)
            runs = _spans(firsts[k], many[k])
            of = np.repeat(np.arange(len(k)), many[k])
            goes = run_id[runs] < a.high[of]  # else no document of the batch loses anything
            runs, of = runs[goes], of[goes]
            if len(runs):
                cuts.append((a.mark[of], run_id[runs], run_from[runs].astype(np.uint32), run_size[runs].astype(np.uint32)))

    def sort_bucket(rows: pa.Table) -> pa.Table:
        bucket, batches = rows.column("bucket")[0].as_py(), rows.column("batch").to_pylist()
        if bucket >= buckets:
            return _rows(_BLOB, meet(rows))
        found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in batches]
        for asked in zip(*(Request.unpack(b).parts(length) for b in _blobs(rows)), strict=True):
            sort_part(asked, found)
        return _rows(_BLOB, ((bucket, batch, b"".join([sum(len(c[0]) for c in cuts).to_bytes(8, "little"),
                                                       *(x.tobytes() for column in zip(*cuts, strict=True) for x in column)]))
                             for batch, cuts in zip(batches, found, strict=True) if cuts))

    result = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows(result, [])
        batch = Batch.of(rows)
        gone = np.zeros(len(batch.data), bool)
        blobs = list(zip(answers.column("bucket").to_pylist(), _blobs(answers), strict=True))
        parts: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in (np.uint64, np.int64, np.uint32, np.uint32)]
        for blob in (blob for b, blob in blobs if b < buckets):
            n = int.from_bytes(blob[:8], "little")
            for part, (kind, at) in zip(parts, ((np.uint64, 0), (np.int64, 8), (np.uint32, 16), (np.uint32, 20)), strict=True):
                part.append(np.frombuffer(blob, kind, n, 8 + at * n))
        mark, low, begin, many = (np.concatenate(p) for p in parts)
        order = np.argsort(mark, kind="stable")
        mark, low, begin, many = mark[order], low[order], begin[order].astype(np.int64), many[order].astype(np.int64)
        strings = [Strings.unpack(blob) for b, blob in blobs if b >= buckets]
        if strings:
            known = Strings.joined(strings)
            known = known.part(np.argsort(known.marks[0], kind="stable"))
            hot = np.unique(known.anchor)
        for found in batch.stretches(length) if blobs else ():
            base = int(found.first[0])
            steps = np.zeros(int(found.first[-1] + found.count[-1]) - 1 + length - base + 1, np.int32)
            first, last = np.searchsorted(mark, found.mark, side="left"), np.searchsorted(mark, found.mark, side="right")
            runs, of = _spans(first, last - first), np.repeat(np.arange(len(first)), last - first)
            goes = low[runs] < batch.ids[found.doc[of]]
            runs, start = runs[goes], found.first[of[goes]] - base
            np.add.at(steps, start + begin[runs], 1)
            np.add.at(steps, start + begin[runs] + many[runs] - 1 + length, -1)
            rows_ = np.nonzero(np.isin(found.anchor, hot))[0] if strings else ()
            if len(rows_):
                start, doc = _spans(found.first[rows_], found.count[rows_]), np.repeat(found.doc[rows_], found.count[rows_])
                marks = string_marks(batch.data, start, length)
                first, last = np.searchsorted(known.marks[0], marks[0], side="left"), np.searchsorted(known.marks[0], marks[0], side="right")
                runs, of = _spans(first, last - first), np.repeat(np.arange(len(first)), last - first)
                start = start[of[(known.marks[1][runs] == marks[1][of]) & (known.low[runs] < batch.ids[doc[of]])]] - base
                np.add.at(steps, start, 1)
                np.add.at(steps, start + length, -1)
            gone[base:base + len(steps) - 1] |= np.cumsum(steps)[:-1] > 0

        def kept() -> Iterator[tuple]:
            for doc_id, i, j in zip(rows.column("doc_id").to_pylist(), batch.starts[:-1].tolist(), batch.starts[1:].tolist(), strict=True):
                own = gone[i:j]
                removed = int(own.sum())
                spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if removed else 0
                left = batch.data[i:j][~own] if removed else batch.data[i:j]
                yield doc_id, j - i, removed, spans, left.tobytes()

        return _rows(result, kept())

    sent = requests(texts, buckets, length, hot_stretches)
    cuts = sent.groupBy("bucket").applyInArrow(sort_bucket, _BLOB_TYPE)
    return texts.groupBy("batch").cogroup(cuts.groupBy("batch")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
