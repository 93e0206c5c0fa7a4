"""Documents whose sets of word n-grams overlap by a Jaccard similarity of 0.85 or more, by prefix trees.

1. A pass over the texts writes each document's set as a size and 128 bits of hash, and counts n-grams in a
   sketch of fixed size. Equal sets are one node from then on. The sketch gives all n-grams one order: those
   of low counts first, ties by hash. Two linked sets share n-grams among the first n - ceil(0.85 n) + depth:
   one at least, and a twentieth of their length; a node that shares fewer is left out.
2. Chunks of nodes send these n-grams, each once with its first node, to partitions by n-gram. What comes back
   for an n-gram that another node has is the smallest node that has it: the centre of a star. Linked nodes
   share an n-gram, so they meet in the star of its centre. Copies with one core mostly have one centre, so a
   node is in few stars, and a very common n-gram is one record a chunk.
3. A star's sets are stored in a trie, common n-grams first, and each set goes down the trie with the overlap
   it has so far; a subtree goes if its sets' lengths, or what is left of them, can't reach the overlap, or if
   all of it is linked with the set already. What is left at a leaf is a link, by exact overlap.
4. Stars of more than BLOCK n-grams are cut into blocks. Each block is joined, one set of each group found is
   joined with those of the other blocks, and every set outside the star's largest group is then looked up in
   all blocks. So near copies are not compared with all of their kind, and no link is lost.

n-grams are 64 bits of hash of their words. Null texts and texts without words have the empty set, are linked
with nothing and are components of their own. Rows that repeat a doc_id share the id; a null doc_id
never names a component unless all its rows are null. Very long texts are taken whole, an empty table gives no
rows, other columns are not looked at, whatever their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm.common import SPACE, pieces, stored, table
from footfall.llm.simhash import components

SIZE = 4
#: Least similarity, in per cent.
LEAST = 85
#: Counters of the sketch, as a power of two, and the rows that one partial sum of it is cut into.
SKETCH_BITS, SLOTS = 21, 16
#: Bits of the filter of sets that are in a star, as a power of two.
FILTER_BITS = 25
#: n-grams in a block of a star.
BLOCK = 2_000_000
#: n-grams of nodes in a chunk, and nodes for each partition of their n-grams.
CHUNK, NODES_PER_PART = 1_000_000, 20_000
#: n-grams of stars that one task joins, if no star alone has more.
PER_TASK = 4_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


#: A number for each byte at each place of a word, and the bytes of words with A to Z lower-cased.
PLACES = 64
_TABLE = _mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SPACE = np.isin(np.arange(256), list(SPACE.encode()))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in texts that stand one after another, and where each text's words begin."""
    import xxhash

    inside = np.nonzero(~_SPACE[data])[0]
    begins = np.concatenate([[True], np.diff(inside) > 1]) if len(inside) else np.zeros(0, bool)
    begins[np.searchsorted(inside, bounds[:-1][bounds[:-1] < (inside[-1] + 1 if len(inside) else 0)])] = True
    first = np.nonzero(begins)[0]
    lengths = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    low = _LOWER[data[inside]]
    each = _TABLE[(place % PLACES) * 256 + low]
    words = _mix(np.add.reduceat(each, first) + lengths.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
    for k in np.nonzero(lengths > PLACES)[0].tolist():
        words[k] = xxhash.xxh3_64_intdigest(low[first[k]:first[k] + lengths[k]].tobytes())
    return words, np.searchsorted(inside[first], bounds) if len(first) else np.zeros(len(bounds), np.int64)


def ngram_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-grams; a text of fewer words has its whole sequence as one."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    words, bounds = word_hashes(data, ends - ends[0])
    h = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for k in range(size):
        h = _mix(h) + words[k:k + len(h)]
    h, out = _mix(h), []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if j - i >= size:
            mine = np.sort(h[i:j - size + 1])
            out.append(mine[np.concatenate([[True], mine[1:] != mine[:-1]])])
        elif i == j:
            out.append(np.zeros(0, np.uint64))
        else:
            one = np.full(1, j - i, np.uint64)
            for w in words[i:j]:
                one = _mix(one) + w
            out.append(_mix(one))
    return out


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8").tolist())


def counted(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return sketch[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def least_overlap(n: int | np.ndarray, least: int = LEAST):
    """Of a set of n and any other with which it is linked."""
    return -(-least * n // 100)


def depth(n: int | np.ndarray):
    """Linked sets share so many of their first n - least_overlap(n) + depth(n) n-grams (the smaller one's depth)."""
    return 1 + n // 20


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """kind doc: doc_id, n, hi, lo of every row; kind sketch: the counts of a task, in slots."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids = np.zeros(1 << SKETCH_BITS, np.int64), None
        for piece in pieces(batches):
            found = ngram_sets(piece.column("text"), size)
            ids = piece.column("doc_id")
            if len(every := np.concatenate(found)):
                counts += np.bincount((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            marks = [_signature(t) for t in found]
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * n), ids, pa.array(list(map(len, found)), pa.int64()), pa.array([m[0] for m in marks], pa.int64()),
                 pa.array([m[1] for m in marks], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], _SIGNED)
        if ids is not None:
            slots = [zstandard.compress(part.astype("<u4").tobytes(), 3) for part in np.split(counts, SLOTS)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(["sketch"] * SLOTS), pa.nulls(SLOTS, ids.type), pa.array([task] * SLOTS, pa.int64()), pa.nulls(SLOTS, pa.int64()),
                 pa.nulls(SLOTS, pa.int64()), pa.array(range(SLOTS), pa.int32()), pa.array(slots, pa.binary())], _SIGNED)

    return stored(docs.select("doc_id", "text").mapInArrow(
        rows, f"kind string, doc_id {kind}, n long, hi long, lo long, slot int, counts binary"), "signatures", partition_by="kind")


_SIGNED = ["kind", "doc_id", "n", "hi", "lo", "slot", "counts"]


def sketch_of(signed: DataFrame) -> np.ndarray:
    """All tasks' counts, summed by groups of tasks, then by slot. Its size is fixed, whatever the input's."""

    def total(blobs: pa.Table) -> pa.Table:
        both = sum(np.frombuffer(zstandard.decompress(b), "<u4").astype(np.int64) for b in blobs.column("counts").to_pylist())
        blob = zstandard.compress(np.minimum(both, 0xFFFFFFFF).astype("<u4").tobytes(), 3)
        return pa.table({"slot": blobs.column("slot")[:1], "counts": pa.array([blob], pa.binary())})

    blobs = signed.where("kind = 'sketch'").withColumn("some", F.expr("n div 256"))
    some = blobs.groupBy("slot", "some").applyInArrow(total, "slot int, counts binary")
    slots = {r["slot"]: r["counts"] for r in some.groupBy("slot").applyInArrow(total, "slot int, counts binary").collect()}
    if not slots:
        return np.zeros(1 << SKETCH_BITS, np.uint32)
    return np.concatenate([np.frombuffer(zstandard.decompress(slots[k]), "<u4") for k in range(SLOTS)])


def prefixes(docs: DataFrame, sketch, size: int, least: int) -> DataFrame:
    """hi, lo, n and the first n-grams, in the order of the sketch, of each distinct set that isn't empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for piece in pieces(batches):
            his, los, ns, firsts = [], [], [], []
            for tokens in ngram_sets(piece.column("text"), size):
                mark = _signature(tokens)
                n = len(tokens)
                if not n or mark in seen:
                    continue
                seen.add(mark)
                order = np.argsort(counted(tokens, sketch.value), kind="stable")[:n - least_overlap(n, least) + depth(n)]
                his.append(mark[0])
                los.append(mark[1])
                ns.append(n)
                firsts.append(tokens[order].tobytes())
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(ns, pa.int64()),
                                              pa.array(firsts, pa.binary())], ["hi", "lo", "n", "first"])

    found = docs.select("text").mapInArrow(rows, "hi long, lo long, n long, first binary")
    return found.groupBy("hi", "lo").agg(F.first("n").alias("n"), F.first("first").alias("first"))


def stars(sets: DataFrame, least: int = LEAST) -> DataFrame:
    """centre, node, hi, lo, n: the stars that each node is in. Nodes are numbered by chunk."""
    parts = max(16, -(-sets.count() // NODES_PER_PART))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 40, 0
        for piece in pieces(batches, "first", 8 * CHUNK):
            number += 1
            base = first + (number << 20)
            sizes = np.array([len(f) // 8 for f in piece.column("first").to_pylist()], np.int64)
            tokens = np.frombuffer(b"".join(piece.column("first").to_pylist()), np.uint64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            part = ((tokens * _M2 >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((of, tokens, part))
            tokens, of, part = tokens[order], of[order], part[order]
            new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
            cuts = np.searchsorted(part[new], np.arange(parts + 1))
            distinct, nodes = tokens[new], of[new]
            bodies = [(p, distinct[i:j].tobytes() + nodes[i:j].astype("<u4").tobytes()) for p, (i, j) in
                      enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]
            held = pa.table({c: piece.column(c) for c in ("hi", "lo", "n")})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema) as out:
                out.write_table(held)
            mine = zstandard.compress(np.stack([of, np.cumsum(new) - 1]).astype("<u4").tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["node", "node", *["run"] * len(bodies)]), pa.array([base] * (2 + len(bodies)), pa.int64()),
                 pa.array([0, 1, *[p for p, _ in bodies]], pa.int32()),
                 pa.array([sink.getvalue().to_pybytes(), mine, *[b for _, b in bodies]], pa.binary())], ["kind", "chunk", "part", "body"])

    def meet(runs: pa.Table) -> pa.Table:
        bodies, chunks = runs.column("body").to_pylist(), runs.column("chunk").to_pylist()
        tokens = [np.frombuffer(b, "<u8", len(b) // 12) for b in bodies]
        nodes = [np.frombuffer(b, "<u4", len(b) // 12, 8 * (len(b) // 12)).astype(np.int64) + c for b, c in zip(bodies, chunks, strict=True)]
        # a run has an n-gram once, though several of its nodes may have it: those are told by the chunk
        keys, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        low = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(low, inverse, np.concatenate(nodes))
        answer = np.where(counts > 1, low, -1)[inverse]
        cuts = np.cumsum([0, *map(len, tokens)]).tolist()
        out = [zstandard.compress(answer[i:j].tobytes(), 1) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"chunk": runs.column("chunk"), "part": runs.column("part"), "body": pa.array(out, pa.binary())})

    def close(held: pa.Table, answers: pa.Table) -> pa.Table:
        told = dict(zip(held.column("part").to_pylist(), held.column("body").to_pylist(), strict=True))
        base = held.column("chunk")[0].as_py()
        nodes = pa.ipc.open_stream(told[0]).read_all()
        of, place = np.frombuffer(zstandard.decompress(told[1]), "<u4").reshape(2, -1).astype(np.int64)
        order = np.argsort(answers.column("part").to_numpy(), kind="stable").tolist()
        bodies = answers.column("body").to_pylist()
        centre = np.concatenate([np.frombuffer(zstandard.decompress(bodies[k]), np.int64) for k in order])
        # an n-gram that only this chunk has, but several of its nodes: its first node is the centre
        own = np.bincount(place, minlength=len(centre)) > 1
        first = of[np.searchsorted(place, np.arange(len(centre)))] + base
        centre = np.where((centre < 0) & own, first, centre)[place]
        # a node must share as many n-grams as the smallest set that it may be linked with does
        shared = np.bincount(of, weights=centre >= 0, minlength=nodes.num_rows)
        enough = shared >= depth(least_overlap(nodes.column("n").to_numpy(), least))
        both = np.unique(np.stack([of, centre])[:, (centre >= 0) & enough[of]], axis=1)
        row = pa.array(both[0])
        return pa.table({"centre": both[1], "node": both[0] + base, **{c: nodes.column(c).take(row) for c in ("hi", "lo", "n")}})

    written = stored(sets.mapInArrow(chunk, "kind string, chunk long, part int, body binary"), "chunks", partition_by="kind")
    answers = written.where("kind = 'run'").select("chunk", "part", "body").groupBy("part").applyInArrow(meet, "chunk long, part int, body binary")
    held = written.where("kind = 'node'").select("chunk", "part", "body")
    return held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(close, "centre long, node long, hi long, lo long, n long")


class Trie:
    """Sets of ranks, in ascending order, as a tree of shared beginnings. Each branch knows the sizes and the
    lengths of the sets below it."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], ranks: int):
        self.sets, self.sizes = sets, sizes
        order = sorted((s.astype(">u4").tobytes(), k) for k, s in enumerate(sets))
        self.deep, self.of, self.kids, self.ends = [0], [-1], [[]], [[]]
        self.least, self.most, self.longest = [1 << 62], [0], [0]
        self.marked = np.zeros(ranks, bool)
        path, before = [0], None
        for key, k in order:
            mine = self.sets[k]
            common = 0
            if before is not None:
                m = min(len(before), len(mine))
                other = np.nonzero(before[:m] != mine[:m])[0]
                common = int(other[0]) if len(other) else m
            low = None
            while self.deep[path[-1]] > common:
                low = path.pop()
            if self.deep[path[-1]] < common:  # the branch that was left last divides here
                new = self._branch(common, k)
                self.kids[path[-1]][-1] = new
                self.kids[new].append(low)
                self._sees(new, self.least[low], self.longest[low])
                self._sees(new, self.most[low], self.longest[low])
                path.append(new)
            if self.deep[path[-1]] < len(mine):
                new = self._branch(len(mine), k)
                self.kids[path[-1]].append(new)
                path.append(new)
            self.ends[path[-1]].append(k)
            for node in path:
                self._sees(node, sizes[k], len(mine))
            before = mine

    def _branch(self, deep: int, of: int) -> int:
        self.deep.append(deep)
        self.of.append(of)
        self.kids.append([])
        self.ends.append([])
        self.least.append(1 << 62)
        self.most.append(0)
        self.longest.append(0)
        return len(self.deep) - 1

    def _sees(self, node: int, size: int, length: int) -> None:
        self.least[node] = min(self.least[node], size)
        self.most[node] = max(self.most[node], size)
        self.longest[node] = max(self.longest[node], length)

    def linked(self, mine: np.ndarray, size: int, least: int) -> list[int]:
        """The sets that overlap enough with one of `size` n-grams, of which `mine` are the ranks."""
        low, high = least_overlap(size, least), 100 * size // least
        found, whole, left_of = [], 100 + least, len(mine)
        self.marked[mine] = True
        if low <= 0 or not left_of:
            return found
        open_, deep, kids, marked = [(0, 0)], self.deep, self.kids, self.marked
        while open_:
            node, have = open_.pop()
            at = deep[node]
            for kid in kids[node]:
                if self.most[kid] < low or self.least[kid] > high:
                    continue
                down = deep[kid]
                edge = self.sets[self.of[kid]][at:down]
                got = have + int(np.count_nonzero(marked[edge]))
                rest = min(left_of - int(mine.searchsorted(edge[-1], "right")), self.longest[kid] - down)
                if whole * (got + rest) < least * (size + max(low, self.least[kid])):
                    continue
                for k in self.ends[kid]:
                    other = self.sizes[k]
                    if low <= other <= high and whole * got >= least * (size + other):
                        found.append(k)
                open_.append((kid, got))
        self.marked[mine] = False
        return found


def _find(root: list[int], k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return k


def join_sets(tokens: list[np.ndarray], sizes: list[int], probes: list[int], stored_sets: list[int], counts: Callable, least: int) -> list[tuple[int, int]]:
    """Links (as places of sets) between probes and stored sets that join all that are linked. Once a group has
    half of the probes, its other members need not be looked up: whoever is linked with one and not
    in it is looked up itself."""
    every, inverse, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    # common n-grams first: the order of the prefixes, from its end; those of one set only are left out
    order = np.lexsort((~every, -counts(every).astype(np.int64)))
    order = order[times[order] > 1]
    rank = np.full(len(every), -1, np.int64)
    rank[order] = np.arange(len(order))
    cuts = np.cumsum([0, *map(len, tokens)]).tolist()
    ranks = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        mine = rank[inverse[i:j]]
        ranks.append(np.sort(mine[mine >= 0]))
    able = [len(r) >= least_overlap(n, least) for r, n in zip(ranks, sizes, strict=True)]
    stored_sets = [k for k in stored_sets if able[k]]
    if not stored_sets:
        return []
    trie = Trie([ranks[k] for k in stored_sets], [sizes[k] for k in stored_sets], len(order))
    probes = [k for k in probes if able[k]]
    root, members, links, largest = list(range(len(tokens))), [1] * len(tokens), [], None
    # only if probes are stored too, those left out are found by the others
    may_skip = set(probes) <= set(stored_sets)
    for k in probes:
        if largest is not None and _find(root, k) == _find(root, largest):
            continue
        for place in trie.linked(ranks[k], sizes[k], least):
            a, b = _find(root, k), _find(root, stored_sets[place])
            if a != b:
                links.append((k, stored_sets[place]))
                root[a] = b
                members[b] += members[a]
                if may_skip and largest is None and 2 * members[b] > len(probes):
                    largest = b
    return links


def _joined(counts: Callable, least: int) -> Callable[[pa.Table], pa.Table]:
    """Joins the sets of each (centre, block) of a task. A set that is looked up only is not stored."""

    def join(rows: pa.Table) -> pa.Table:
        centre, block = (rows.column(c).to_numpy() for c in ("centre", "block"))
        node, size, inside, asks = (rows.column(c).to_numpy() for c in ("node", "n", "inside", "asks"))
        order = np.lexsort((node, block, centre))
        new = np.nonzero(np.concatenate([[True], (np.diff(centre[order]) != 0) | (np.diff(block[order]) != 0)]))[0]
        tokens, out = rows.column("tokens"), []
        for i, j in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
            some = order[i:j]
            if j - i > 1:
                links = join_sets([np.frombuffer(tokens[k].as_py(), np.uint64) for k in some.tolist()], size[some].tolist(),
                                  np.nonzero(asks[some])[0].tolist(), np.nonzero(inside[some])[0].tolist(), counts, least)
                out += [(int(node[some[a]]), int(node[some[b]])) for a, b in links]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return join


def sets_of(docs: DataFrame, wanted, size: int) -> DataFrame:
    """hi, lo and all n-grams of each distinct set that the filter lets through."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for piece in pieces(batches):
            his, los, blobs = [], [], []
            for tokens in ngram_sets(piece.column("text"), size):
                mark = _signature(tokens)
                place = mark[1] & ((1 << FILTER_BITS) - 1)
                if wanted.value[place >> 3] >> (place & 7) & 1 and mark not in seen:
                    seen.add(mark)
                    his.append(mark[0])
                    los.append(mark[1])
                    blobs.append(tokens.tobytes())
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(blobs, pa.binary())], ["hi", "lo", "tokens"])

    found = docs.select("text").mapInArrow(rows, "hi long, lo long, tokens binary")
    return found.groupBy("hi", "lo").agg(F.first("tokens").alias("tokens"))


def filter_of(members: DataFrame) -> np.ndarray:
    """A filter of fixed size: a bit for the last bits of each set's hash, whatever the number of sets."""
    place = F.col("lo").bitwiseAND((1 << FILTER_BITS) - 1)
    words = members.groupBy(F.shiftright(place, 5).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((lo & {(1 << FILTER_BITS) - 1}) & 31 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 5, "<u4")
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint8)


def links(docs: DataFrame, members: DataFrame, sketch, size: int, least: int, block: int) -> DataFrame:
    """a, b: links between nodes that join all that are linked."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(filter_of(members))
    weights = members.groupBy("centre").agg(F.sum("n").alias("weight"), F.count("*").alias("rows")).where("rows > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("weight") / block)).cast("long")
    placed = members.join(weights, "centre").select("centre", "node", "hi", "lo", "n", blocks.alias("blocks"))
    full = stored(placed.join(sets_of(docs, wanted, size), ["hi", "lo"]).select(
        "centre", "node", "n", "blocks", "tokens", F.expr("pmod(xxhash64(node), blocks)").alias("block")), "members")
    parts = max(16, -(-(full.agg(F.sum("n")).first()[0] or 0) // PER_TASK))
    join = _joined(lambda tokens: counted(tokens, sketch.value), least)

    def joined(rows: DataFrame, name: str) -> DataFrame:
        part = F.expr(f"pmod(xxhash64(centre, block), {parts})")
        return stored(rows.select("centre", "block", "node", "n", "inside", "asks", "tokens", part.alias("part")).groupBy("part").applyInArrow(
            join, "a long, b long"), name)

    yes = F.lit(True)
    found = joined(full.withColumns({"inside": yes, "asks": yes}), "links")
    large = full.where("blocks > 1")
    if large.isEmpty():
        return found
    # one set of each group found so far, with those of the star's other blocks
    grouped = stored(_labelled(large, found), "grouped")
    firsts = grouped.where("node = label")
    weights = firsts.groupBy("centre").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / block)).cast("long").alias("some"))
    firsts = firsts.join(weights, "centre").withColumn("block", F.expr("pmod(xxhash64(node, 1L), some)")).drop("some")
    found = found.unionByName(joined(firsts.withColumns({"inside": yes, "asks": yes}), "links"))
    # then every set outside its star's largest group, in all blocks
    grouped = stored(_labelled(large, found), "grouped")
    sizes = grouped.groupBy("centre", "label").agg(F.count("*").alias("rows"))
    largest = sizes.groupBy("centre").agg(F.max_by("label", F.struct("rows", "label")).alias("largest"))
    outside = grouped.join(largest, "centre").where("label <> largest").drop("largest")
    asks = outside.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = grouped.join(outside.select("centre").distinct(), "centre", "left_semi").withColumns({"inside": yes, "asks": F.lit(False)})
    return found.unionByName(joined(rows.unionByName(asks.withColumns({"inside": F.lit(False), "asks": yes})), "links"))


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """With the label of the group that each node is in; its smallest node."""
    roots = components(found)
    return rows.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def join_ngrams(docs: DataFrame, size: int = SIZE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    signed = signatures(docs, size)
    sketch = spark.sparkContext.broadcast(sketch_of(signed))
    members = stored(stars(prefixes(docs, sketch, size, least), least), "stars")
    roots = components(links(docs, members, sketch, size, least, block))
    rows = signed.where("kind = 'doc'").select("doc_id", "n", "hi", "lo")
    sets = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("first"))
    linked = members.select("node", "hi", "lo").distinct().join(roots, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("root"))
    sets = stored(sets.join(linked, ["hi", "lo"], "left"), "sets")
    least_of = sets.where("root is not null").groupBy("root").agg(F.min("first").alias("of_root"))
    named = sets.join(least_of, "root", "left").select("hi", "lo", F.coalesce("of_root", "first").alias("of_set"))
    empty = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    full = rows.where("n > 0").join(named, ["hi", "lo"], "left").select("doc_id", "n", F.col("of_set").alias("component_id"))
    return full.unionByName(empty).withColumnRenamed("n", "n_shingles")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(table(spark, sf_dir, "documents"))
