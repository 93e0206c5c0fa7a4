"""Two tokenizers' tokens of the same bytes, aligned, and how many documents hold each pair of ids linked.

1. Texts are encoded by both tokenizers, piece by piece. Ends of tokens are marked on the bytes of a piece;
   ends that both have cut the tokens into groups, and every stretch between neighbouring ends of either
   is one link of an A and a B token. Each piece (a chunk) writes its documents' links, and the records of
   its distinct pairs with the number of its documents that hold them, as runs: radix-partitioned by A id,
   sorted by pair, deltas in zstd.
2. A partition merges its runs by a heap, in the order of (A id, B id), reading them block by block. All
   pairs of an A id follow one another, so the highest count of each A id is known when they end.
3. Each run gets its pairs' counts back in its own order, and each chunk sums them over its documents.

A record stands for all documents of a chunk, so a pair that every document holds is one record a chunk.
Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens. Rows that
repeat a doc_id count as documents of their own. A very long text is a chunk of its own, encoded whole. An
empty table gives no rows. Ties for an A id's highest count all count as best. Other columns are not looked
at, whatever their names."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm.common import pieces, stored, table

PIECE = 8 << 20
#: Text whose runs one partition merges.
BYTES_PER_PART = 64 << 20
#: Records of a run that are decoded at a time.
BLOCK = 4096
#: Texts that are encoded at a time, and words in a text of words.
BATCH, WORDS = 64, 512
#: Bits of an id in a pair, and of a document count in a record; a chunk never has more rows than an Arrow batch.
ID_BITS, COUNT_BITS = 20, 20
_LONG_SPACE = re.compile(r"\s{1000}")
#: White space that is not one space or line end between words; a sentence piece writes a space as the last of these characters.
IRREGULAR = r"[\s\x0b\x{85}\pZ]{2}|^[\s\x0b\x{85}\pZ]|[\s\x0b\x{85}\pZ]$|▁"

#: The split of byte-level BPE, and the bytes that its alphabet writes as themselves.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class ByteLevel:
    """Side A: byte-level BPE. Texts are encoded by the ranks of the file's vocabulary, which gives what its
    merges give where they stand in the order of the ids; else, and around very long white space, by its own library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        told = json.loads(self.plain.to_str())
        special = {t["content"] for t in told["added_tokens"]}
        others = [b for b in range(256) if b not in PRINTED]
        letters = {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(others)}
        vocabulary = {k: i for k, i in told["model"]["vocab"].items() if k not in special}
        self.bytes = [b""] * (1 + max(self.plain.get_vocab(with_added_tokens=True).values()))
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in told["model"]["merges"]]
        self.ranked = (told.get("normalizer") is None and not (told.get("pre_tokenizer") or {}).get("add_prefix_space")
                       and [vocabulary.get(m) for m in merges] == list(range(256, 256 + len(merges))))
        if self.ranked:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_SPLIT, special_tokens={},
                                          mergeable_ranks={self.bytes[i]: i for i in vocabulary.values()})

    def encode(self, text: str) -> list[int]:
        if self.ranked and not (len(text) > 1000 and _LONG_SPACE.search(text)):
            return self.fast.encode_ordinary(text)
        return self.plain.encode(text, add_special_tokens=False).ids


class Pieces:
    """Side B: sentence pieces. The library puts a space before every text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(names)]
        self.apart = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers, and the tables that write the groups of a text."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_size, self.b_size = (np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b))
        # of an A token: within a group, and last of it; of a B token likewise
        self.written = [b"%d%s" % (i, mark) for n, marks in ((len(self.a_size), (b",", b"|")), (len(self.b_size), (b",", b";")))
                        for mark in marks for i in range(n)]


@cache
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers).tobytes(), 1)


def unpacked(blob: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def run_of(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: blocks of records, each the deltas of its keys and its counts, and the length of each block."""
    blocks = [packed(np.concatenate([np.diff(keys[k:k + BLOCK], prepend=0), counts[k:k + BLOCK]])) for k in range(0, len(keys), BLOCK)]
    head = np.array([len(blocks), *map(len, blocks)], "<u4")
    return head.tobytes() + b"".join(blocks)


def blocks_of(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = int(np.frombuffer(run, "<u4", 1)[0])
    at = 4 + 4 * n
    for size in np.frombuffer(run, "<u4", n, 4).tolist():
        both = unpacked(run[at:at + size])
        yield np.cumsum(both[:len(both) // 2]), both[len(both) // 2:]
        at += size


def merged(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of sorted runs, and the sums of their counts. One block of each run is decoded at a time."""
    records = [chain.from_iterable(((keys << COUNT_BITS) | counts).tolist() for keys, counts in blocks_of(run)) for run in runs]
    mask = (1 << COUNT_BITS) - 1
    found = [(key, sum(r & mask for r in same)) for key, same in groupby(heapq.merge(*records), lambda r: r >> COUNT_BITS)]
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def part_of(a: np.ndarray, parts: int) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


@dataclass
class Aligned:
    """Texts' figures (a row each of FIGURES), their groups written out, and the pairs of all their links."""

    good: np.ndarray
    figures: np.ndarray
    groups: list[bytes]
    pairs: np.ndarray

    def with_rows(self, other: Aligned) -> Aligned:
        return Aligned(np.concatenate([self.good, other.good]), np.concatenate([self.figures, other.figures], axis=1),
                       [*self.groups, *other.groups], np.concatenate([self.pairs, other.pairs]))

    def take(self, rows: np.ndarray, bounds: np.ndarray) -> Aligned:
        """Texts put together from these: text k from the rows bounds[k] to bounds[k + 1], at least one."""
        each = self.figures[LINKS][rows]
        good = np.logical_and.reduceat(self.good[rows], bounds[:-1]) if len(rows) else np.zeros(0, bool)
        figures = np.add.reduceat(self.figures[:, rows], bounds[:-1], axis=1) * good if len(rows) else np.zeros((len(FIGURES), 0), np.int64)
        first = np.cumsum(self.figures[LINKS]) - self.figures[LINKS]
        kept = np.repeat(good, np.diff(bounds)) if len(rows) else np.zeros(0, bool)
        rows_kept, each = rows[kept], each[kept]
        places = np.repeat(first[rows_kept] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        codes = rows.tolist()
        groups = [b";".join(map(self.groups.__getitem__, codes[i:j])) if g else b""
                  for i, j, g in zip(bounds[:-1].tolist(), bounds[1:].tolist(), good.tolist(), strict=True)]
        return Aligned(good, figures, groups, self.pairs[places])


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
LINKS = FIGURES.index("n_links")


def _aligned(texts: list[str], two: Pair, rows: list[np.ndarray]) -> Aligned:
    """rows: of each text, the bytes (of the text and the space before it) at which its rows end. At such ends
    tokens of both sides end. A text that is not given back byte for byte makes all its rows bad."""
    kept, a_lists, b_lists = np.zeros(len(texts), bool), [], []
    size = two.a_size.tolist()
    for at in range(0, len(texts), BATCH):
        some = texts[at:at + BATCH]
        for k, (text, b) in enumerate(zip(some, two.b.encode(some), strict=True), at):
            spaced = " " + text
            raw = spaced.encode()
            if text and b"".join(map(two.b.bytes.__getitem__, b)) == raw:
                a = two.a.encode(spaced)
                if sum(map(size.__getitem__, a)) == len(raw):  # byte-level tokens are the bytes themselves, or some are missing
                    kept[k] = True
                    a_lists.append(a)
                    b_lists.append(b)
    good = np.repeat(kept, list(map(len, rows)))
    figures, groups = np.zeros((len(FIGURES), len(good)), np.int64), [b""] * len(good)
    if not kept.any():
        return Aligned(good, figures, groups, np.zeros(0, np.int64))
    a, b = (np.fromiter(chain.from_iterable(lists), np.int32, sum(map(len, lists))) for lists in (a_lists, b_lists))
    ends, at = [], 0
    for k in np.nonzero(kept)[0].tolist():
        ends.append(rows[k] + at)
        at += int(rows[k][-1])
    ends = np.concatenate(ends)
    a_ends, b_ends = np.cumsum(two.a_size[a]), np.cumsum(two.b_size[b])
    in_a, in_b = (np.zeros(at + 1, bool) for _ in range(2))
    in_a[a_ends] = True
    in_b[b_ends] = True
    either, common = np.nonzero(in_a | in_b)[0], np.nonzero(in_a & in_b)[0]
    a_before, b_before = np.cumsum(in_a, dtype=np.int32), np.cumsum(in_b, dtype=np.int32)
    a_at, b_at = a_before[either] - in_a[either], b_before[either] - in_b[either]
    upto = [a_before[ends], b_before[ends], np.searchsorted(common, ends) + 1, np.searchsorted(either, ends) + 1]
    figures[:, good] = [np.diff(u, prepend=0) for u in upto]
    pairs = (a[a_at].astype(np.int64) << ID_BITS) | b[b_at]

    # the groups as text: a token's place is after all before it on its side and, on the other side, all of
    # earlier groups (for B, of its own too)
    a_upto, b_upto = a_before[common], b_before[common]
    a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
    b_earlier = np.concatenate([[0], b_upto])
    codes = np.empty(len(a) + len(b), np.int32)
    codes[np.arange(len(a)) + b_earlier[a_group]] = a + len(two.a_size) * in_b[a_ends]
    codes[np.arange(len(b)) + a_upto[b_group]] = 2 * len(two.a_size) + b + len(two.b_size) * in_a[b_ends]
    written = list(map(two.written.__getitem__, codes.tolist()))
    until = (upto[0].astype(np.int64) + upto[1]).tolist()
    for k, i, j in zip(np.nonzero(good)[0].tolist(), [0, *until], until, strict=False):
        groups[k] = b"".join(written[i:j])[:-1]
    return Aligned(good, figures, groups, pairs)


def align_texts(texts: list[str], two: Pair) -> Aligned:
    return _aligned(texts, two, [np.array([len(t.encode()) + 1]) for t in texts])


def align_words(words: list[str], two: Pair) -> Aligned:
    """Words without white space at their ends, encoded many in a text; those of a text that is not good, one by one."""
    blocks = [words[k:k + WORDS] for k in range(0, len(words), WORDS)]
    many = _aligned(list(map(" ".join, blocks)), two, [np.cumsum([len(w.encode()) + 1 for w in b]) for b in blocks])
    bad = np.nonzero(~many.good)[0]
    if not len(bad):
        return many
    single = align_texts([words[k] for k in bad.tolist()], two)
    order = np.arange(len(words))
    order[bad] = len(words) + np.arange(len(bad))
    return many.with_rows(single).take(order, np.arange(len(words) + 1))


def align_piece(texts: pa.Array, two: Pair) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Number of each text (those with single spaces first), its figures and groups, and the pairs of all links.

    Neither side's tokens reach over a single space between words, so such a text is put together from its
    words, and each distinct word of a piece is encoded once."""
    texts = pc.fill_null(texts, "")
    apart = two.a.ranked and two.b.apart
    plain = pc.and_(pc.not_equal(texts, ""), pc.invert(pc.match_substring_regex(texts, IRREGULAR))).to_numpy(zero_copy_only=False) & apart
    lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    words = align_words(coded.dictionary.to_pylist(), two).take(coded.indices.to_numpy().astype(np.int64), bounds - bounds[0])
    both = words.with_rows(align_texts(texts.filter(pa.array(~plain)).to_pylist(), two))
    return np.concatenate([np.nonzero(plain)[0], np.nonzero(~plain)[0]]), both.figures, both.groups, both.pairs


_CHUNK = "kind string, chunk long, part int, body binary"


def chunks(docs: DataFrame, a_path: str, b_path: str, parts: int, groups: bool = False) -> DataFrame:
    """The written chunks. kind docs: a chunk's documents, as an Arrow stream; kind run: its run of a part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, first = pair(a_path, b_path), TaskContext.get().partitionId() << 32
        for number, piece in enumerate(pieces(batches, limit=PIECE)):
            n = piece.num_rows
            rows_of, figures, written, pairs = align_piece(piece.column("text"), two)
            back = np.argsort(rows_of)
            of_text = np.repeat(rows_of, figures[LINKS])
            # distinct pairs of each document, then of the chunk in the order of (part, pair)
            by_text = np.sort((of_text << 2 * ID_BITS) | pairs)
            start = np.nonzero(np.diff(by_text, prepend=-1))[0]
            times = np.diff(np.append(start, len(by_text)))
            by_text = by_text[start]
            keys, place, counts = np.unique(by_text & ((1 << 2 * ID_BITS) - 1), return_inverse=True, return_counts=True)
            part = part_of(keys >> ID_BITS, parts)
            order = np.argsort(part, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            keys, counts = keys[order], counts[order]
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            runs = [(p, run_of(keys[i:j], counts[i:j])) for p, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]
            # of each document, the places of its pairs in that order, and how often it holds each
            text = by_text >> 2 * ID_BITS
            links = np.lexsort((rank[place], text))
            place, times = rank[place][links], times[links].astype(np.int32)
            held = np.bincount(text, minlength=n)
            written = [written[k] for k in back.tolist()]
            told = {"groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in written]}
            if groups:
                told["groups"] = [g.decode() for g in written]
            table = pa.table({"doc_id": piece.column("doc_id"), **dict(zip(FIGURES, figures[:, back], strict=True)), **told, "held": held})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            bodies = [sink.getvalue().to_pybytes(), packed(np.diff(place, prepend=0).astype(np.int32)), packed(times)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["docs"] * 3 + ["run"] * len(runs)), pa.array([first + number] * (3 + len(runs)), pa.int64()),
                 pa.array([0, 1, 2, *[p for p, _ in runs]], pa.int32()), pa.array([*bodies, *[r for _, r in runs]], pa.binary())],
                ["kind", "chunk", "part", "body"])

    return stored(docs.select("doc_id", "text").mapInArrow(rows, _CHUNK), "chunks", partition_by="kind")


def _counted(runs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a part, their counts, and which have the highest count of their A id."""
    keys, counts = merged(runs.column("body").to_pylist())
    a = keys >> ID_BITS
    start = np.nonzero(np.diff(a, prepend=-1))[0]
    highest = np.repeat(np.maximum.reduceat(counts, start), np.diff(np.append(start, len(a)))) if len(a) else counts
    return keys, counts, counts == highest


def pair_counts(written: DataFrame) -> DataFrame:
    """a, b, docs, best: every linked pair of ids, and how many documents hold it."""

    def count(runs: pa.Table) -> pa.Table:
        keys, counts, best = _counted(runs)
        return pa.table({"a": keys >> ID_BITS, "b": keys & ((1 << ID_BITS) - 1), "docs": counts, "best": best})

    return written.where("kind = 'run'").groupBy("part").applyInArrow(count, "a long, b long, docs long, best boolean")


def align(docs: DataFrame, a_path: str, b_path: str, groups: bool = False, parts: int | None = None) -> DataFrame:
    """A row for each document: its figures, and with `groups` the groups of ids themselves."""
    if parts is None:
        parts = max(16, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_PER_PART))
    written = chunks(docs, a_path, b_path, parts, groups)

    def answer(runs: pa.Table) -> pa.Table:
        keys, counts, best = _counted(runs)
        value = 2 * counts + best
        bodies = [packed(value[np.searchsorted(keys, np.concatenate([k for k, _ in blocks_of(run)]))]) for run in runs.column("body").to_pylist()]
        return pa.table({"chunk": runs.column("chunk"), "part": runs.column("part"), "body": pa.array(bodies, pa.binary())})

    def close(held: pa.Table, answers: pa.Table) -> pa.Table:
        told = dict(zip(held.column("part").to_pylist(), held.column("body").to_pylist(), strict=True))
        table = pa.ipc.open_stream(told[0]).read_all()
        place, times = np.cumsum(unpacked(told[1], np.int32), dtype=np.int64), unpacked(told[2], np.int32)
        bodies = answers.column("body").to_pylist()
        order = np.argsort(answers.column("part").to_numpy(), kind="stable").tolist()
        value = np.concatenate([unpacked(bodies[k]) for k in order]) if order else np.zeros(0, np.int64)
        mine = value[place]
        until = np.cumsum(table.column("held").to_numpy())
        sums = {}
        for name, each in (("n_best", times * (mine & 1)), ("count_sum", times * (mine >> 1))):
            running = np.concatenate([[0], np.cumsum(each)])
            sums[name] = pa.array(running[until] - running[np.concatenate([[0], until[:-1]])])
        out = {"doc_id": table.column("doc_id"), **{c: table.column(c) for c in FIGURES}, **sums, "groups_sha256": table.column("groups_sha256")}
        return pa.table(out | ({"groups": table.column("groups")} if groups else {}))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in [*FIGURES, 'n_best', 'count_sum'])}, groups_sha256 string"
    answers = written.where("kind = 'run'").select("chunk", "part", "body").groupBy("part").applyInArrow(answer, "chunk long, part int, body binary")
    held = written.where("kind = 'docs'").select("chunk", "part", "body")
    return held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(close, schema + (", groups string" if groups else ""))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
