"""Token ids in Simple-8b blocks: text -> ids -> written blocks -> ids.

A block is one row of a written table: part and block number (their order is that of doc_id), the ids and
lengths of its documents, and a payload. The payload is a header (magic, number of ids, ids per sub-block),
the offset of each sub-block's first word, and the words, all little-endian. A word has its selector in the
low four bits; selector 0 is an escape: the next word is one raw 64-bit id. Sub-blocks start on a word of
their own, so all of them are decoded at once or one alone.

Null and empty texts have the end id only. Rows that repeat a doc_id stand together, ordered by text; null
doc_ids come first. A very long text is a block of its own. An empty table gives no blocks and no rows.
Other columns are not looked at, whatever their names."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm.common import parts_for, pieces, stored, table, with_offsets

END_ID = 1
DOCS_PER_PART = 10_000
PIECE = 8 << 20
SUB_BLOCK = 1024
#: Words in a text that is made of them, and words encoded at a time.
JOINED, BATCH = 512, 16_384
#: Bytes of known words and their ids that a task keeps from piece to piece.
CACHED_BYTES = 48 << 20
IDS = pa.large_list(pa.uint32())
#: Letters up to U+00FF beyond ASCII, and ASCII punctuation, in a regular expression's brackets.
LETTERS, LOWER_LETTERS, MARKS = "À-ÖØ-öø-ÿ", "ß-öø-ÿ", r"!-/:-@\[-`{-~"

#: Fixed values of Simple-8b: (ids in a word, bits of each) for the selectors 1 to 14.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([1, *[c for c, _ in SELECTORS]], np.int64)
LIMITS = np.array([1 << b for _, b in SELECTORS], np.uint64)
#: The narrowest selector for one id, by the id: for those of up to 16 bits.
NEEDED = (np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right") + 1).astype(np.uint8)
MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIQQ")
_PAD = 60


def encode(ids: np.ndarray, sub_block: int = SUB_BLOCK) -> bytes:
    """A payload. For every place the narrowest selector that fits from there on is found for all places
    at once, by maxima over growing windows; then each sub-block hops from word to word, all in step."""
    n = len(ids)
    blocks = -(-n // sub_block)
    rows = np.zeros((blocks, sub_block + _PAD), ids.dtype)
    flat = np.zeros(blocks * sub_block, ids.dtype)
    flat[:n] = ids
    rows[:, :sub_block] = flat.reshape(blocks, sub_block)
    if n and ids.max() < len(NEEDED):
        need = NEEDED.take(rows)
    else:
        need = (np.searchsorted(LIMITS, rows.ravel(), side="right") + 1).astype(np.uint8).reshape(rows.shape)
    chosen = np.zeros(rows.shape, np.uint8)
    widest, width = need, 1
    for selector in range(len(SELECTORS), 0, -1):
        count = SELECTORS[selector - 1][0]
        if count > width:
            step = np.zeros_like(widest)
            step[:, :-(count - width)] = widest[:, count - width:]
            widest, width = np.maximum(widest, step), count
        np.copyto(chosen, selector, where=widest <= selector)
    lengths = np.minimum(sub_block, n - np.arange(blocks) * sub_block)
    first = np.zeros(rows.shape, bool)
    row, place = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(row):
        first[row, place] = True
        place = place + COUNTS[chosen[row, place]]
        on = place < lengths[row]
        row, place = row[on], place[on]
    spots, rows = np.nonzero(first.ravel())[0], rows.ravel()
    selectors = chosen.ravel()[spots]
    size = 1 + (selectors == 0)
    at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for selector in np.unique(selectors):
        here = np.nonzero(selectors == selector)[0]
        if selector == 0:
            words[at[here] + 1] = rows[spots[here]]
            continue
        count, bits = SELECTORS[selector - 1]
        spot, packed = spots[here], np.full(len(here), selector, np.uint64)
        for k in range(count):
            packed |= rows.take(spot + k).astype(np.uint64) << np.uint64(4 + k * bits)
        words[at[here]] = packed
    starts = at[np.searchsorted(spots, np.arange(blocks) * (sub_block + _PAD))] if blocks else np.zeros(0, np.int64)
    return HEADER.pack(MAGIC, sub_block, n, len(words)) + starts.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode(payload: bytes) -> np.ndarray:
    magic, sub_block, n, n_words = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b payload")
    blocks = -(-n // sub_block)
    starts = np.frombuffer(payload, "<u8", blocks, HEADER.size).astype(np.int64)
    words = np.frombuffer(payload, "<u8", n_words, HEADER.size + 8 * blocks)
    selectors = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(n_words, bool)
    for k in np.nonzero(selectors == 0)[0]:
        if not raw[k]:
            raw[k + 1] = True
    counts = np.where(raw, 0, COUNTS[np.where(selectors < len(COUNTS), selectors, 0)])
    before = np.cumsum(counts) - counts
    row = np.repeat(np.arange(blocks), np.diff(starts, append=n_words))
    place = before + row * (sub_block + _PAD) - before[starts][row] if n_words else before
    out = np.zeros(blocks * (sub_block + _PAD), np.uint64)
    for selector in np.unique(selectors[~raw]):
        here = np.nonzero((selectors == selector) & ~raw)[0]
        if selector == 0:
            out[place[here]] = words[here + 1]
            continue
        count, bits = SELECTORS[selector - 1]
        spot, word = place[here], words[here]
        for k in range(count):
            out[spot + k] = (word >> np.uint64(4 + k * bits)) & np.uint64((1 << bits) - 1)
    return out.reshape(blocks, -1)[:, :sub_block].reshape(-1)[:n] if blocks else out


class Encoder:
    """Ids of whole texts, by way of their distinct words.

    The tokenizer's rules never look across white space, so a text's ids are its words' ids one after
    another; a text of 100 words is mostly words that were seen before. ASCII punctuation that ends a word
    behind a letter or digit is a run of its own, so it is taken as a word, and case of letters up to \u00ff
    never matters; both except in words that may hold the name of a special token. New words are encoded many
    in a text: words of letters alone are told apart by the tokens that end a word, others by the digit 0
    between them, for digits are always tokens of their own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.zero = self.tokenizer.encode("0", add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.known, self.ids = pa.array([], pa.string()), pa.array([], IDS)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, words: pa.Array) -> pa.Array:
        ids = [i for k in range(0, len(words), BATCH) for i in self._ids(words.slice(k, BATCH).to_pylist())]
        return pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, ids)]), np.concatenate([np.zeros(0, np.uint32), *ids]))

    def _joined(self, words: pa.Array, letters: bool) -> pa.Array:
        starts = [*range(0, len(words), JOINED), len(words)]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words), " " if letters else " 0 ").to_pylist()
        found = [pa.array([], IDS)]
        for k in range(0, len(texts), BATCH // JOINED):
            for start, ids in zip(starts[k:], self._ids(texts[k:k + BATCH // JOINED]), strict=False):
                if letters:
                    ends = np.nonzero(self.ends[ids])[0] + 1
                else:
                    cut = np.nonzero(ids == self.zero[0])[0]
                    ends, ids = np.append(cut, len(ids)) - np.arange(len(cut) + 1), np.delete(ids, cut)
                some = words.slice(start, JOINED)
                if len(ends) == len(some):
                    found.append(pa.LargeListArray.from_arrays(np.append(0, ends), ids))
                else:  # not expected of any tokenizer that keeps digits apart and marks the ends of words
                    found.append(self._alone(some))
        return pa.concat_arrays(found)

    def _encode(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The words in another order, and their ids."""
        letters, zeros = pc.match_substring_regex(words, f"^[a-z{LOWER_LETTERS}]+$"), pc.match_substring(words, "0")
        kinds = [words.filter(k) for k in (letters, zeros, pc.invert(pc.or_(letters, zeros)))]
        return pa.concat_arrays(kinds), pa.concat_arrays([self._joined(kinds[0], True), self._alone(kinds[1]), self._joined(kinds[2], False)])

    def words(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words. Words are kept for later ones; when these get many, only those of now."""
        at = pc.index_in(words, value_set=self.known)
        missing = words.filter(at.is_null())
        new, ids = self._encode(missing)
        at = pc.replace_with_mask(at, at.is_null(), pc.add(pc.index_in(missing, value_set=new), pa.scalar(len(self.known), pa.int32())))
        self.known, self.ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.ids, ids])
        found = self.ids.take(at)
        if self.known.nbytes + self.ids.nbytes > CACHED_BYTES:
            self.known, self.ids = words, found
        return found

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with its end id, and the texts' lengths."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        # distinct words without their tails and case, and what each of those has behind it
        raw, n = coded.dictionary, len(coded.dictionary)
        plain = pc.invert(pc.match_substring(raw, "<|"))
        tailed = pc.and_(plain, pc.match_substring_regex(raw, f"[0-9A-Za-z{LETTERS}][{MARKS}]+$"))
        base = pc.if_else(tailed, pc.ascii_rtrim(raw, punctuation), raw)
        base = pc.if_else(pc.and_(plain, pc.match_substring_regex(base, f"^[!-~{LETTERS}]+$")), pc.utf8_lower(base), base)
        tails = pc.struct_field(pc.extract_regex(raw.filter(tailed), f"[0-9A-Za-z{LETTERS}](?P<tail>[{MARKS}]+)$"), "tail")
        based = pa.concat_arrays([base, tails]).dictionary_encode()
        at, has = based.indices.to_numpy(), tailed.to_numpy(zero_copy_only=False)
        pairs, none = np.zeros((n, 2), np.int32), np.ones((n, 2), bool)
        pairs[:, 0], pairs[has, 1], none[:, 0], none[has, 1] = at[:n], at[n:], False, False
        halves = self.words(based.dictionary).take(pa.array(pairs.ravel(), mask=none.ravel()))
        items = pa.concat_arrays([pa.LargeListArray.from_arrays(halves.offsets.to_numpy()[::2], halves.values), pa.array([[end_id]], IDS)])
        # every occurrence, and behind each text the end id
        bounds = lists.offsets.to_numpy().astype(np.int64)
        ends = bounds[1:] - bounds[0] + np.arange(len(bounds) - 1)
        codes, of_words = np.full(len(coded) + len(ends), n, np.int32), np.ones(len(coded) + len(ends), bool)
        of_words[ends] = False
        codes[of_words] = coded.indices.to_numpy()
        found = items.take(pa.array(codes))
        return found.values.to_numpy(), np.diff(found.offsets.to_numpy()[np.concatenate([[0], ends + 1])])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


BLOCKS = "part int, block long, doc_ids array<long>, lengths array<long>, payload binary"


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID, docs_per_part: int = DOCS_PER_PART) -> DataFrame:
    """The written blocks of all documents, in ascending doc_id order of (part, block)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for block, piece in enumerate(pieces(batches, limit=PIECE)):
            ids, lengths = encoder(tokenizer).texts(piece.column("text"), end_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([encode(ids)], pa.binary())],
                ["part", "block", "doc_ids", "lengths", "payload"])

    # rows without an id are spread by how their texts begin, which keeps them in the order of the texts
    unnamed = F.when(F.col("doc_id").isNull(), F.substring("text", 1, 64))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts_for(docs.count(), docs_per_part), "doc_id", unnamed)
    return stored(ordered.sortWithinPartitions("doc_id", "text").mapInArrow(rows, BLOCKS), "blocks")


def read_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the blocks, from the decoded ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["payload"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                sums = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), row["lengths"], strict=True)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array(range(n), pa.int64()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "block", "place", "doc_id", "n_tokens", "ids_crc32"])

    read = blocks.mapInArrow(rows, "part int, block long, place long, doc_id long, n_tokens long, ids_crc32 long")
    digests = stored(read, "digests")
    return with_offsets(digests, "part", [F.col("block"), F.col("place")], {"start": "n_tokens"}).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


def token_output(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return read_digests(write_blocks(docs, public_tokenizers.path("word_bpe_49k.json")))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
