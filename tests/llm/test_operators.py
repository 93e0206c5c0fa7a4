"""Each operator against brute force on small rows with nulls, empty and long texts, ties, repeated rows,
empty tables and other columns whose names clash with the operators' own."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import DataFrame, functions as F

from footfall.llm import (common, decontamination, line_dedup, mixing, quality_rules, sharding, simhash, suffix_dedup,
                          token_output, toxicity, url_filter)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, size long, stats string, fp long"
PROSE = [" ".join(f"w{(7 * k * i + i) % 97}" for i in range(60 + k)) for k in range(1, 9)]
LINE = "  A common footer line that is longer than forty characters.\t"


def rows() -> list[tuple]:
    texts = [None, "", " \n\t", "one two", PROSE[0], PROSE[0], PROSE[1] + "\n" + LINE, LINE.lower() + "\n" + PROSE[2],
             LINE + "\n" + LINE, LINE, PROSE[3] + "\n" + LINE.upper(), "x" * 30_000, "é" * 49 + " " + PROSE[4],
             "ab " * 5_000, PROSE[5][:200] + PROSE[6], PROSE[6] + PROSE[5][:200], "1 # 2 $ 3\n\n1 # 2 $ 3", PROSE[7] + " <|endoftext|> 0 x, 'S"]
    sources = [None, "b", "a", "c", "b"]
    return [(3 * k + 1, t, None, sources[k % 5], None, "k", 1, 2, "s", 3) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark) -> DataFrame:
    """With repeated rows and null ids."""
    return spark.createDataFrame([*rows(), *rows()[:9], (None, PROSE[0], None, None, None, None, None, None, None, None),
                                  (None, None, None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_url_filter(spark, empty):
    urls = {1: None, 2: "", 3: "no scheme/", 4: "http://News.ORG/a", 5: "http://m.example.org/es/x", 6: "http://example.org/en/12",
            7: "http://shop.com/de/?q=casino", 8: "https://a.com/fr/poker", 9: "http://casino-win.net", 10: "http://freebets.net/free",
            11: "http://free-bets.net/", 12: "http://bets.net/bets", 13: "x://h?casinos#y", 14: "http://a.net/" + "y" * 50_000 + "/porn"}
    pages = spark.createDataFrame([(k, u, "h", "p", 1.0) for k, u in [*urls.items(), (14, urls[14])]], "page_id long, url string, host string, path string, score double")
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    verdicts = {k: (r["rule"], r["verdict"]) for k, r in found.items()}
    assert verdicts == {
        1: (None, "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: ("org/", "allow"), 5: ("example.org/es/", "block"),
        6: ("example.org/en/1", "block"), 7: ("com/de/", "block"), 8: ("com/fr/", "allow"), 9: (None, "block"), 10: (None, "allow"),
        11: (None, "block"), 12: (None, "allow"), 13: (None, "allow"), 14: (None, "block")}
    assert (found[4]["host"], found[4]["path"], found[13]["host"], found[13]["path"], found[3]["host"]) == ("news.org", "/a", "h", "", "")
    assert url_filter.judge_urls(pages).count() == 15
    assert url_filter.judge_urls(pages.where("false")).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, {}, []).collect()} == {"allow"}


def brute_lines(data: list[tuple]) -> dict:
    holders, out = defaultdict(set), {}
    key = lambda x: x.strip(common.SPACE).translate(str.maketrans(common.UPPER, common.LOWER))
    for doc_id, text, *_ in data:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 40:
                holders[key(line)].add(doc_id)
    for doc_id, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders[key(x)]) < 5 or doc_id == max(holders[key(x)])]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_line_dedup(which, request):
    frame = request.getfixturevalue(which)
    wanted = brute_lines([r for r in frame.collect() if r["doc_id"] is not None])
    got = [r for r in line_dedup.dedup_lines(frame).collect() if r["doc_id"] is not None]
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in got} == wanted
    assert line_dedup.dedup_lines(frame).count() == frame.count()
    assert which == "empty" or sum(w[1] for w in wanted.values()) == 5


def test_runs_are_merged_by_level(spark):
    runs = line_dedup.SortedRuns(spark, fanout=2)
    for k in range(4):
        batch = spark.createDataFrame([(bytes([x]), k) for x in range(k, k + 3)], "key binary, keeper long")
        runs.add(runs.fresh(batch))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert {r["key"][0]: r["keeper"] for r in runs.known().collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_mixing(which, request):
    frame = request.getfixturevalue(which)
    sized = frame.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    data = mixing.fair_queue(sized).collect()
    assert Counter((r["doc_id"], r["size"]) for r in data) == Counter((r["doc_id"], len(words(r["text"]))) for r in frame.collect())
    total = sum(r["size"] for r in data)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in data}
    assert sum(t for _, t in targets.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 for s, t in targets.values())
    level = {n: t / (1 + k % 3) for k, (n, (s, t)) in enumerate(sorted(targets.items(), key=lambda x: (x[0] is None, x[0] or ""))) if t < 3 * s - 1e-6}
    assert max(level.values(), default=0) == pytest.approx(min(level.values(), default=0))
    taken = Counter()
    for r in data:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert sum(taken.values()) <= total
    assert all(abs(taken[s] - t) <= 5_001 for s, (_, t) in targets.items())
    assert Counter(map(tuple, mixing.fair_queue(sized).collect())) == Counter(map(tuple, data))
    copies = Counter((r["doc_id"]) for r in mixing.mix(frame).collect())
    wanted = Counter()
    for r in data:
        wanted[r["doc_id"]] += r["copies"]
    assert copies == +wanted
    assert mixing.mix(frame).columns == frame.columns


@pytest.mark.parametrize("last_time", [mixing.LAST_TIME, 0.25])
def test_mixing_cuts_the_queue_where_the_budget_ends(spark, monkeypatch, last_time):
    """Copy by copy in the order of their finish times, whether the cut falls into a narrow time range or the last one."""
    monkeypatch.setattr(mixing, "LAST_TIME", last_time)
    rng = np.random.default_rng(11)
    data = [(None if k % 7 == 0 else k, ["a", "b", None, "c", "d"][int(k ** 0.5) % 5], int(rng.integers(0, 60))) for k in range(600)]
    found = mixing.fair_queue(spark.createDataFrame(data, "doc_id long, source string, size long")).collect()
    targets = {r["source"]: r["target"] for r in found}
    mark = lambda i, n: hashlib.md5((f"size {n}" if i is None else str(i)).encode()).hexdigest()
    queue = []
    for source, target in targets.items():
        own = sorted((mark(i, n), -1 if i is None else i, n) for i, s, n in data if s == source)
        total = sum(n for *_, n in own)
        before = 0
        for _, i, n in own:
            before += n
            queue += [((total * k + before) / target, i, source, n) for k in range(3) if n]
    budget, words_by_time = sum(n for *_, n in data), Counter()
    for time, _, _, n in queue:
        words_by_time[time] += n
    used, stop = 0, float("inf")
    for time in sorted(words_by_time):
        used += words_by_time[time]
        if used > budget:
            stop = time
            break
    wanted = Counter()
    for time, i, source, n in queue:
        wanted[i, source, n] += time < stop
    got = Counter()
    for r in found:
        if r["size"]:
            got[-1 if r["doc_id"] is None else r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert +got == +wanted
    assert budget - 60 <= sum(r["copies"] * r["size"] for r in found) <= budget


def test_mixing_of_nothing(empty, spark):
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["copies"] for r in mixing.fair_queue(blank.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()] == [0, 0]


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_sharding(which, request):
    frame = request.getfixturevalue(which)
    got = sorted(sharding.byte_shards(frame, shards=4).collect(), key=lambda r: (r["shard"], r["slot"]))
    wanted = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in frame.collect())
    assert [(-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got] == wanted
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(s == list(range(len(s))) for s in slots.values())
    assert all(abs(s - sum(sizes.values()) / 4) <= 30_008 for s in sizes.values())


def brute_stats(text: str | None) -> tuple:
    own = words(text)
    windows = Counter(tuple(own[k:k + 8]) for k in range(len(own) - 7))
    hit = {p for k in range(len(own) - 7) if windows[tuple(own[k:k + 8])] > 1 for p in range(k, k + 8)}
    lines = (text or "").split("\n")
    dup = sum(bool(words(x)) and x in lines[:k] for k, x in enumerate(lines))
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_statistics(awkward):
    for r in awkward.select("text", quality_rules.text_stats("text").alias("s")).collect():
        assert tuple(r["s"])[:5] == brute_stats(r["text"])


def test_quality_rules(spark, awkward, empty):
    good = [" ".join(f"word{(i * k) % 31}x{i % (5 + k % 7)}" for i in range(40 + k)) for k in range(1, 60)]
    bad = [" ".join(f"{w}***" if i % 3 else w for i, w in enumerate(g.split())) for g in good[:30]]
    texts = [*good, *bad]
    frame = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, stats long")
    labels = spark.createDataFrame([(k, int(k < len(good)), None) for k in range(len(texts))] + [(None, 0, 1), (999, 0, 0), (0, None, 1)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_rules.keep_good(frame, labels).collect()}
    assert {k for k in kept if k < len(good)} == {k for k in range(len(good)) if 100 * brute_stats(good[k])[4] <= 30 * brute_stats(good[k])[0]}
    assert len([k for k in kept if k >= len(good)]) <= 3  # what is learned needn't be right about every row
    assert quality_rules.learn(frame, labels.where("false")) == []
    assert quality_rules.keep_good(empty, labels).count() == 0
    alone = quality_rules.keep_good(awkward, labels.where("false"))
    assert alone.columns == awkward.columns
    wanted = [s for r in awkward.collect() for s in [brute_stats(r["text"])] if s[0] >= 20 and 100 * s[4] <= 30 * s[0]]
    assert alone.count() == len(wanted)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 4_000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) >> rng.integers(0, 64, n).astype(np.uint64)
    assert (token_output.decode(token_output.encode(ids)) == ids).all()
    assert len(token_output.decode(token_output.encode(ids, 7))) == n
    small = rng.integers(0, 2, n).astype(np.uint64)
    assert len(token_output.encode(small)) <= 24 + 16 * (n // 60 + 2 * (n // 1024 + 1))


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_token_output(which, request):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    frame = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, wanted = 0, []
    for r in sorted(frame.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        wanted.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_output.token_output(frame).collect()), key=lambda r: r[1])
    assert [r[1:] for r in got] == [w[1:] for w in wanted] and [r[0] for r in got] == [w[0] for w in wanted]


def test_words_are_encoded_like_whole_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    encoder = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's 10,000. A\u0301 \u00c5 e\u0301, K\u212a!.", "<|ENDOFTEXT|> <|endoftext|>x a<|startoftext|>, b.", "\u00a0x\u3000y\x1c z \u0301q 0 00 0a. 0",
             None, "", "We'll they'd'S , . ., x.. (y), \U0001f600\u200d. ﬁ İ ß", "a\x00b\tc\x0bd"]
    ids, lengths = encoder.texts(pa.array(texts), 1)
    for text, end, n in zip(texts, np.cumsum(lengths), lengths, strict=True):
        assert ids[end - n:end].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_that_differ_in_case_or_punctuation_are_encoded_once(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    encoder = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    sent, ids_of = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: sent.extend(texts) or ids_of(texts))
    words = [f"{a}{b}{c}" for a in ("haus", "\u00e4ther", "ni\u00f1o") for b in ("end", "ung", "caf\u00e9") for c in "abcdefgh"]
    shown = [" ".join(f"{change(w)}{tail}" for w in words) for change in (str, str.title, str.upper) for tail in ("", "!!!", "***", ".&&&", ",")]
    ids, lengths = encoder.texts(pa.array(shown), 1)
    for text, end, n in zip(shown, np.cumsum(lengths), lengths, strict=True):
        assert ids[end - n:end].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert sum(map(len, sent)) < 1.2 * sum(len(w) + 1 for w in words) and not any("0" in t for t in sent if "haus" in t)


@pytest.mark.parametrize("cached", [1 << 20, 1_000])
def test_odd_words_are_encoded_like_whole_texts(cached, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    monkeypatch.setattr(token_output, "CACHED_BYTES", cached)
    encoder, rng = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json")), np.random.default_rng(8)
    letters = [*"abXY'sStdD019.,!?*&|<>/-_~()\"   \n", *"\u00e9\u00c9\u00df\u00d7\u00b5\u0130\u212a\u0301\u0338\u4e2d\u00a0\u3000\u00b2\x1c\x00\x7f", "'ll", "<|endoftext|>", "<|", "|>", "</w>", "***"]
    for _ in range(4):
        texts = [None, "", *["".join(rng.choice(letters, rng.integers(60))) for _ in range(300)]]
        ids, lengths = encoder.texts(pa.array(texts), 1)
        for text, end, n in zip(texts, np.cumsum(lengths), lengths, strict=True):
            assert ids[end - n:end].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (token_output.decode(token_output.encode(ids)) == ids).all()


def brute_repeats(data, length=50) -> dict:
    first, out = {}, {}
    for doc_id, text in data:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1) if doc_id is not None else ():
            first[raw[k:k + length]] = min(doc_id, first.get(raw[k:k + length], doc_id))
    for doc_id, text in data:
        raw, gone = (text or "").encode(), set()
        for k in range(len(raw) - length + 1) if doc_id is not None else ():
            if first[raw[k:k + length]] < doc_id:
                gone.update(range(k, k + length))
        out[doc_id, text] = (len(raw), len(gone), sum(p - 1 not in gone for p in gone), bytes(b for p, b in enumerate(raw) if p not in gone))
    return out


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_suffix_dedup(which, request):
    frame = request.getfixturevalue(which)
    wanted = brute_repeats([(r["doc_id"], r["text"]) for r in frame.collect()])
    got = suffix_dedup.remove_repeats(frame, batch_bytes=8_000).collect()
    assert len(got) == frame.count()
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == {(k[0], *v) for k, v in wanted.items()}


def test_hot_anchors_are_split(spark):
    rng = np.random.default_rng(4)
    passage = "The same long notice stands at the end of each page, whoever wrote it and why."
    texts = ["".join(rng.choice(list("abcdef "), 40)) + passage + "".join(rng.choice(list("abcdef "), 40)) for _ in range(400)]
    texts[300:320] = [t[:130] + "x" for t in texts[:20]]
    frame = spark.createDataFrame([(k if k % 50 else None, t) for k, t in enumerate([*texts, *texts[:9]])], "doc_id long, text string")
    wanted = brute_repeats([(r["doc_id"], r["text"]) for r in frame.collect()])
    got = suffix_dedup.remove_repeats(frame, batch_bytes=8_000, hot_stretches=20).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == {(k[0], *v) for k, v in wanted.items()}
    texts_ = suffix_dedup.bucketed(frame, 8)
    whole, split = ({r["bucket"]: r["n"] for r in suffix_dedup.requests(texts_, 8, 50, hot).groupBy("bucket").agg(
        F.sum(F.length("blob")).alias("n")).collect()} for hot in (1 << 16, 20))
    assert max(n for b, n in split.items() if b < 8) < max(whole.values()) / 2  # no bucket has a hot anchor's stretches
    strings = [n for b, n in split.items() if b >= 8]
    assert len(strings) == 8 and max(strings) < 1.3 * min(strings)


class LocalGroups:
    """A table whose groups are worked here. Keeps the most memory a function took for a group, by its name."""

    def __init__(self, rows, peaks, key=None, other=None):
        self.rows, self.peaks, self.key, self.other = rows, peaks, key, other

    def groupBy(self, key):
        return LocalGroups(self.rows, self.peaks, key)

    def cogroup(self, other):
        return LocalGroups(self.rows, self.peaks, self.key, other)

    def applyInArrow(self, run, schema):
        out = []
        for value in pc.unique(self.rows[self.key]):
            args = [x.rows.filter(pc.equal(x.rows[x.key], value)) for x in (self, self.other) if x]
            tracemalloc.start()
            out.append(run(*args))
            self.peaks[run.__name__] = max(self.peaks.get(run.__name__, 0), tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        return LocalGroups(pa.concat_tables(out), self.peaks)


@pytest.mark.parametrize("size", [1_000, 1_500_000])
def test_suffix_dedup_holds_a_piece_at_once(spark, monkeypatch, size):
    """Two batches of 3 MB with the same texts: no task takes more than a few times its group, also if a batch is two
    documents."""
    rng = np.random.default_rng(8)
    text = rng.integers(97, 123, 3_000_000).astype(np.uint8).tobytes()
    texts = [text[k:k + size] for k in range(0, len(text), size)]
    rows = pa.table({"doc_id": pa.array(range(2 * len(texts)), pa.int64()), "text": pa.array(texts * 2, pa.binary()),
                     "batch": pa.array([0] * len(texts) + [1] * len(texts), pa.int64())})
    peaks = {}
    monkeypatch.setattr(suffix_dedup, "bucketed", lambda docs, batches: LocalGroups(rows, peaks))
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string")).rows.to_pylist()
    assert [r["kept"] for r in sorted(got, key=lambda r: r["doc_id"])] == texts + [b""] * len(texts)
    assert sum(r["n_removed"] for r in got) == len(text) and len(got) == 2 * len(texts)
    assert max(peaks.values()) < 60e6 and peaks["sort_bucket"] < 25e6


def test_suffix_sorting_in_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_SUFFIXES", 500)
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 4_000).astype(np.uint8)
    data[2_000:2_900] = data[100:1_000]
    data[3_000:3_500] = 7
    places, ids, least = np.arange(3_950), rng.permutation(3_950), {}
    for p in places:
        least[data[p:p + 50].tobytes()] = min(ids[p], least.get(data[p:p + 50].tobytes(), 9_999))
    assert [least[data[p:p + 50].tobytes()] for p in places] == suffix_dedup.smallest_ids(data, places, ids, 50).tolist()
    order = suffix_dedup.sort_suffixes(places, suffix_dedup.CoverRanks(data, 50))
    strings = [data[p:p + 50].tobytes() for p in order]
    assert strings == sorted(strings)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row: list[int], i: int, x: str, b: str) -> list[int]:
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return new


def test_levenshtein_automaton():
    terms = {"loser": 1.0, "scum": 2.0, "disgusting": 3.0, "clown": 4.0}
    lexicon = toxicity.Lexicon(terms, {"lowei": 5.0, "loweix": 6.0})
    rng = np.random.default_rng(5)
    tried = [*terms, "lowei", "loweifoo", "loweixa", "lowe", "x", ""]
    for term in [*terms, *terms]:
        for _ in range(60):
            word = list(term)
            for _ in range(rng.integers(1, 4)):
                k = int(rng.integers(0, len(word) + 1))
                word[k:k + int(rng.integers(0, 2))] = list("abs"[: int(rng.integers(0, 2))])
            tried.append("".join(word))
    for word in tried:
        close = {t for t in terms if edit_distance(word, t) <= toxicity.edits_allowed(t)}
        kind, weight = lexicon.match(word)
        if word in terms:
            assert (kind, weight) == (1, terms[word])
        elif word.startswith("lowei"):
            assert (kind, weight) == (1, 6.0 if word.startswith("loweix") else 5.0)
        else:
            assert (kind, weight) == ((2, max(terms[t] for t in close)) if close else (0, 0.0)), word


def test_toxicity(spark, awkward, empty):
    rng = np.random.default_rng(8)
    clean = [" ".join(f"plain{rng.integers(400)}" for _ in range(50)) + " you" for _ in range(400)]  # short words can be terms too
    toxic = [t + " moron " + clean[-k] for k, t in enumerate(clean[:120])]
    texts = [*clean, *toxic]
    frame = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k >= len(clean))) for k in range(len(texts))] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.learn(frame, labels)
    assert set(model.words) == {"moron"}
    asked = {0: "a moron here", 1: "a morron here", 2: 'they said "moron" here', 3: "", 4: None, 5: "nice plain words"}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(asked.items()), "doc_id long, text string"), model).collect()}
    assert scores[0] >= 0.5 > scores[5] and scores[1] > scores[5] and scores[2] < scores[0] and scores[3] == scores[4] == scores[5]
    assert toxicity.score(awkward, model).count() == awkward.count() and toxicity.score(empty, model).count() == 0
    none = toxicity.learn(frame, labels.where("false"))
    assert max(r["score"] for r in toxicity.score(awkward, none).collect()) < 0.01


def test_words_with_inflected_forms_keep_their_errors(spark):
    rng = np.random.default_rng(8)
    clean = [" ".join(f"plain{rng.integers(400)}" for _ in range(50)) for _ in range(400)]
    toxic = [t + (" idiot " if k % 5 < 3 else " idiots ") + clean[-k] for k, t in enumerate(clean[:100])]
    texts = [*clean, *toxic]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= len(clean))) for k in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.learn(frame, labels)
    assert set(model.words) == {"idiot", "idiots"} and "idiot" in model.stems
    lexicon = toxicity.Lexicon(model.words, model.stems)
    assert [lexicon.match(w)[0] for w in ("idiot", "idiots", "idioten", "idoot", "odiot", "plain7")] == [1, 1, 1, 2, 2, 0]
    asked = spark.createDataFrame([(0, "you odiot there"), (1, "you plain there")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(asked, model).collect()}
    assert scores[0] > scores[1]


def brute_windows(text, items) -> tuple:
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(common.UPPER, common.LOWER)))
    own, hit, listed = fold(text), set(), set()
    for item, words_ in ((i, fold(t)) for i, t in items):
        size = min(10, len(words_))
        for k in range(len(words_) - size + 1 if size else 0):
            for p in range(len(own) - size + 1):
                if own[p:p + size] == words_[k:k + size]:
                    hit.update(range(p, p + size))
                    listed.add(item)
    return len(own), sorted(hit), sorted(map(str, listed - {None}))


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, awkward, empty, block_bytes, monkeypatch):
    monkeypatch.setattr(decontamination.annotate, "__defaults__", (block_bytes,))
    items = [(1, PROSE[1][20:140]), (2, "ONE, two!"), (3, None), (4, ""), (None, PROSE[2][:90]), (5, PROSE[1][20:140]), (10, PROSE[4] + " " + PROSE[0]), (11, "ab ab ab ab ab ab ab ab ab ab ab")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.annotate(awkward, benchmark)
    for r in got.collect():
        assert (r["_llm_words"], r["_llm_hits"], r["_llm_items"]) == brute_windows(r["text"], items)
    kept = decontamination.keep_clean(awkward, benchmark)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(not brute_windows(r["text"], items)[1] for r in awkward.collect())
    assert decontamination.annotate(empty, benchmark).count() == 0
    assert decontamination.keep_clean(awkward, benchmark.where("false")).count() == awkward.count()


def brute_fingerprint(text: str | None) -> int:
    import xxhash

    own = words((text or "").translate(str.maketrans(common.UPPER, common.LOWER)))
    hashes = [xxhash.xxh64_intdigest(" ".join(own[k:k + 4]), 42) for k in range(max(1, len(own) - 3))] if own else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs: list[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i, _ in pairs}
    changed = True
    while changed:
        changed = False
        for i, f in pairs:
            for j, g in pairs:
                if bin(f ^ g).count("1") <= 4 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_simhash(which, request):
    frame = request.getfixturevalue(which)
    got = simhash.grouped(frame).collect()
    assert len(got) == frame.count()
    pairs = [(r["doc_id"], brute_fingerprint(r["text"])) for r in frame.collect()]
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got) == Counter(pairs)
    root = brute_components([p for p in pairs if p[0] is not None])
    assert all(r["component_id"] == root[r["doc_id"]] for r in got if r["doc_id"] is not None)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))


def test_each_group_keeps_a_document(spark):
    rows_ = [(None, PROSE[0], "a"), (None, PROSE[0], "a"), (None, PROSE[1], "a"), (None, None, "a"), (7, PROSE[2], "a"), (7, PROSE[3], "a"),
             (None, PROSE[4], "a"), (9, PROSE[4], "a"), (4, PROSE[5], "b"), (4, PROSE[5], "a"), (3, PROSE[6], "a"), (7, PROSE[6], "a")]
    frame = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    runs = [sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.keep_one(f).collect()) for f in (frame, frame.repartition(5).orderBy(F.desc("source")))]
    assert runs[0] == runs[1] == sorted([(0, PROSE[0]), (0, PROSE[1]), (0, ""), (7, PROSE[2]), (7, PROSE[3]), (9, PROSE[4]), (4, PROSE[5]), (3, PROSE[6])])
    sources = [{r["source"] for r in simhash.keep_one(f).where("doc_id = 4").collect()} for f in (frame, frame.orderBy("source"), frame.orderBy(F.desc("source")))]
    assert sources[0] == sources[1] == sources[2]


@pytest.mark.parametrize("large", [2048, 8])
def test_links_of_close_fingerprints(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_GROUP", large)
    rng = np.random.default_rng(9)
    fps = list({int(x) for x in rng.integers(0, 1 << 63, 40)})
    for f in fps[:25]:
        for n in (1, 2, 3, 4, 5):
            fps.append(f ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    fps = list(dict.fromkeys(fps))
    keys = np.zeros(len(fps), np.uint64)
    a, b = simhash.bucket_links(np.array(fps, np.uint64), keys, 4)
    assert len(a) < len(fps)
    root = brute_components(list(enumerate(fps)))
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), k) for k, f in enumerate(fps)], "fp long, first long")
    joined = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, per_bucket=30)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    groups = defaultdict(set)
    for k, s in enumerate(signed):
        groups[joined.get(s, s)].add(k)
    assert {frozenset(g) for g in groups.values()} == {frozenset(k for k in root if root[k] == r) for r in root.values()}


def test_hash_of_the_contract():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == simhash.fingerprint("one\ttwo")
