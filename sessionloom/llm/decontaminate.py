"""Benchmark decontamination with an FM-index of each shard of the training text.

A shard is a run of words of consecutive documents. Words of the benchmark get a number each; a
run of other words, and the border of two documents, is one filler symbol, which no phrase holds.
The index is the Burrows-Wheeler transform of the numbers in a wavelet matrix, with every
SAMPLE-th suffix position kept. All phrases are searched backward at once, their occurrences
located by walking to the next kept position, and the hit words merged to spans.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Batches, keyed, map_batches, named, raw, shown_id

WINDOW = 10
#: Words of a shard; bounds the memory of an index.
SHARD_WORDS = 1 << 20
#: Bytes of benchmark text that one pass over the documents searches; more make more passes.
BLOCK_BYTES = 8 << 20
SAMPLE = 16
ROWS_AT_ONCE = 1 << 19

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then runs of digits, a-z and whatever isn't ASCII."""
    return text.translate(_KEEP).split()


def suffix_array(symbols: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, and each position's place in it.

    Prefix doubling that goes on with tied groups only. The last symbol must be 0 and unique.
    """
    n, at_once = len(symbols), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(at_once):
        key <<= bits
        if j < n:
            key[: n - j] |= symbols[j:]
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    depth = at_once
    while len(slots):
        own = order[slots]
        ahead = own + depth
        second = np.where(ahead < n, place[np.minimum(ahead, n - 1)] + 1, 0)
        key = place[own] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[slots] = own
        new = np.concatenate(([True], key[1:] != key[:-1]))
        place[own] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    return order, place


class Bits:
    """A bitmap with a count of ones before each block of 64."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        self.words = np.zeros(len(flags) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below).astype(np.int64)


class WaveletMatrix:
    """A sequence of numbers below 2**bits with access and rank, a bitmap for each binary digit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels, self.bits = [], bits
        counts = np.arange(1 << bits, dtype=np.int64)
        start = np.zeros(1 << bits, np.int64)
        for shift in range(bits - 1, -1, -1):
            flags = (values >> shift) & 1 != 0
            level, zeros = Bits(flags), int(len(flags) - flags.sum())
            self.levels.append((shift, level, zeros))
            ones = level.ones(start)
            start = np.where((counts >> shift) & 1, zeros + ones, start - ones)
            values = np.concatenate((values[~flags], values[flags]))
        self.start = start

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i."""
        for shift, level, zeros in self.levels:
            ones = level.ones(i)
            i = np.where((symbols >> shift) & 1, zeros + ones, i - ones)
        return i - self.start[symbols]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and how often each is before its place."""
        symbols = np.zeros(len(i), np.int64)
        for shift, level, zeros in self.levels:
            one, ones = level.get(i), level.ones(i)
            symbols |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return symbols, i - self.start[symbols]


class FMIndex:
    """Finds phrases in a sequence of symbols from 1 on."""

    def __init__(self, symbols: np.ndarray, bits: int, sample: int = SAMPLE):
        symbols = np.append(symbols, 0).astype(np.int64)
        order, _ = suffix_array(symbols, bits)
        self.n, self.sample = len(symbols), sample
        self.less = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=1 << bits))[:-1]))
        self.last = WaveletMatrix(symbols[order - 1], bits)
        kept = order % sample == 0
        self.kept, self.positions = Bits(kept), order[kept].astype(np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases are padded with 0 in front."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for column in phrases.T[::-1]:
            on = np.flatnonzero((column > 0) & (low < high))
            symbols = column[on]
            low[on] = self.less[symbols] + self.last.rank(symbols, low[on])
            high[on] = self.less[symbols] + self.last.rank(symbols, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin."""
        found, steps = np.empty(len(rows), np.int64), 0
        left, at = np.arange(len(rows)), rows
        while len(left):
            done = self.kept.get(at)
            found[left[done]] = self.positions[self.kept.ones(at[done])] + steps
            left, at = left[~done], at[~done]
            symbols, before = self.last.access(at)
            at, steps = self.less[symbols] + before, steps + 1
        return found


class Phrases:
    """The benchmark's windows as numbers, and which items have them."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners = defaultdict(set)
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[i : i + window])].add(item)
        self.phrases = np.zeros((len(owners), window), np.int64)
        for row, phrase in zip(self.phrases, owners):
            row[window - len(phrase) :] = phrase
        self.lengths = np.array([len(x) for x in owners], np.int64)
        self.owners = [sorted(x - {None}) for x in owners.values()]
        self.bits = max(2, (len(self.vocabulary) + 1).bit_length())
        self.window = window


def find(ids: np.ndarray, phrases: Phrases, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Start of every occurrence in a shard's words (1: another word or a border) and its phrase."""
    held = (ids != 1) | (np.concatenate(([0], ids[:-1])) != 1)
    places = np.flatnonzero(held)
    if not len(places) or not len(phrases.phrases):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    index = FMIndex(ids[places], phrases.bits, sample)
    low, high = index.search(phrases.phrases)
    counts = np.maximum(high - low, 0)
    ends = np.cumsum(counts)
    starts, which = [], []
    for at in range(0, int(ends[-1]), ROWS_AT_ONCE):  # a common phrase has many rows
        n = np.arange(at, min(at + ROWS_AT_ONCE, int(ends[-1])))
        phrase = np.searchsorted(ends, n, side="right")
        rows = low[phrase] + n - (ends[phrase] - counts[phrase])
        starts.append(places[index.locate(rows)])
        which.append(phrase)
    return (np.concatenate(starts), np.concatenate(which)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _span_rows(text: bytes, hit: np.ndarray) -> list[dict]:
    """Merged spans of hit words: word numbers, and code points of the text."""
    bounds = [m.span() for m in _WORD.finditer(text)]
    rows, chars, at = [], 0, 0
    for first, end in _runs(hit):
        begin, stop = bounds[first][0], bounds[end - 1][1]
        chars += len(text[at:begin].decode("utf-8", "replace"))
        length = len(text[begin:stop].decode("utf-8", "replace"))
        rows.append({"first_word": first, "end_word": end, "begin": chars, "end": chars + length})
        chars, at = chars + length, stop
    return rows


_SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))
SPANS = "array<struct<first_word:int,end_word:int,begin:int,end:int>>"


def _search(phrases: Phrases, shard_words: int):
    numbers = defaultdict(lambda: 1)

    class Numbers(dict):
        def __missing__(self, word):
            return 1

    def shard(texts: list[bytes], ids: list[np.ndarray], keys: list) -> pa.RecordBatch:
        starts = np.cumsum([0] + [len(x) + 1 for x in ids])
        whole = np.concatenate([y for x in ids for y in (x, np.ones(1, np.int32))])
        change = np.zeros(len(whole) + 1, np.int32)
        pairs = []
        for at in range(0, len(whole), shard_words):  # a very long document is cut, with an overlap
            where, phrase = find(whole[at : at + shard_words + phrases.window - 1], phrases)
            where = where + at
            np.add.at(change, where, 1)
            np.add.at(change, where + phrases.lengths[phrase], -1)
            doc = np.searchsorted(starts, where, side="right") - 1
            pairs.append(np.unique(doc * max(1, len(phrases.lengths)) + phrase))
        hit = np.cumsum(change[:-1]) > 0
        items = defaultdict(set)
        for pair in np.unique(np.concatenate(pairs)).tolist():
            items[pair // len(phrases.lengths)].update(phrases.owners[pair % len(phrases.lengths)])
        spans = [_span_rows(t, hit[a : a + len(x)]) if hit[a : a + len(x)].any() else [] for t, x, a in zip(texts, ids, starts)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([sorted(items[i]) if i in items else [] for i in range(len(ids))], pa.list_(pa.int64())),
                pa.array(spans, _SPANS),
            ],
            ["doc_id", "n_words", "item_ids", "spans"],
        )

    def run(batches: Batches) -> Batches:
        numbers = Numbers(phrases.vocabulary)
        texts, ids, keys, total = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
                words = words_of(text)
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                texts.append(text)
                keys.append(key)
                total += len(words)
                if total >= shard_words or sum(map(len, texts[-1:])) > 64 << 20:
                    yield shard(texts, ids, keys)
                    texts, ids, keys, total = [], [], [], 0
        if ids:
            yield shard(texts, ids, keys)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans) for every document.

    docs is (doc_id, text), a document for each different row (see in_order); benchmark (item_id, text).
    A phrase is a run of window words of an item, or all its words if it has fewer. A word inside an
    occurrence of a phrase is hit. item_ids are the items with such phrases, spans the runs of hit
    words (word numbers and code points, end excluded). NULL, empty and word-less texts have no
    words, an item of that kind no phrase; an item without an id hits words and isn't listed.
    An empty benchmark hits nothing. The benchmark is searched in blocks of a fixed size.
    """
    own, names = keyed(docs)
    return named(_contamination(own, benchmark, window, shard_words, block_bytes), names)


def _contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """contamination of keyed documents."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    block = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        own = [(r.item_id, r.text.encode()) for r in block.where(F.col("block") == b).select("item_id", "text").collect()]
        found.append(map_batches(docs, _search(Phrases(own, window), shard_words), f"doc_id long, n_words long, item_ids array<long>, spans {SPANS}"))
    if blocks == 1:
        merged = found[0]
    else:
        gathered = reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(
            F.max("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        )
        merged = gathered.withColumn("spans", F.expr(_MERGE))
    return merged.select("doc_id", "n_words", _n_hit().alias("n_hit"), "item_ids", "spans")


_MERGE = """aggregate(spans, cast(array() as array<struct<first_word:int,end_word:int,begin:int,end:int>>), (done, s) ->
  if(size(done) > 0 and element_at(done, -1).end_word >= s.first_word,
     concat(slice(done, 1, size(done) - 1), array(named_struct(
       'first_word', element_at(done, -1).first_word, 'end_word', greatest(element_at(done, -1).end_word, s.end_word),
       'begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, s.end)))),
     concat(done, array(s))))"""


def _n_hit():
    return F.expr("cast(aggregate(spans, 0, (n, s) -> n + s.end_word - s.first_word) as long)")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination as counts and a digest of the items' ids."""
    ids = F.array_sort(F.col("item_ids").cast("array<string>"))
    return contamination(docs, benchmark).select(
        shown_id(),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _without(batches: Batches) -> Batches:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            for s in reversed(spans or []):
                text = text[: s["begin"]] + text[s["end"] :]
            texts.append(text)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.string()))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text) with every span of benchmark words cut out of the texts; no document goes.

    doc_id is NULL_ID where it is NULL.
    """
    own, names = keyed(docs)
    hits = _contamination(own, benchmark).where("n_hit > 0").select("doc_id", "spans")
    joined = own.join(hits, "doc_id", "left")
    return named(map_batches(joined, _without, f"doc_id long, text string, spans {SPANS}").select("doc_id", "text"), names)
