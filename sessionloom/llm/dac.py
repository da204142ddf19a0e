"""Token files in directly addressable codes (DAC).

The numbers are split into chunks of 8 bits, lowest first. Level 1 holds the first chunk of every
number, level 2 the second chunk of those that have one, and so on; a bitmap per level says which
numbers go on, and a directory of ranks (ones before each block of 512 bits) leads from a number's
place in a level to its place in the next. So any token is read from a few places of a segment,
without decoding a block.

A segment is the tokens of consecutive documents:

    magic "DAC1", n_docs, n_tokens, n_levels (little-endian unsigned 64-bit each)
    doc_id of each document (signed 64-bit), end of each document in the segment (unsigned 64-bit)
    per level: n, then n bytes of chunks, then the bitmap's 64-bit words, then the directory (unsigned 64-bit each)

Every part is padded to 8 bytes. Segments are rows of a Parquet table (part, segment, data), so
that any store that Spark reaches can hold them; parts ascend by doc_id, as do segments in a part.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionloom.llm.common import Batches, in_order, map_batches, shown_id, slices

#: Tokens of a segment, about; a document is never split between segments.
SEGMENT_TOKENS = 1 << 20
BATCH_BYTES = 8 << 20
#: Tokens read at a time.
READ_TOKENS = 1 << 18
#: Encoded stretches, and matches, that a worker remembers, up to twice as many of either.
REMEMBERED = 350_000
_BLOCK = 512
_MAGIC = b"DAC1\0\0\0\0"


# Fixed value: the pattern that byte-level pre-tokenizers of this kind split text by.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_RUN = re.compile(r"\s ")


def _shown_bytes() -> list[str]:
    """Byte-level BPE writes printable bytes of Latin-1 as themselves, the others as letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


_SHOWN = "".join(_shown_bytes())
_SPACE = _SHOWN[32]

# Tokens of a text.


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker. Its texts must be split as here: by bytes, without changing them before."""
    made = Tokenizer.from_file(path)
    said = json.loads(made.to_str())
    split = said["pre_tokenizer"] or {}
    if said["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path}: not a byte-level tokenizer that leaves texts as they are")
    return made


class Remembered(dict):
    """What make gives for a key, kept for as long as REMEMBERED other keys come in between, at least."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key) if self.older else None
        if value is None:
            value = self.make(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Tokens of texts; stretches that came before are looked up.

    Every match of the byte-level pattern is encoded by itself, by the library's model. No match
    holds a space after anything but white space, so a text may be cut before each such space, and
    a new stretch into its matches. Texts that hold an added token of the file (such as the one
    that ends a text) are the library's to encode.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.model = self.library.model
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.matches = Remembered(self._match)
        self.first = Remembered(self._stretch)
        #: By the stretch without the space that it begins with.
        self.spaced = Remembered(self._spaced)

    def _match(self, text: str) -> bytes:
        if text.isascii() and text[1:].isalpha() and text[0] == " ":
            shown = _SPACE + text[1:]
        else:
            shown = codecs.charmap_decode(text.encode(), "strict", _SHOWN)[0]
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _stretch(self, text: str) -> bytes:
        found = _PATTERN.findall(text)
        if found and found[0][0] == " " and found[0][1:].isalpha():  # shared with the stretches of letters only
            return self.spaced[found[0][1:]] + b"".join(map(self.matches.__getitem__, found[1:]))
        return b"".join(map(self.matches.__getitem__, found))

    def _spaced(self, rest: str) -> bytes:
        if rest.isalpha():  # letters only are one match
            return self._match(" " + rest)
        if rest[-1:] in (".", ",") and rest[:-1].isalpha():
            return self.spaced[rest[:-1]] + self.matches[rest[-1]]
        return self._stretch(" " + rest)

    def __call__(self, text: str) -> bytes:
        """Its ids as little-endian unsigned 32-bit integers."""
        if self.added and self.added.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        parts = text.split(" ")
        if text[:1] == " " or _RUN.search(text):  # spaces after white space stay with what follows
            joined, open_end = [parts[0]], not parts[0] or parts[0][-1].isspace()
            for x in parts[1:]:
                if open_end:
                    joined[-1] += " " + x
                else:
                    joined.append(x)
                open_end = not x or x[-1].isspace()
            parts = joined
        return self.first[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:]))


    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Those that split at every space are split by Arrow, and each different stretch is looked up once."""
        plain = [i for i, x in enumerate(texts) if x[:1] != " " and not _RUN.search(x) and not (self.added and self.added.search(x))]
        alone = set(range(len(texts))).difference(plain)
        out = [np.frombuffer(self(x), "<u4") if i in alone else None for i, x in enumerate(texts)]
        if not plain:
            return out
        parts = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        # Letters only are remembered, other stretches are put together from them once for all these texts.
        known = [self.spaced[x] if x.isalpha() else self._spaced(x) for x in coded.dictionary.to_pylist()]
        first = coded.dictionary.take(coded.indices.take(pa.array(bounds[:-1]))).to_pylist()  # no space before it
        which[bounds[:-1]] = len(known) + np.arange(len(plain))
        known += map(self.first.__getitem__, first)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = np.frombuffer(b"".join(known), "<u4")
        begins = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        flat = ids[np.repeat(begins[which] - ends + n, n) + np.arange(ends[-1])]
        stops = ends[bounds[1:] - 1].tolist()
        for i, a, b in zip(plain, [0, *stops], stops):
            out[i] = flat[a:b]
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker, with what it remembers."""
    return Encoder(path)


# Codes.


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


class Level:
    """Chunks of one level with the bitmap of those that go on."""

    def __init__(self, chunks: np.ndarray, words: np.ndarray, before: np.ndarray):
        self.chunks, self.words, self.before = chunks, words, before

    @classmethod
    def of(cls, chunks: np.ndarray, more: np.ndarray) -> Level:
        packed = np.packbits(more, bitorder="little")
        words = np.zeros(-(-(len(more) + 1) // _BLOCK) * _BLOCK // 64, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(words).reshape(-1, _BLOCK // 64).sum(axis=1, dtype="<u8")
        return cls(chunks, words, np.concatenate((np.zeros(1, "<u8"), np.cumsum(ones)[:-1])).astype("<u8"))

    def more(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i: the directory's count and those of the words since."""
        block = i // _BLOCK
        out = self.before[block].astype(np.int64)
        first, word = block * (_BLOCK // 64), i >> 6
        for k in range(_BLOCK // 64 - 1):
            at = first + k
            out += np.where(at < word, np.bitwise_count(self.words[np.minimum(at, len(self.words) - 1)]), 0)
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.words[word] & below)


def encode_segment(doc_ids: list[int], documents: list[np.ndarray]) -> bytes:
    ends = np.cumsum([len(x) for x in documents], dtype="<u8")
    left = np.concatenate(documents).astype(np.uint64) if documents else np.empty(0, np.uint64)
    levels = []
    while not levels or len(left):
        more = left > 255
        levels.append(Level.of((left & np.uint64(255)).astype(np.uint8), more))
        left = left[more] >> np.uint64(8)
    out = [_MAGIC, struct.pack("<QQQ", len(doc_ids), int(ends[-1]) if len(ends) else 0, len(levels)), np.array(doc_ids, "<i8").tobytes(), ends.tobytes()]
    for x in levels:
        out += [struct.pack("<Q", len(x.chunks)), _padded(x.chunks.tobytes()), x.words.tobytes(), x.before.tobytes()]
    return b"".join(out)


class Segment:
    """Reads a segment; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC:
            raise ValueError("not a segment")
        n_docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.ends = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-(n + 1) // _BLOCK)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n + -n % 8
            words = np.frombuffer(data, "<u8", blocks * _BLOCK // 64, at)
            at += 8 * len(words)
            self.levels.append(Level(chunks, words, np.frombuffer(data, "<u8", blocks, at)))
            at += 8 * blocks

    def access(self, i: np.ndarray) -> np.ndarray:
        """The tokens at places i of the segment, in any order."""
        i = np.asarray(i, np.int64)
        out = np.zeros(len(i), np.uint64)
        on = np.arange(len(i))
        for depth, level in enumerate(self.levels):
            out[on] |= level.chunks[i].astype(np.uint64) << np.uint64(8 * depth)
            more = level.more(i)
            on, i = on[more], level.rank(i[more])
            if not len(on):
                break
        return out

    def range(self, a: int, b: int) -> np.ndarray:
        """The tokens at a up to b: in each level they are neighbours, so two ranks lead on."""
        out, on = np.zeros(b - a, np.uint32), None
        for depth, level in enumerate(self.levels):
            chunks = level.chunks[a:b].astype(np.uint32) << np.uint32(8 * depth)
            if on is None:
                out, on = chunks, np.arange(b - a)
            else:
                out[on] |= chunks
            if b <= a:
                break
            flags = np.unpackbits(level.words[a >> 6 : (b >> 6) + 1].view(np.uint8), bitorder="little")[a & 63 :][: b - a]
            on = on[flags.astype(bool)]
            a, b = (int(x) for x in level.rank(np.array([a, b])))
        return out

    def document(self, k: int, at_once: int = 1 << 18):
        """The tokens of the k-th document, in parts."""
        start = int(self.ends[k - 1]) if k else 0
        for a in range(start, int(self.ends[k]), at_once):
            yield self.range(a, min(a + at_once, int(self.ends[k])))


# Files.


def _write(path: str, end: int, segment_tokens: int):
    def run(batches: Batches) -> Batches:
        """Texts of one part in the order of doc_id to segments."""
        encode = encoder(path).many
        ids: list[int] = []
        held: list[np.ndarray] = []
        total = segment = 0
        part = None

        def close() -> pa.RecordBatch:
            arrays = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([total], pa.int64()), pa.array([encode_segment(ids, held)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["part", "segment", "n_tokens", "data"])

        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                part = batch.column("part")[0].as_py()
                for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                    ids.append(doc_id)
                    held.append(np.append(tokens, np.uint32(end)))
                    total += len(held[-1])
                    if total >= segment_tokens:
                        yield close()
                        ids, held, total, segment = [], [], 0, segment + 1
        if ids:
            yield close()

    return run


def write(docs: DataFrame, folder: str, tokenizer_path: str, end: int, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Writes the tokens of docs (doc_id, text) to folder, ascending by doc_id and text.

    Rows that repeat a doc_id with another text are all written (see in_order), NULL ids first; an empty or NULL text
    has its end token only. No rows write an empty table.
    """
    ordered = in_order(docs).withColumn("part", F.spark_partition_id())
    segments = map_batches(ordered, _write(tokenizer_path, end, segment_tokens), "part int, segment int, n_tokens long, data binary")
    segments.write.mode("overwrite").option("compression", "none").parquet(folder)


def _crcs(segment: Segment) -> list[int]:
    """crc32 of every document's tokens; documents that follow each other are read at once."""
    out, a, first = [], 0, 0
    ends = segment.ends.tolist()
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(segment.ends, a + READ_TOKENS, "right")))
        if ends[first] - a > READ_TOKENS:
            crc = 0
            for tokens in segment.document(first):
                crc = zlib.crc32(tokens.astype("<u4").tobytes(), crc)
            out.append(crc)
            last = first + 1
        else:
            data = memoryview(segment.range(a, ends[last - 1]).astype("<u4").tobytes())
            begins = [a, *ends[first : last - 1]]
            out += [zlib.crc32(data[4 * (x - a) : 4 * (y - a)]) for x, y in zip(begins, ends[first:last])]
        a, first = ends[last - 1], last
    return out


def _read(batches: Batches) -> Batches:
    for batch in batches:
        for part, number, data in zip(batch.column("part").to_pylist(), batch.column("segment").to_pylist(), batch.column("data")):
            segment = Segment(data.as_buffer())
            ends = segment.ends
            begins = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
            crcs = _crcs(segment)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ends), part), pa.int32()),
                    pa.array(np.full(len(ends), number), pa.int32()),
                    pa.array(segment.doc_ids.astype(np.int64)),
                    pa.array(begins),
                    pa.array(ends - begins),
                    pa.array(crcs, pa.int64()),
                ],
                ["part", "segment", "doc_id", "begin", "n_tokens", "ids_crc32"],
            )


def segment_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, segment, start): the tokens of all segments before; the data are not read.

    Parts are as many as the sort had partitions; only their sums meet in one small window.
    """
    sizes = spark.read.parquet(folder).select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = sizes.withColumn(
        "inside", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    return inside.join(before, "part").select("part", "segment", (F.col("base") + F.col("inside")).alias("start"))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    schema = "part int, segment int, doc_id long, begin long, n_tokens long, ids_crc32 long"
    found = map_batches(spark.read.parquet(folder).select("part", "segment", "data"), _read, schema)
    placed = found.join(segment_starts(spark, folder), ["part", "segment"])
    return placed.select(shown_id(), (F.col("start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
