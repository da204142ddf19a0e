"""Exact substring deduplication: bytes of any passage of LENGTH bytes that also starts earlier go.

Passages are dealt out to tasks by anchors: of the hashes of the K-byte strings in a window of
LENGTH bytes, the smallest (the first of equals) names the window. Equal windows have equal
anchors, and neighbouring windows mostly share one, so what is shuffled is a short row for each
anchor, with a digest of the stretch of text that its windows cover. Equal stretches are settled by
their digests. Stretches that share an anchor but differ are compared as text: blocks of them go
through a column-wise construction of the Burrows-Wheeler transform of the collection (Bauer, Cox
and Rosone): every round inserts one symbol of each string, from the right, and updates the transform
and the common prefixes (Cox et al.), which lie in files that a round reads and writes in
sequence. Rows with a common prefix of LENGTH bytes are equal windows; the first of them stays.
Where very many different stretches share an anchor, each of their windows goes by its own 128-bit
digest instead, so no task holds a group whose size grows with the table.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Batches, cut, keyed, map_batches, named, shown_id, slices

LENGTH = 100
#: Bytes of an anchor.
K = 24
#: Text that is searched for anchors at once; longer texts are searched in pieces that overlap.
PIECE_BYTES = 4 << 20
#: Strings of a block whose transform is built together.
BLOCK_STRINGS = 8192
#: Stretches under one anchor from which its windows are settled by digests of their own.
HOT = 20_000
#: Windows of hot anchors that a task holds at once.
WINDOWS = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 23) - 1)


# Anchors.


def _hashes(data: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string, by doubling the strings' length."""
    table = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(data) - k + 1
    width, powers, whole, done = 1, table[data], None, 0
    base = np.uint64(0xD6E8FEB86659FD93)
    factor = int(base)
    while True:
        if k & width:
            if whole is None:
                whole, done = powers, width
            else:
                size = len(data) - done - width + 1
                whole = whole[:size] * np.uint64(pow(int(base), width, 2**64)) + powers[done : done + size]
                done += width
        if width * 2 > k:
            break
        size = len(powers) - width
        powers = powers[:size] * np.uint64(factor) + powers[width:]
        factor, width = factor * factor % 2**64, width * 2
    out = whole[:n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every width neighbours."""
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - size :][: len(values) - width + 1]) if size < width else out


def anchors(data: np.ndarray, length: int = LENGTH, k: int = K, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each window of length bytes, the hash and the place of its anchor."""
    hashes = _hashes(data, k, seed)
    marked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    places = (_least(marked, length - k + 1) & _PLACE).astype(np.int64)
    return hashes[places], places


def _runs(buffer: bytes, bounds: np.ndarray, length: int, k: int, seed: int = 1) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts that lie end to end: text number, first and end window, hash."""
    data = np.frombuffer(buffer, np.uint8)
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.int64),)
    hashes, places = anchors(data, length, k, seed)
    starts = np.arange(len(places))
    text = np.searchsorted(bounds, starts, side="right") - 1
    inside = starts + length <= bounds[text + 1]
    starts, places, hashes, text = starts[inside], places[inside], hashes[inside], text[inside]
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    new = np.concatenate(([True], (places[1:] != places[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    ends = np.concatenate((starts[first[1:] - 1], starts[-1:])) + 1
    return text[first], starts[first], ends, hashes[first].view(np.int64)


def _first_of_equals(anchor: np.ndarray, digests: np.ndarray, doc: np.ndarray, begin: np.ndarray, stop: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
    """Rows of _ANCHOR_ROWS: the first of equal (anchor, digest), and the others' bytes with a NULL digest.

    text numbers the texts; a text's rows stand together in the order of their bytes.
    """
    order = np.lexsort((begin, doc, digests, anchor))
    same = np.zeros(len(order), bool)
    same[1:] = (anchor[order][1:] == anchor[order][:-1]) & (digests[order][1:] == digests[order][:-1])
    known = np.zeros(len(order), bool)
    known[order] = same
    keep = ~known
    # Neighbouring stretches that are known to be repeated are one.
    where = np.flatnonzero(known)
    joined = np.zeros(len(where), bool)
    joined[1:] = (text[where][1:] == text[where][:-1]) & (begin[where][1:] <= stop[where][:-1])
    heads = np.flatnonzero(~joined)
    span_stop = stop[where][np.concatenate((heads[1:] - 1, [len(where) - 1]))] if len(where) else np.empty(0, np.int64)
    span_at = where[heads]
    spread = xxhash.xxh3_64_intdigest
    keys = np.fromiter((spread(int(d).to_bytes(8, "little", signed=True)) for d in doc[span_at]), np.uint64, len(span_at)).view(np.int64)
    null = pa.array([None] * len(span_at), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((anchor[keep], keys))),
            pa.concat_arrays([pa.array(digests[keep]), null]),
            pa.array(np.concatenate((doc[keep], doc[span_at]))),
            pa.array(np.concatenate((begin[keep], begin[span_at])).astype(np.int32)),
            pa.array(np.concatenate((stop[keep], span_stop)).astype(np.int32)),
        ],
        ["anchor", "digest", "doc_id", "begin", "stop"],
    )


def _anchor_rows(length: int, k: int):
    """Documents to (anchor, digest, doc_id, begin, stop): bytes begin to stop hold the anchor's windows.

    Of equal stretches in one piece of work only the first goes on; the others are known to be
    repeated and come with a NULL digest, so a passage in many documents is a row per piece.
    """

    def rows(ids: np.ndarray, texts: list[bytes], offsets: np.ndarray) -> pa.RecordBatch:
        buffer = b"".join(texts)
        bounds = np.cumsum([0, *map(len, texts)])
        text, first, end, anchor = _runs(buffer, bounds, length, k)
        stop = end + length - 1
        view, digest = memoryview(buffer), xxhash.xxh3_64_intdigest
        digests = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), stop.tolist())), np.uint64, len(first)).view(np.int64)
        doc = ids[text]
        begin, stop = first - bounds[text] + offsets[text], stop - bounds[text] + offsets[text]
        return _first_of_equals(anchor, digests, doc, begin, stop, text)

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for batch in slices(whole, "text", PIECE_BYTES // 2):
                ids, texts, offsets, total = [], [], [], 0
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
                    for at in range(0, max(1, len(text) - length + 1), PIECE_BYTES):
                        part = text[at : at + PIECE_BYTES + length - 1]
                        if total and total + len(part) > 2 * PIECE_BYTES - 1:
                            yield rows(np.array(ids, np.int64), texts, np.array(offsets, np.int64))
                            ids, texts, offsets, total = [], [], [], 0
                        ids.append(doc_id)
                        texts.append(part)
                        offsets.append(at)
                        total += len(part)
                yield rows(np.array(ids, np.int64), texts, np.array(offsets, np.int64))

    return run


_ANCHOR_ROWS = "anchor long, digest long, doc_id long, begin int, stop int"


def _settle(batches: Batches) -> Batches:
    """Rows sorted by anchor, digest, doc_id, begin: repeated stretches, and those to compare.

    Out comes (anchor, doc_id, begin, stop): with a NULL anchor bytes to remove, else the first
    of equal stretches whose anchor has other stretches, too. A batch at a time is held.
    """
    last = None  # the first row of the newest stretch: (anchor, digest, doc_id, begin, stop, was it sent?)

    def batch_of(anchor, doc, begin, stop, mask=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64(), mask=mask), pa.array(doc, pa.int64()), pa.array(begin, pa.int32()), pa.array(stop, pa.int32())], ["anchor", "doc_id", "begin", "stop"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        plain = np.asarray(batch.column("digest").is_null())
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "doc_id", "begin", "stop")]
        digest = batch.column("digest").fill_null(0).to_numpy(zero_copy_only=False)
        if plain.any():
            anchor, doc, begin, stop = (x[plain] for x in columns)
            yield batch_of(anchor, doc, begin, stop, np.ones(len(doc), bool))
        anchor, doc, begin, stop = (x[~plain] for x in columns)
        digest = digest[~plain]
        if not len(anchor):
            continue
        before = (last[0], last[1]) if last else (None, None)
        same = np.empty(len(anchor), bool)
        same[0] = (anchor[0], digest[0]) == before
        same[1:] = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])
        if same.any():
            yield batch_of(anchor[same], doc[same], begin[same], stop[same], np.ones(int(same.sum()), bool))
        heads = np.flatnonzero(~same)
        if not len(heads):
            continue
        own = anchor[heads]
        with_before = np.empty(len(heads), bool)
        with_before[0] = last is not None and own[0] == last[0]
        with_before[1:] = own[1:] == own[:-1]
        if with_before[0] and not last[5]:
            yield batch_of([last[0]], [last[2]], [last[3]], [last[4]])
        send = with_before.copy()
        send[:-1] |= with_before[1:]
        at = heads[send]
        if len(at):
            yield batch_of(anchor[at], doc[at], begin[at], stop[at])
        h = heads[-1]
        last = (anchor[h], digest[h], doc[h], begin[h], stop[h], bool(send[-1]))


_STRETCHES = "anchor long, doc_id long, begin int, stop int"


def _cut_out(batches: Batches) -> Batches:
    """Texts with their wanted stretches to (anchor, doc_id, begin, data)."""
    for batch in batches:
        out: list[tuple[int, int, int, bytes]] = []
        for doc_id, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("wanted").to_pylist()):
            out += [(w["anchor"], doc_id, w["begin"], text[w["begin"] : w["stop"]]) for w in wanted]
            if len(out) > 20_000:
                yield _as_batch(out)
                out = []
        if out:
            yield _as_batch(out)


def _windows(length: int, most: int = WINDOWS):
    """Texts with their stretches of hot anchors to rows of _ANCHOR_ROWS, one for each window.

    Both anchor and digest are halves of the window's own digest, so a key holds equal windows
    only. Of those in one piece of work, about most windows, only the first goes on.
    """

    def run(batches: Batches) -> Batches:
        digest, mask = xxhash.xxh3_128_intdigest, 2**64 - 1
        docs, begins, high, low = ([] for _ in range(4))

        def close() -> pa.RecordBatch:
            doc, begin = np.array(docs, np.int64), np.array(begins, np.int64)
            halves = (np.array(x, np.uint64).view(np.int64) for x in (high, low))
            return _first_of_equals(*halves, doc, begin, begin + length, doc)

        for batch in batches:
            for doc_id, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("wanted").to_pylist()):
                for w in sorted(wanted, key=lambda w: w["begin"]):
                    for at in range(w["begin"], w["stop"] - length + 1):
                        x = digest(text[at : at + length])
                        docs.append(doc_id)
                        begins.append(at)
                        high.append(x >> 64)
                        low.append(x & mask)
                    if len(docs) >= most:
                        yield close()
                        docs, begins, high, low = ([] for _ in range(4))
        if docs:
            yield close()

    return run


def _as_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["anchor", "doc_id", "begin", "data"])


# The transform of a collection.


class CollectionTransform:
    """Burrows-Wheeler transform and common prefixes of a collection of strings.

    Symbols are the ranks of the bytes that occur, from 1; 0 ends a string, and ends sort by the
    strings' numbers. Both sequences lie in files of a folder between rounds. Common prefixes are
    capped by 255, the end not counted.
    """

    def __init__(self, strings: list[bytes], folder: str):
        self.n = len(strings)
        self.lengths = np.array([len(s) for s in strings], np.int64)
        flat = np.frombuffer(b"".join(strings), np.uint8)
        self.bytes = np.flatnonzero(np.bincount(flat, minlength=256))
        code = np.zeros(256, np.uint8)
        code[self.bytes] = np.arange(1, len(self.bytes) + 1)
        self.symbols = code[flat]
        self.tops = np.cumsum(self.lengths)  # where each string ends in symbols
        self.size = self.n
        with open(os.path.join(folder, "transform"), "w+b") as self._transform, open(os.path.join(folder, "common"), "w+b") as self._common:
            active = np.flatnonzero(self.lengths > 0)
            first = np.zeros(self.n, np.uint8)
            first[active] = self.symbols[self.tops[active] - 1]
            self._store(first, np.zeros(self.n, np.uint8))
            rows, depth = active.copy(), 1
            while len(active):
                rows = self._round(active, rows, depth)
                on = self.lengths[active] > depth
                active, rows, depth = active[on], rows[on], depth + 1
            self.transform, self.common = self._load()

    def _store(self, transform: np.ndarray, common: np.ndarray) -> None:
        self.size = len(transform)
        for file, data in ((self._transform, transform), (self._common, common)):
            file.seek(0)
            file.write(memoryview(data))

    def _load(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for file in (self._transform, self._common):
            file.seek(0)
            out.append(np.frombuffer(file.read(self.size), np.uint8))
        return tuple(out)

    def _round(self, active: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        """Inserts the suffix of depth symbols of each active string, whose shorter one is at rows."""
        transform, common = self._load()
        by = np.argsort(rows, kind="stable")
        at, own = rows[by], active[by]
        # Rows by symbol and place: a row's place there is that of the suffix that its symbol begins.
        shift = np.uint64(32) if len(transform) >> 24 or len(self.bytes) > 127 else np.uint32(24)
        kind = shift.dtype.type
        keys = transform.astype(kind) << shift | np.arange(len(transform), dtype=kind)
        own_keys = keys[at]
        keys.sort()
        q = np.searchsorted(keys, own_keys)
        new = self.n - int(np.searchsorted(keys, kind(1) << shift)) + q

        padded = np.append(common, np.uint8(0))

        def least(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """Minimum of the common prefixes of rows after low up to high."""
            return np.minimum.reduceat(padded, np.stack((low + 1, high + 1), axis=1).ravel())[::2] if len(low) else np.empty(0, np.uint8)

        def beside(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The row at each place k, and whether it has the symbol of the string's row."""
            key = keys[np.clip(k, 0, len(keys) - 1)]
            return (key & ((kind(1) << shift) - kind(1))).astype(np.int64), (k >= 0) & (k < len(keys)) & (key >> shift == own_keys >> shift)

        row, has = beside(q - 1)
        up = np.zeros(len(at), np.uint8)
        up[has] = np.minimum(least(row[has], at[has]), 254) + 1
        row, follows = beside(q + 1)
        down = np.minimum(least(at[follows], row[follows]), 254) + 1

        size = len(transform) + len(at)
        old = np.ones(size, bool)
        old[new] = False
        out = np.empty(size, np.uint8)
        out[old] = transform
        out[new] = np.where(self.lengths[own] > depth, self.symbols[np.maximum(self.tops[own] - depth - 1, 0)], np.uint8(0))
        out_common = np.empty(size, np.uint8)
        out_common[old] = common
        out_common[new] = up
        out_common[new[follows] + 1] = down
        self._store(out, out_common)
        rows = np.empty(len(at), np.int64)
        rows[by] = new
        return rows

    def suffixes(self, least: int):
        """(string, start, row) of every suffix of at least so many symbols, by walking from the ends."""
        order = np.argsort(self.transform, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        shift = self.n - int((self.transform == 0).sum())
        strings, rows = np.arange(self.n), np.arange(self.n)
        for depth in range(1, int(self.lengths.max(initial=0)) + 1):
            on = self.lengths[strings] >= depth
            strings, rows = strings[on], rows[on]
            rows = shift + place[rows]
            if depth >= least:
                yield strings, self.lengths[strings] - depth, rows


def repeated_windows(strings: list[bytes], docs: np.ndarray, begins: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(doc, begin, stop): runs of windows of the strings that also start earlier in another string's text."""
    with tempfile.TemporaryDirectory() as folder:
        built = CollectionTransform(strings, folder)
    parts, common = list(built.suffixes(length)), built.common
    if not parts:
        return []
    string, start, row = (np.concatenate(x) for x in zip(*parts))
    group = np.cumsum(common < length)[row]
    at = begins[string] + start
    order = np.lexsort((at, docs[string], group))
    first = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    again = order[~first]
    again = again[np.lexsort((at[again], docs[string[again]]))]
    doc, at = docs[string[again]], at[again]
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1))))
    last = np.concatenate((new[1:] - 1, [len(at) - 1]))
    return list(zip(doc[new].tolist(), at[new].tolist(), (at[last] + length).tolist()))


def _first_anchors(strings: list[bytes], length: int, k: int) -> list[int]:
    """Where the anchor of each string's first window begins in it; a place has few bits, so few strings are joined at once."""
    out: list[int] = []
    ends = np.cumsum([0, *map(len, strings)])
    a = 0
    while a < len(strings):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + PIECE_BYTES, side="right")) - 1)
        starts = ends[a:b] - ends[a]
        _, places = anchors(np.frombuffer(b"".join(strings[a:b]), np.uint8), length, k)
        out += (places[starts] - starts).tolist()
        a = b
    return out


def shared_parts(strings: list[bytes], groups: np.ndarray, length: int, k: int, cases: int = 4) -> list[tuple[int, int, int]]:
    """(string, begin, stop): the parts of strings that may hold a window of another of their group.

    The places of a window's anchor in it fall into a few ranges. All of a string's windows with
    the anchor in one range have a core of bytes in common, more than half a window, so strings
    that share such a window share the core. Only stretches with a shared core are compared.
    """
    offsets = _first_anchors(strings, length, k)
    edges = [round(i * (length - k + 1) / cases) for i in range(cases + 1)]
    digest = xxhash.xxh3_64_intdigest
    owner, case, cores = [], [], []
    for i, (text, at, group) in enumerate(zip(strings, offsets, groups.tolist())):
        last = len(text) - length  # windows begin at 0 up to here
        for c, (a, z) in enumerate(zip(edges, edges[1:])):
            if max(a, at - last) <= min(z - 1, at):
                owner.append(i)
                case.append(c)
                cores.append(digest(text[at - a : at - z + 1 + length], group % 2**64))
    owner, case = np.array(owner), np.array(case)
    _, which, count = np.unique(np.stack((np.array(cores, np.uint64), case.astype(np.uint64))), axis=1, return_inverse=True, return_counts=True)
    shared = count[which.ravel()] > 1
    out = []
    for i, first, final in _ranges(owner[shared], case[shared]):
        at, last = offsets[i], len(strings[i]) - length
        out.append((i, max(0, at - edges[final + 1] + 1), min(last, at - edges[first]) + length))
    return out


def _ranges(owner: np.ndarray, case: np.ndarray) -> list[tuple[int, int, int]]:
    """(owner, least case, largest case); owners and cases rise."""
    if not len(owner):
        return []
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    ends = np.concatenate((heads[1:] - 1, [len(owner) - 1]))
    return list(zip(owner[heads].tolist(), case[heads].tolist(), case[ends].tolist()))


def _compare(length: int, k: int, block: int):
    """Stretches sorted by anchor to (doc_id, begin, stop) to remove; an anchor's stretches stay in one block."""

    def run(batches: Batches) -> Batches:
        held: list[bytes] = []
        docs: list[int] = []
        begins: list[int] = []
        groups: list[int] = []
        now = None

        def close() -> pa.RecordBatch:
            parts = shared_parts(held, np.array(groups, np.int64), length, k)
            strings = [held[i][a:b] for i, a, b in parts]
            found = repeated_windows(strings, np.array([docs[i] for i, _, _ in parts], np.int64), np.array([begins[i] + a for i, a, _ in parts], np.int64), length) if parts else []
            kinds = (pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], ["doc_id", "begin", "stop"])

        for batch in batches:
            for anchor, doc_id, begin, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "begin", "data"))):
                if anchor != now:
                    if len(held) >= block:
                        yield close()
                        held, docs, begins, groups = [], [], [], []
                    now = anchor
                held.append(data)
                groups.append(anchor)
                docs.append(doc_id)
                begins.append(begin)
        if held:
            yield close()

    return run


# The operator.


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, block: int = BLOCK_STRINGS, hot: int = HOT) -> DataFrame:
    """(doc_id, begin, stop): byte ranges that passages which start earlier cover; they may overlap.

    docs has a row per doc_id, neither it nor text NULL (keyed).
    """
    found = map_batches(docs, _anchor_rows(length, k), _ANCHOR_ROWS)
    grouped = found.repartition("anchor").sortWithinPartitions("anchor", "digest", "doc_id", "begin")
    settled = cut(map_batches(grouped, _settle, _STRETCHES))
    wanted = settled.where("anchor is not null")
    crowded = wanted.groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    any_hot = not crowded.isEmpty()

    def texts(rows: DataFrame) -> DataFrame:
        return docs.join(rows.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "begin", "stop")).alias("wanted")), "doc_id")

    few = wanted.join(crowded, "anchor", "left_anti") if any_hot else wanted
    stretches = map_batches(texts(few), _cut_out, "anchor long, doc_id long, begin int, data binary")
    compared = stretches.repartition("anchor").sortWithinPartitions("anchor")
    more = map_batches(compared, _compare(length, k, block), "doc_id long, begin int, stop int")
    if any_hot:
        windows = map_batches(texts(wanted.join(crowded, "anchor", "left_semi")), _windows(length), _ANCHOR_ROWS)
        dealt = windows.repartition("anchor", "digest").sortWithinPartitions("anchor", "digest", "doc_id", "begin")
        more = more.unionByName(map_batches(dealt, _settle, _STRETCHES).where("anchor is null").select("doc_id", "begin", "stop"))
    return settled.where("anchor is null").select("doc_id", "begin", "stop").unionByName(more)


def _remove(batches: Batches) -> Batches:
    for batch in batches:
        kept, spans = [], []
        for text, found in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("found").to_pylist()):
            merged: list[list[int]] = []
            for x in sorted((s["begin"], s["stop"]) for s in found or []):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(list(x))
            parts, at = [], 0
            for a, b in merged:
                parts.append(text[at:a])
                at = b
            parts.append(text[at:])
            kept.append(b"".join(parts))
            spans.append([{"begin": a, "stop": b} for a, b in merged])
        sizes = [len(x) if x else 0 for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every document: the merged byte ranges that go, and the rest.

    A byte goes if a string of length bytes that covers it also starts earlier: in a document of
    smaller doc_id, or before in the same; matches are judged on the input. Rows that
    repeat a doc_id with another text follow by text (see in_order), NULL is the smallest id. Texts shorter than length, empty and NULL
    ones stay as they are. kept may begin or end inside a character. No rows give no rows.
    """
    own, names = keyed(docs)
    found = repeated_spans(own, length, **how).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "stop")).alias("found"))
    schema = "doc_id long, n_bytes long, spans array<struct<begin:int,stop:int>>, kept binary"
    return named(map_batches(own.join(found, "doc_id", "left"), _remove, schema), names).withColumn("doc_id", shown_id())


def repeat_report(docs: DataFrame) -> DataFrame:
    """without_repeats as counts and a digest of the remaining bytes."""
    removed = F.expr("cast(aggregate(spans, 0, (n, s) -> n + s.stop - s.begin) as long)")
    return without_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
