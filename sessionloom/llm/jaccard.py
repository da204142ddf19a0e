"""Documents whose sets of word n-grams have a Jaccard similarity of a given percentage: size-aware heavy-light join.

Two sets that are similar enough share nearly all elements of either. With elements in one order of
the whole corpus, both have the k first common elements among their first few (the prefix, see
prefix_length). So

* small (light) sets enumerate the k-subsets of their prefix, k = 2, as keys: few sets share one;
* large (heavy) sets, whose subsets would be too many, post single elements, and a set is looked up
  in the inverted lists of its own; small sets near the boundary post them too, for larger partners.

The boundary is the one of least cost, from the sizes of all sets and the mean length of a list.
Rare elements come first: frequencies are counted over all documents, in classes by the power of
two, and looked up in a table of bounded size.

Sets that share a key are not all paired. First each is compared with one of them (the key's
centre), then, where that leaves a key's sets apart, with the one in the middle of most that may be
similar; this links families of near copies at once. Only sets of a key that are not connected
then are compared with each other, by bitmaps of odd and even counts (the Hamming distance of two
such bitmaps is never above the number of elements that only one of two sets has), each pair at one
of the keys it shares, and what passes is checked on the elements. Links of connected sets are not
looked for, so components are exact.

Elements are 64-bit hashes of shingles, sets are known by 64 bits of a digest of their elements; if
two sets of the corpus shared those, all are hashed anew with another seed.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import Batches, cut, keyed, map_batches, named, raw, shared_folder, shown_id, slices
from sessionloom.llm.components import components

WIDTH = 4
PERCENT = 85
#: Frequencies are known by the first so many bits of an element's hash: a table of 16 MB.
CELL_BITS = 24
#: Cells that travel as one row.
_PIECE = 1 << 18
#: Lists of elements found less often count for the cost of a key.
FREQUENT = 16
#: Elements that one task counts, about.
_COUNTED = 1 << 20
#: Elements a worker holds before it hands their counts on.
_HELD = 1 << 20
#: Cost of looking at a member of an inverted list, against that of writing a key.
SCAN_COST = 0.1
WORDS = 8
#: Elements of the prefixes that two similar sets have in common at least, where one is large.
SHARED = 4
#: Members of a key compared in one block with each other.
BLOCK = 1024
#: Keys a set carries, by which a pair knows the first key that both have.
CARRIED = 32
#: Sets that one task compares with a centre.
STAR = 2000
#: So many ids, 16 bytes each, may be sent to every executor.
FEW_IDS = 1 << 20
_BATCH_BYTES = 2 << 20
_U = np.uint64


# --- sets ---------------------------------------------------------------------------------------


def _mixed_once(x: np.ndarray) -> np.ndarray:
    x = x * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Longer words are hashed one by one.
_LONG = 24


class Shingler:
    """Distinct shingle hashes of texts, sorted per text; a run of bytes of all texts at a time."""

    def __init__(self, width: int, seed: int):
        self.width, self.seed = width, seed
        self.table = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=_U)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, words of each text)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = b" ".join(texts).lower()
        own = np.frombuffer(data, np.uint8)
        edges = np.diff(_SPACE[own].view(np.int8), prepend=1, append=1)
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        h, live = np.full(len(starts), self.seed, _U), np.arange(len(starts))
        length = ends - starts
        for n in range(_LONG):
            live = live[length[live] > n]
            h[live] = _mixed_once(h[live] ^ self.table[own[starts[live] + n]])
        for i in live[length[live] > _LONG].tolist():
            h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], self.seed)
        before = np.searchsorted(starts, np.cumsum(sizes + 1))
        return h, np.diff(before, prepend=0)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(elements of all texts, where each text's end): one array for many texts."""
        words, many = self.words(texts)
        sizes = np.where(many, np.maximum(many - self.width + 1, 1), 0)
        ends = np.cumsum(sizes)
        text_of = np.repeat(np.arange(len(many)), sizes)
        at = np.repeat(np.cumsum(many) - many - (ends - sizes), sizes) + np.arange(len(text_of))
        length = np.repeat(np.minimum(many, self.width), sizes)
        h = length.astype(_U)
        for i in range(self.width):
            there = i < length
            h = _mixed(h + words[at + i]) if there.all() else np.where(there, _mixed(h + words[np.where(there, at + i, 0)]), h)
        for first, end in zip((ends - sizes).tolist(), ends.tolist()):
            h[first:end].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text_of[1:] != text_of[:-1])
        return h[new], np.cumsum(np.bincount(text_of[new], minlength=len(many)))

    def one(self, text: bytes) -> np.ndarray:
        return self([text])[0]


def _texts(batches: Batches):
    """(batch, its texts), of bounded size."""
    for batch in batches:
        for part in slices(batch, "text", _BATCH_BYTES):
            yield part, raw(part.column("text"))


def _digests(elements: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(identity, check) per set: two halves of a 128-bit digest as longs."""
    data = memoryview(elements.astype("<u8").tobytes())
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    found = b"".join(xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(begins.tolist(), ends.tolist()))
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def bitmaps(elements: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per set WORDS longs: a bit is set where an odd number of its elements falls on it."""
    bits, out = 64 * WORDS, np.empty((len(ends), WORDS), np.int64)
    sizes = np.diff(ends, prepend=0)
    place = ((elements >> _U(20)) % _U(bits)).astype(np.int64)
    for at in range(0, len(ends), 1024):
        to = min(at + 1024, len(ends))
        first = ends[at - 1] if at else 0
        own = np.repeat(np.arange(to - at), sizes[at:to]) * bits + place[first : ends[to - 1]]
        odd = (np.bincount(own, minlength=(to - at) * bits) & 1).astype(np.uint8).reshape(-1, bits)
        out[at:to] = np.packbits(odd, axis=1, bitorder="little").view("<i8")
    return out


_INFO = "doc_id long, n long, sid long, other long, " + ", ".join(f"s{i} long" for i in range(WORDS))


def _infos(width: int, seed: int):
    def run(batches: Batches) -> Batches:
        shingles = Shingler(width, seed)
        for part, texts in _texts(batches):
            elements, ends = shingles(texts)
            n, ids, maps = np.diff(ends, prepend=0), _digests(elements, ends), bitmaps(elements, ends)
            columns = [part.column("doc_id"), pa.array(n), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), *(pa.array(m) for m in maps.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sid", "other", *(f"s{i}" for i in range(WORDS))])

    return run


# --- which sets can be similar ------------------------------------------------------------------


def least_overlap(n, percent: int):
    """Elements of a set of n that any similar set shares."""
    return -(-n * percent // 100)


def prefix_length(n, k: int, percent: int):
    """So many first elements of a set of n hold k of those it shares with any similar set, or all."""
    return np.minimum(n, n - least_overlap(n, percent) + k)


def alone(n, percent: int):
    """Can a set of n be similar to itself only?"""
    return (least_overlap(n, percent) == n) & (n * 100 // percent == n)


def boundary(sizes: dict[int, int], met: float, percent: int) -> int:
    """Sets of fewer elements than this are small; the bound of least cost.

    ``sizes`` counts the sets by size; ``met`` is the mean number of others in the list of an element.
    """
    own = np.array(sorted(s for s in sizes if not alone(s, percent)), np.int64)
    if not len(own):
        return 0
    many = np.array([sizes[int(s)] for s in own], float)
    p = prefix_length(own, 2, percent).astype(float)
    subsets = np.concatenate(([0], np.cumsum(many * p * (p - 1) / 2)))
    lists = many * prefix_length(own, SHARED, percent) * (1 + SCAN_COST * met)
    rest = np.concatenate((np.cumsum(lists[::-1])[::-1], [0]))
    none_large = 2 * own[-1] * 100 // percent
    bounds = np.concatenate((own, [none_large]))
    posting = np.searchsorted(own, least_overlap(bounds, percent))
    return int(bounds[np.argmin(subsets + rest[posting])])


# --- frequencies --------------------------------------------------------------------------------


def _held_counts(held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Counts of elements per bucket (their first bits); elements met once are listed without a count."""
    elements, counts = np.unique(np.concatenate(held or [np.empty(0, _U)]), return_counts=True)
    bucket = (elements >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(elements), np.int64)
    short = ((elements << _U(bits)) >> _U(32)).astype("<u4")
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = []
    for a, b in zip(starts, [*starts[1:], len(elements)]):
        once = counts[a:b] == 1
        out.append((int(bucket[a]), short[a:b][once].tobytes(), short[a:b][~once].tobytes(), counts[a:b][~once].astype("<u4").tobytes()))
    columns = list(zip(*out)) or [()] * 4
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "once", "often", "counts"])


def _counts(width: int, seed: int, bits: int):
    def run(batches: Batches) -> Batches:
        shingles, held, n = Shingler(width, seed), [], 0
        for _, texts in _texts(batches):
            held.append(shingles(texts)[0])
            n += len(held[-1])
            if n > _HELD:
                yield _held_counts(held, bits)
                held, n = [], 0
        yield _held_counts(held, bits)

    return run


def _classes(bits: int):
    """Per bucket the frequency class of each of its cells, and totals over elements that are not frequent."""

    def run(batches: Batches) -> Batches:
        at, values, numbers = None, [], []

        def close():
            elements, inverse = np.unique(np.concatenate(values), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(numbers)).astype(np.int64)
            cells = np.zeros(1 << (CELL_BITS - bits), np.uint8)
            np.maximum.at(cells, elements >> np.uint32(32 - CELL_BITS + bits), np.log2(total).astype(np.uint8))
            rare = total[total < FREQUENT].astype(float)
            places = list(range(0, len(cells), _PIECE))
            none = [0.0] * (len(places) - 1)
            columns = [
                pa.array([at * len(cells) + p for p in places], pa.int64()),
                pa.array([cells[p : p + _PIECE].tobytes() for p in places]),
                pa.array([float(rare.sum()), *none]),
                pa.array([float((rare**2).sum()), *none]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["first", "cells", "n", "squares"])

        for batch in batches:
            for bucket, once, often, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "once", "often", "counts"))):
                if at is not None and bucket != at:
                    yield close()
                    values, numbers = [], []
                at = bucket
                values += [np.frombuffer(once, "<u4"), np.frombuffer(often, "<u4")]
                numbers += [np.ones(len(once) // 4), np.frombuffer(counts, "<u4").astype(float)]
        if at is not None:
            yield close()

    return run


class Order:
    """Elements by the class of their cell, then by hash. Any cells give an order that is right."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def sorted(self, elements: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The elements of many sets, each set's in order."""
        place = np.repeat(np.arange(len(ends)) * 64, np.diff(ends, prepend=0)) + self.cells[elements >> _U(65 - len(self.cells).bit_length())]
        return elements[np.argsort(place, kind="stable")]


def order_of(docs: DataFrame, total: int, width: int, seed: int) -> tuple[Order, float]:
    """The order of elements by their frequency in docs, and the mean number of others in a rare element's list.

    All elements are counted. What is sent to the executors is the class of 2**CELL_BITS cells, the
    highest of its elements: bounded, whatever the corpus. In a large one a cell's elements are
    more, so elements rarer than most cells' highest class lie among each other by hash.
    """
    bits = min(CELL_BITS, int(total // _COUNTED).bit_length())
    counted = map_batches(docs, _counts(width, seed, bits), "bucket long, once binary, often binary, counts binary")
    grouped = counted.repartition("bucket").sortWithinPartitions("bucket")
    found = cut(map_batches(grouped, _classes(bits), "first long, cells binary, n double, squares double"))
    rare = found.agg(F.sum("n"), F.sum("squares")).first()
    cells = np.zeros(1 << CELL_BITS, np.uint8)
    for r in found.select("first", "cells").toLocalIterator():
        cells[r.first : r.first + len(r.cells)] = np.frombuffer(r.cells, np.uint8)
    return Order(cells), (rare[1] / rare[0] - 1 if rare[0] else 0.0)


# --- keys ---------------------------------------------------------------------------------------


@lru_cache(maxsize=1000)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def keys(elements: np.ndarray, ends: np.ndarray, order: Order, bound: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) for many sets: two similar sets have a key in common, of single elements SHARED where one is large."""
    first, n = order.sorted(elements, ends), np.diff(ends, prepend=0)
    begins, able = ends - n, (n > 0) & ~alone(n, percent)
    listed = np.where(able & (n >= least_overlap(bound, percent)), prefix_length(n, SHARED, percent), 0)
    owner = np.repeat(np.arange(len(n)), listed)
    at = begins[owner] + np.arange(len(owner)) - (np.cumsum(listed) - listed)[owner]
    made, owners = [_mixed(first[at] ^ _U(0x5851F42D4C957F2D))], [owner]
    for i in np.flatnonzero(able & (n < bound)):
        own = first[begins[i] : begins[i] + prefix_length(n[i], 2, percent)]
        a, b = _pairs(len(own))
        made.append(_mixed(own[a] * _U(0x9E3779B97F4A7C15) + _mixed(own[b])))
        owners.append(np.full(len(a), i))
    return np.concatenate(made), np.concatenate(owners)


def _postings(width: int, seed: int, order, bound: int, percent: int):
    def run(batches: Batches) -> Batches:
        shingles, seen = Shingler(width, seed), set()
        for _, texts in _texts(batches):
            elements, ends = shingles(texts)
            sid = _digests(elements, ends)[:, 0]
            new = np.fromiter((not (s in seen or seen.add(s)) for s in sid.tolist()), bool, len(sid))
            if len(seen) > 500_000:
                seen.clear()
            made, owner = keys(elements, ends, order.value, bound, percent)
            kept = new[owner]
            yield pa.RecordBatch.from_arrays([pa.array(made[kept].view(np.int64)), pa.array(sid[owner[kept]])], ["key", "sid"])

    return run


# --- comparing ----------------------------------------------------------------------------------


def _near(a: str, b: str, percent: int) -> Column:
    """Can sets of these sizes and bitmaps be similar? Of x and y elements they differ in at most (x + y)(100 - p) / (100 + p)."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(WORDS)])
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (apart * (100 + percent) <= (x + y) * (100 - percent))


def _elements(width: int, seed: int):
    def run(batches: Batches) -> Batches:
        shingles = Shingler(width, seed)
        for part, texts in _texts(batches):
            elements, ends = shingles(texts)
            data, begins = elements.astype("<u8").tobytes(), np.concatenate(([0], ends[:-1])) if len(ends) else ends
            found = [data[8 * a : 8 * b] for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("sid"), pa.array(found, pa.binary())], ["sid", "elements"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of two sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _compare(percent: int):
    """Rows of a centre (b NULL), then of its candidates, to links."""

    def run(batches: Batches) -> Batches:
        at, centre = None, np.empty(0, _U)
        for batch in (part for whole in batches for part in slices(whole, "elements", _BATCH_BYTES)):
            out = []
            for a, salt, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "_salt", "b", "elements"))):
                elements = np.frombuffer(data, "<u8")
                if b is None:
                    at, centre = (a, salt), elements
                elif (a, salt) == at and similar(centre, elements, percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, docs: DataFrame, info: DataFrame, width: int, seed: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. A set in many pairs is sent to several tasks."""
    spark = pairs.sparkSession
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    ids = cut(wanted.join(info, "sid").select("sid", F.col("first_id").alias("doc_id")))
    # Few ids go to the texts, many meet them in a shuffle.
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    folder = shared_folder(spark, "elements")
    map_batches(docs.join(ids, "doc_id").select("sid", "text"), _elements(width, seed), "sid long, elements binary").write.parquet(folder)
    sets = spark.read.parquet(folder)
    tasks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("_n"))
    salted = pairs.join(tasks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_n")).alias("_salt"))
    members = salted.join(sets.withColumnRenamed("sid", "b"), "b").select("a", "_salt", "b", "elements")
    centres = tasks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_salt"))
    heads = centres.join(sets.withColumnRenamed("sid", "a"), "a").select("a", "_salt", F.lit(None).cast("long").alias("b"), "elements")
    both = heads.unionByName(members).repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.col("b").asc_nulls_first())
    return cut(map_batches(both, _compare(percent), "a long, b long"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _near_pairs(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    whole = F.struct("n", *(f"s{i}" for i in range(WORDS)))
    x = info.select(F.col("sid").alias("a"), whole.alias("x"))
    y = info.select(F.col("sid").alias("b"), whole.alias("y"))
    return pairs.join(x, "a").join(y, "b").where(_near("x", "y", percent)).select("a", "b")


def _grouped(batches: Batches, names: list[str], by: int):
    """Rows as longs, a group of equal first ``by`` columns at a time; ``carried`` keys as CARRIED columns."""

    def rows(batch: pa.RecordBatch) -> np.ndarray:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if "carried" in batch.schema.names:
            lists = batch.column("carried")
            many = lists.value_lengths().to_numpy(zero_copy_only=False)
            keys_ = np.zeros((len(many), CARRIED), np.int64)
            keys_[np.arange(CARRIED) < many[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            columns += [many, *keys_.T]
        return np.column_stack(columns)

    rest = None
    for batch in chain(batches, [None]):
        if batch is not None:
            if not len(batch):
                continue
            rest = rows(batch) if rest is None else np.concatenate((rest, rows(batch)))
        if rest is None:
            return
        groups = np.split(rest, np.flatnonzero((rest[1:, :by] != rest[:-1, :by]).any(1)) + 1)
        if batch is not None:
            rest = groups.pop()
        yield groups


def _candidates(comp: np.ndarray, n: np.ndarray, maps: np.ndarray, percent: int):
    """(i, the j after i) that may be similar and are not connected; sets rise by size."""
    reach = np.searchsorted(n, n * 100 // percent, "right")
    for i in range(len(n) - 1):
        j = i + 1 + np.flatnonzero(comp[i + 1 : reach[i]] != comp[i])
        apart = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
        j = j[apart * (100 + percent) <= (n[j] + n[i]) * (100 - percent)]
        if len(j):
            yield i, j


def _middles(percent: int):
    """Members of a key to the bitmap in the middle of the one with most candidates and these."""

    def middle_of(own: np.ndarray) -> np.ndarray | None:
        own = own[np.argsort(own[:, 2], kind="stable")]
        found = list(_candidates(own[:, 1], own[:, 2], own[:, 3:].astype(_U), percent))
        if not found:
            return None
        a, b = np.concatenate([np.full(len(j), i) for i, j in found]), np.concatenate([j for _, j in found])
        best = np.argmax(np.bincount(np.concatenate((a, b)), minlength=len(own)))
        near = own[[best, *b[a == best], *a[b == best]], 3:]
        bits = np.unpackbits(np.ascontiguousarray(near).view(np.uint8), axis=1, bitorder="little")
        return np.packbits(2 * bits.sum(0) > len(near), bitorder="little").view("<i8")

    def run(batches: Batches) -> Batches:
        maps = [f"s{i}" for i in range(WORDS)]
        for groups in _grouped(batches, ["key", "comp", "n", *maps], 1):
            found = [(g[0, 0], m) for g in groups if len(g) > 1 and (m := middle_of(g)) is not None]
            rows = np.array([(k, *m) for k, m in found], np.int64).reshape(-1, 1 + WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in rows.T], ["key", *(f"m{i}" for i in range(WORDS))])

    return run


def _block_pairs(percent: int, bound: int):
    """Members of a key and of two of its blocks to the pairs that may be similar and are not connected yet.

    ``need`` is the number of keys that a similar pair of these sizes has in common. A pair that has
    so many among those carried is a row at the first of them only, another one at each key.
    """

    def pairs_of(own: np.ndarray) -> tuple[np.ndarray, ...]:
        own = own[np.argsort(own[:, 6], kind="stable")]
        key, first, second = own[0, :3]
        block, sid, comp, n, maps = *own[:, 3:7].T, own[:, 7 : 7 + WORDS].astype(_U)
        many, carried = own[:, 7 + WORDS], own[:, 8 + WORDS :]
        held, found = np.arange(carried.shape[1]) < many[:, None], []
        for i, j in _candidates(comp, n, maps, percent):
            if first != second:
                j = j[block[j] != block[i]]
            need = np.where(n[j] < bound, 1, np.minimum(SHARED, least_overlap(n[j], percent)))
            both = np.isin(carried[j], carried[i, : many[i]]) & held[j]
            enough = both.sum(1) >= need
            least = carried[j, both.argmax(1)]
            here = ~enough | (least == key)
            j, need, enough = j[here], need[here], enough[here]
            found.append((np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j]), np.where(enough, need, 1), need))
        return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64),) * 4

    def run(batches: Batches) -> Batches:
        for groups in _grouped(batches, ["key", "_i", "_j", "_block", "sid", "comp", "n", *(f"s{i}" for i in range(WORDS))], 3):
            found = [pairs_of(g) for g in groups if len(g) > 1]
            columns = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "met", "need"])

    return run


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, sid, ...) with the component (comp) that links give them, of keys that have several, and the _blocks of their key.

    Keys whose sets are all connected go, and those of two sets, which were compared.
    """
    roots = components(links).select(F.col("node").alias("sid"), F.col("root"))
    placed = members.drop("comp", "_blocks").join(roots, "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
    open_ = placed.groupBy("key").agg(F.count(F.lit(1)).alias("_members"), F.min("comp").alias("_low"), F.max("comp").alias("_high"))
    open_ = open_.where("_members > 2 and _low <> _high").select("key", F.ceil(F.col("_members") / BLOCK).alias("_blocks"))
    return placed.join(open_, "key")


def _block() -> Column:
    return F.pmod(F.xxhash64("sid"), F.col("_blocks"))


def _middle_stars(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a key's set in the middle, a, and each that may be similar and is not connected with it.

    Which bitmap is the middle is told by one block; the key's set nearest to it is a. Sets
    which this does not pair are met later, so a middle that is ill chosen costs time only.
    """
    sample = members.where(_block() == 0).select("key", "comp", "n", *(f"s{i}" for i in range(WORDS)))
    grouped = sample.repartition("key").sortWithinPartitions("key")
    middles = cut(map_batches(grouped, _middles(percent), "key long, " + ", ".join(f"m{i} long" for i in range(WORDS))))
    off = reduce(Column.__add__, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"m{i}"))) for i in range(WORDS)])
    set_ = F.struct("sid", "comp", "n", *(f"s{i}" for i in range(WORDS)))
    centres = members.join(middles, "key").groupBy("key").agg(F.min_by(set_, F.struct(off, "sid")).alias("x"))
    return members.withColumn("y", set_).join(centres, "key").where((F.col("x.comp") != F.col("y.comp")) & _near("x", "y", percent)).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()


def _rest(members: DataFrame, percent: int, bound: int) -> DataFrame:
    """Pairs (a, b) that share as many keys as similar ones do, may be similar, and are not connected.

    A key that is left out here (see _open), or a centre of a key, has been compared with the pair's
    other set; all other keys a pair shares are met here, so they can be counted.

    Sets are dealt to blocks of bounded size by a hash, and every two blocks of a key meet in a group.
    """
    carried = members.groupBy("sid").agg(F.slice(F.sort_array(F.collect_set("key")), 1, CARRIED).alias("carried"))
    placed = members.join(carried, "sid").withColumn("_block", _block())
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_with"))
    maps = [f"s{i}" for i in range(WORDS)]
    full = dealt.select("key", F.least("_block", "_with").alias("_i"), F.greatest("_block", "_with").alias("_j"), "_block", "sid", "comp", "n", *maps, "carried")
    grouped = full.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j")
    met = map_batches(grouped, _block_pairs(percent, bound), "a long, b long, met long, need long")
    return met.groupBy("a", "b").agg(F.sum("met").alias("_keys"), F.max("need").alias("need")).where("_keys >= need").select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sets(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, n, sid) per document; each distinct set that is not empty, with its smallest doc_id, copies, size and bitmap; the seed."""
    for seed in range(100):
        found = _stored(map_batches(docs, _infos(width, seed), _INFO), "sets")
        same = [F.min(c).alias(c) for c in ("n", *(f"s{i}" for i in range(WORDS)))]
        info = cut(found.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), *same, F.min("other").alias("_low"), F.max("other").alias("_high")))
        if info.where("_low <> _high").limit(1).count() == 0:
            break
    return found.select("doc_id", "n", "sid"), info.drop("_low", "_high"), seed


def links(docs: DataFrame, info: DataFrame, seed: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(a, b): similar pairs of distinct sets (sid) that connect all similar ones."""
    spark: SparkSession = docs.sparkSession
    sizes = info.groupBy("n").agg(F.count(F.lit(1)).alias("sets"), F.sum("copies").alias("docs")).collect()
    order, met = order_of(docs, sum(r.n * r.docs for r in sizes), width, seed)
    bound = boundary({r.n: r.sets for r in sizes}, met, percent)
    shared_order = spark.sparkContext.broadcast(order)
    posted = _stored(map_batches(docs, _postings(width, seed, shared_order, bound, percent), "key long, sid long"), "postings")
    shared_order.destroy()
    span = posted.groupBy("key").agg(F.min("sid").alias("centre"), F.max("sid").alias("_last")).where("centre <> _last").select("key", "centre")
    shared = _stored(posted.join(span, "key"), "shared")
    stars = shared.where("sid <> centre").select(F.col("centre").alias("a"), F.col("sid").alias("b")).distinct()
    found = _verified(cut(_near_pairs(stars, info, percent)), docs, info, width, seed, percent)
    members = cut(_open(shared.select("key", "sid").distinct(), found).join(info.drop("first_id", "copies"), "sid"))
    compared = _ordered(stars)
    middle = cut(_middle_stars(members, percent).join(compared.union(compared.select("b", "a")), ["a", "b"], "left_anti"))
    if not middle.isEmpty():
        found = found.unionByName(_verified(middle, docs, info, width, seed, percent))
        stars = stars.unionByName(middle)
        members = cut(_open(members, found))
    rest = cut(_rest(members, percent, bound).join(_ordered(stars), ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return found
    return found.unionByName(_verified(rest, docs, info, width, seed, percent))


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document; component_id is the smallest doc_id it can reach.

    A text with fewer words than width is one shingle. Texts without a word (NULL, empty, white
    space) have none and are linked with nothing, not with each other either. Equal sets are linked.
    Rows that repeat a doc_id with another text are documents of their own (see in_order), NULL is
    the smallest id. No rows give no rows; other columns don't count.
    """
    own, names = keyed(docs)
    sets, info, seed = _sets(own, width)
    joined = components(links(own, info, seed, width, percent))
    roots = info.select("sid", "first_id").join(joined, info.sid == joined.node, "left").select("sid", "first_id", F.coalesce("root", "sid").alias("root"))
    heads = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_set = roots.join(heads, "root").select("sid", "component_id")
    full = sets.where("n > 0").join(of_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named(full.unionByName(empty), names, "doc_id", "component_id").select(shown_id(), "n_shingles", shown_id("component_id"))
