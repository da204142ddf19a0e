"""SimHash near-duplicates through a table of distances to reference fingerprints (pivots).

Distances to a pivot obey the triangle inequality: fingerprints at distance d have, for every
pivot, distances to it that differ by d at most. So pairs with a larger maximum coordinate
difference go, and the few that stay are compared bit by bit.

To find pairs without looking at all of them, pivots come in families. The pivots of a family
equal the base pivot outside one quarter of the bits, so a distance to one of them less the
distance to the base depends on that quarter alone. With two bits allowed to differ, at least two
of four quarters are equal, and with them the differences of both families: pairs of families
are the keys of an equi-join, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Batches, cut, keyed, map_batches, named, raw, shown_id, with_ids
from sessionloom.llm.components import components

SEED = 42
#: Bits that may differ in a link. The pivot families are built for this number.
MAX_BITS = 2
FAMILIES = 4
PIVOTS_PER_FAMILY = 16
#: Fingerprints under one key that are compared with each other; larger groups meet at midpoints.
GROUP_LIMIT = 256


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of width words (lower-case A-Z, white space 0x20 and 0x09-0x0D)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    data, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(data[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits of the fingerprint of the whole text as a long."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(x, width)) for x in raw(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def pivots() -> np.ndarray:
    """Reference fingerprints: the base, then each family's, which differ from it in a quarter only."""
    rng = np.random.default_rng(2024)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    width = 64 // FAMILIES
    masks = rng.integers(1, 2**width, (FAMILIES, PIVOTS_PER_FAMILY), dtype=np.uint64)
    return np.concatenate(([base], (base ^ (masks << (np.arange(FAMILIES, dtype=np.uint64) * np.uint64(width))[:, None])).ravel()))


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint (rows) to every pivot (columns)."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.uint8)


def _keys(table: np.ndarray) -> list[np.ndarray]:
    """For each pair of families, a key of both families' distances relative to the base."""
    rest = (table[:, 1:].astype(np.int16) - table[:, :1]).reshape(len(table), FAMILIES, PIVOTS_PER_FAMILY)
    weights = np.random.default_rng(7).integers(0, 2**63, (FAMILIES, PIVOTS_PER_FAMILY), dtype=np.uint64) | np.uint64(1)
    mixed = (rest.astype(np.int64).view(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out = []
    for n, (a, b) in enumerate(combinations(range(FAMILIES), 2)):
        key = (mixed[:, a] * np.uint64(0x9E3779B97F4A7C15) + (mixed[:, b] ^ (mixed[:, b] >> np.uint64(31)))) * np.uint64(2 * n + 3)
        out.append((key ^ (key >> np.uint64(32))).view(np.int64))
    return out


def _index(batches: Batches) -> Batches:
    """A row per fingerprint and pair of families: key, fingerprint, its row of the pivot table."""
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(fps):
            continue
        table = pivot_table(fps.view(np.uint64))
        row = pa.array([x.tobytes() for x in table], pa.binary())
        for key in _keys(table):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps), row], ["key", "fp", "distances"])


def _forest(fps: np.ndarray, table: np.ndarray, bits: int):
    """Links that connect what the group's links connect, one less than members at most."""
    root = np.arange(len(fps))
    for i in range(len(fps) - 1):
        near = np.abs(table[i + 1 :].astype(np.int16) - table[i]).max(axis=1) <= bits
        js = i + 1 + np.flatnonzero(near)
        js = js[np.bitwise_count(fps[js] ^ fps[i]) <= bits]
        for j in js:
            a, b = i, int(j)
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                yield i, int(j)


def _link_groups(bits: int, limit: int):
    """Rows sorted by key to links (a, b); members of a group over the limit come as (a, NULL)."""

    def run(batches: Batches) -> Batches:
        key, fps, rows, large = None, [], [], False
        out_a: list[int] = []
        out_b: list[int | None] = []

        def close():
            if large:
                out_a.extend(fps)
                out_b.extend([None] * len(fps))
            elif len(fps) > 1:
                own = np.array(fps, np.int64)
                table = np.frombuffer(b"".join(rows), np.uint8).reshape(len(fps), -1)
                for i, j in _forest(own.view(np.uint64), table, bits):
                    out_a.append(fps[i])
                    out_b.append(fps[j])

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
            out_a.clear()
            out_b.clear()
            return batch

        for batch in batches:
            for k, fp, row in zip(batch.column("key").to_pylist(), batch.column("fp").to_pylist(), batch.column("distances").to_pylist()):
                if k != key:
                    close()
                    key, fps, rows, large = k, [], [], False
                fps.append(fp)
                if large or len(fps) > limit:  # a large group passes through, it is never held
                    large = True
                    rows = []
                    out_a.extend(fps)
                    out_b.extend([None] * len(fps))
                    fps = []
                else:
                    rows.append(row)
                if len(out_a) >= 10_000:
                    yield flush()
        close()
        yield flush()

    return run


def _midpoints(batches: Batches) -> Batches:
    """Every fingerprint with each of the 65 values at distance 0 or 1."""
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at in range(0, len(fps), 2000):
            part = fps[at : at + 2000]
            mid = (part[:, None] ^ flips).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(part.view(np.int64), 65))], ["mid", "fp"])


def links(distinct_fps: DataFrame, bits: int = MAX_BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b): links among distinct fingerprints (fp) that connect all pairs within bits.

    Groups over the limit (texts from one template, say) are not compared pair by pair: two
    fingerprints are within two bits exactly if both are within one bit of a third value, so
    their members meet at such midpoints, of which each has at most 65 members.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the pivot families find pairs of up to two differing bits")
    index = map_batches(distinct_fps.select("fp"), _index, "key long, fp long, distances binary")
    grouped = index.repartition("key").sortWithinPartitions("key")
    found = cut(map_batches(grouped, _link_groups(bits, limit), "a long, b long").distinct())
    close = found.where("b is not null")
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if bits < MAX_BITS or crowded.isEmpty():
        return close if crowded.isEmpty() else close.unionByName(_crowded_below(crowded, bits))
    met = map_batches(crowded, _midpoints, "mid long, fp long")
    stars = met.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return close.unionByName(stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))


def _crowded_below(crowded: DataFrame, bits: int) -> DataFrame:
    """For less than two bits: each value probes its 65 near values, one row per probe."""
    if bits == 0:
        return crowded.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    met = map_batches(crowded, _midpoints, "mid long, fp long").where("mid <> fp")
    return met.join(crowded.select(F.col("fp").alias("mid")), "mid").select(F.col("mid").alias("a"), F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = MAX_BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every document; component_id is the smallest doc_id it can reach.

    Equal fingerprints count as linked. Texts without a word (NULL, empty, white space) have
    fingerprint 0. Rows that repeat a doc_id with another text are documents of their own (see
    in_order), NULL is the smallest id. No rows give no rows.
    """
    own, names = keyed(docs)
    prints = cut(fingerprints(own, width))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(links(classes, bits, limit))
    roots = classes.join(joined, classes.fp == joined.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    heads = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named(prints.join(roots.join(heads, "root").select("fp", "component_id"), "fp"), names, "doc_id", "component_id")


def near_duplicate_ids(docs: DataFrame, width: int = 3, bits: int = MAX_BITS) -> DataFrame:
    """near_duplicates with fingerprints as 16 lowercase hexadecimal digits."""
    return near_duplicates(docs, width, bits).select(
        shown_id(), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), shown_id("component_id")
    )


def first_of_groups(docs: DataFrame, width: int = 3, bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their group of near-duplicates.

    There is a row per document (see in_order): rows that are equal in doc_id and text are one.
    """
    own = with_ids(docs)
    groups = near_duplicates(own.select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text")), width, bits)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
    return own.join(gone, "_id", "left_anti").select("_row.*")
