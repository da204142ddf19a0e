"""A Merkle tree over a dataset, as a persistent tree: a changed leaf makes a version that copies a path.

Leaves are digests of rows, in the order of doc_id within their source. Runs of 16 nodes make a
node of the next level until one is left, the source's; the sources' nodes make the root likewise.

Levels come in storeys of three. A storey's nodes are cut into aligned blocks of 16**3, each built
by one task as an array per level (Block). Block tops are the nodes of the storey above, so each
storey is a 4096th of the one below. A changed leaf gives a version of its block: the ancestors
that differ are copied, all other nodes are those of the block. Above the block the version goes on
through the siblings that the block's top has in the storeys above, so versions need not meet
anywhere: they are as spread out as the leaves.

Digests are 32 bytes inside and 64 lower-case hexadecimal digits where they are hashed or shown.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import Batches, cut, map_batches, raw

ARITY = 16
STOREY = 3
BLOCK = ARITY**STOREY
#: Rows of results that a task holds.
_ROWS = 2000
_HEX = 64


def joined_hash(*parts: bytes) -> bytes:
    """Hexadecimal sha256 of the parts in a row."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(value: bytes | None) -> bytes:
    """A value with its length in front, so that rows that differ never look alike."""
    return b"-" if value is None else b"%d:%b" % (len(value), value)


def rounds(size: int) -> int:
    """Levels above the leaves until one node is left."""
    n = 0
    while size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


class Block:
    """Up to 16**3 neighbouring nodes and the levels above them; nothing in it ever changes.

    A level is its digests in a row, so a run or a node's siblings are slices of it.
    """

    def __init__(self, nodes: bytes, levels: int):
        self.levels = [nodes]
        width = ARITY * _HEX
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append(b"".join(joined_hash(below[at : at + width]) for at in range(0, len(below), width)))

    @property
    def top(self) -> bytes:
        return self.levels[-1]

    def siblings(self, at: int) -> list[tuple[bytes, bytes]]:
        """The others of the run, left and right of a node, for it and its ancestors below the top."""
        out = []
        for level in self.levels[:-1]:
            first = at - at % ARITY
            out.append((level[first * _HEX : at * _HEX], level[(at + 1) * _HEX : (first + ARITY) * _HEX]))
            at //= ARITY
        return out

    def version(self, at: int, digest: bytes) -> Version:
        """The block with another digest in one place."""
        return Version(self, at, digest)


class Version:
    """A block in which one leaf changed: copies of the leaf's ancestors, and the block for the rest."""

    def __init__(self, base: Block, at: int, digest: bytes):
        self.base = base
        self.copied = {(0, at): digest}
        for level, (left, right) in enumerate(base.siblings(at), 1):
            digest = joined_hash(left, digest, right)
            at //= ARITY
            self.copied[level, at] = digest
        self.top = digest

    def node(self, level: int, at: int) -> bytes:
        """Copied where it differs, else shared with the block."""
        found = self.copied.get((level, at))
        return found if found is not None else self.base.levels[level][at * _HEX : (at + 1) * _HEX]


def _above(path: bytes, at: int, size: int) -> Iterator[tuple[bytes, bytes]]:
    """A path of siblings, as bytes, cut into (left, right) per level, of a node among size others."""
    begin = 0
    while size > 1:
        first = at - at % ARITY
        left, right = at - first, min(first + ARITY, size) - at - 1
        yield path[begin * 32 : (begin + left) * 32].hex().encode(), path[(begin + left) * 32 : (begin + left + right) * 32].hex().encode()
        begin, at, size = begin + left + right, at // ARITY, -(-size // ARITY)


def folded(digest: bytes, path: bytes, at: int, size: int) -> bytes:
    """The top that a node and its siblings up there give."""
    for left, right in _above(path, at, size):
        digest = joined_hash(left, digest, right)
    return digest


# --- places -------------------------------------------------------------------------------------


def placed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with ``pos``, from 0 in their order within a group (NULL is one), and the group's ``size``.

    Rows are sorted over all partitions by group and order; a partition's share of a group starts
    after those of the partitions before. Only counts per partition and group meet in a window.
    """
    names = rows.columns
    keys = [F.col(group).asc_nulls_first(), *order]
    sorted_rows = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    shares = sorted_rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    starts = shares.select(
        F.col(group).alias("_group"),
        F.col("_part").alias("_share"),
        (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_base"),
        F.sum("_n").over(whole).alias("size"),
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_share"))
    return sorted_rows.join(starts, same).select(*names, (F.col("_base") + F.col("_at")).alias("pos"), "size")


# --- storeys ------------------------------------------------------------------------------------

_NODES = "grp string, pos long, size long, digest binary"
_PATHS = "grp string, pos long, size long, digest binary, path binary, top binary"


def _in_blocks(nodes: DataFrame) -> DataFrame:
    block = F.floor(F.col("pos") / BLOCK).alias("_block")
    return nodes.select("*", block).repartition("grp", "_block").sortWithinPartitions("grp", "_block", "pos")


def _groups(batches: Batches) -> Iterator[list[dict]]:
    """Rows of one block at a time."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and key != (row["grp"], row["_block"]):
                yield rows
                rows = []
            key = row["grp"], row["_block"]
            rows.append(row)
    if rows:
        yield rows


def _block_of(rows: list[dict]) -> Block:
    nodes = b"".join(r["digest"] for r in rows).hex().encode()
    return Block(nodes, min(STOREY, rounds(rows[0]["size"])))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_NODE_SCHEMA = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])
_PATH_SCHEMA = pa.schema([*_NODE_SCHEMA, ("path", pa.binary()), ("top", pa.binary())])


def _tops(batches: Batches) -> Batches:
    out = []
    for rows in _groups(batches):
        top = bytes.fromhex(_block_of(rows).top.decode())
        out.append((rows[0]["grp"], rows[0]["_block"], -(-rows[0]["size"] // BLOCK), top))
        if len(out) >= _ROWS:
            yield _batch(out, _NODE_SCHEMA)
            out = []
    yield _batch(out, _NODE_SCHEMA)


def _with_tops(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes in blocks, each block led by the row of its top (pos -1)."""
    lead = tops.select("grp", F.col("pos").alias("_block"), F.lit(-1).cast("long").alias("pos"), F.col("size").alias("tops"), "path", "top")
    own = nodes.select("*", F.floor(F.col("pos") / BLOCK).alias("_block"))
    both = own.unionByName(lead, allowMissingColumns=True)
    return both.repartition("grp", "_block").sortWithinPartitions("grp", "_block", "pos")


def _blocks_with_tops(batches: Batches) -> Iterator[tuple[dict, list[dict]]]:
    for rows in _groups(batches):
        if len(rows) > 1:
            yield rows[0], rows[1:]


def _paths(batches: Batches) -> Batches:
    out = []
    for lead, rows in _blocks_with_tops(batches):
        block = _block_of(rows)
        for r in rows:
            own = b"".join(a + b for a, b in block.siblings(r["pos"] % BLOCK))
            out.append((r["grp"], r["pos"], r["size"], r["digest"], bytes.fromhex(own.decode()) + lead["path"], lead["top"]))
            if len(out) >= _ROWS:
                yield _batch(out, _PATH_SCHEMA)
                out = []
    yield _batch(out, _PATH_SCHEMA)


def block_tops(nodes: DataFrame) -> DataFrame:
    """The tops of a storey's blocks as nodes of the next storey (grp, pos, size, digest)."""
    return cut(map_batches(_in_blocks(nodes.select("grp", "pos", "size", "digest")), _tops, _NODES))


def tops_with_paths(nodes: DataFrame) -> DataFrame:
    """Tops of the blocks of nodes with the siblings above them, level by level, and their group's top."""
    tops = block_tops(nodes)
    if tops.where("size > 1").limit(1).count() == 0:
        return tops.select("*", F.lit(b"").alias("path"), F.col("digest").alias("top"))
    return with_paths(tops)


def with_paths(nodes: DataFrame) -> DataFrame:
    """nodes (grp, pos, size, digest) with the path of siblings up to the top of their group, and that top."""
    return map_batches(_with_tops(nodes, tops_with_paths(nodes)), _paths, _PATHS)


# --- documents ----------------------------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(values: list[bytes | None]) -> bytes:
    return hashlib.sha256(b"".join(map(field, values))).digest()


def _tampered(number: bytes | None) -> bool:
    return number is not None and zlib.crc32(number) % 5 == 0


_LEAVES = pa.schema([("doc_id", pa.int64()), ("grp", pa.string()), ("digest", pa.binary()), ("tampered", pa.binary()), ("nth", pa.int64())])


def _leaves(batches: Batches) -> Batches:
    for batch in batches:
        values = [raw_or_none(batch.column(c)) for c in ("number", *FIELDS[1:])]
        digests, changed = [], []
        for row in zip(*values):
            digests.append(_leaf(list(row)))
            text = row[-1]
            changed.append(_leaf([*row[:-1], text if text is None else text.lower()]) if _tampered(row[0]) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.array(digests, pa.binary()), pa.array(changed, pa.binary()), batch.column("nth")], schema=_LEAVES
        )


def raw_or_none(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; NULL stays."""
    return [x if known else None for x, known in zip(raw(column), column.is_valid().to_pylist())]


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, grp, digest, tampered, nth): the leaf of every row, and its leaf after tampering or NULL.

    Columns that docs lacks count as NULL. ``nth`` tells equal rows apart, which is which doesn't matter.
    """
    there = set(docs.columns)
    text = [(F.col(c) if c in there else F.lit(None)).cast("string").alias(c) for c in FIELDS[1:]]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").cast("string").alias("number"), *text, F.monotonically_increasing_id().alias("nth"))
    return map_batches(own, _leaves, "doc_id long, grp string, digest binary, tampered binary, nth long")


_PROVEN = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("position", pa.int64())]
    + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    + [("verified", pa.bool_()), ("copied", pa.list_(pa.struct([("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string())])))]
)


def _prove(copies: bool):
    """Per document its proof; a tampered leaf folds through a version of its block and on above it."""

    def run(batches: Batches) -> Batches:
        out = []
        for lead, rows in _blocks_with_tops(batches):
            block = _block_of(rows)
            above = lead["path"].hex().encode()
            to_subroot = lead["path"][: lead["inner"]]
            to_root = lead["path"][lead["inner"] :]
            root = lead["root"].hex()
            subroot = lead["top"].hex()
            for r in rows:
                at = r["pos"] % BLOCK
                proof = joined_hash(*(side for pair in block.siblings(at) for side in pair), above)
                copied = None
                if r["tampered"] is None:
                    top = block.top
                else:
                    version = block.version(at, r["tampered"].hex().encode())
                    top = version.top
                    if copies:
                        first = r["pos"] - at
                        copied = [{"level": n, "at": first // ARITY**n + i, "digest": d.decode()} for (n, i), d in version.copied.items()]
                inner = folded(top, to_subroot, lead["_block"], lead["tops"])
                fold = folded(inner, to_root, lead["source_pos"], lead["sources"]).decode()
                out.append((r["doc_id"], r["grp"], r["pos"], r["digest"].hex(), subroot, root, proof.decode(), fold, fold == root, copied))
                if len(out) >= _ROWS:
                    yield _batch(out, _PROVEN)
                    out = []
        yield _batch(out, _PROVEN)

    return run


def manifest(docs: DataFrame, copies: bool = False) -> DataFrame:
    """Every row of docs with its leaf, its source's subroot, the root, the digest of its proof and its folded root.

    (doc_id, source, position, leaf, subroot, root, proof_sha256, folded_root, verified, copied).
    ``copied`` lists, where asked for, the nodes of its block that a tampered leaf's version copies
    (level, place in the level of its source, digest); NULL for leaves that stay.

    NULL sources are one source and come first. Rows are ordered by doc_id, NULL first, then leaf;
    equal rows are a leaf each. A row without a doc_id is not tampered with. One row is its own
    subroot and root and has an empty proof; no rows give no rows. Other columns don't count.
    """
    found = cut(leaves(docs))
    nodes = placed(found, "grp", F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("nth")).drop("nth")
    tops = cut(tops_with_paths(nodes))
    one = tops.where("pos = 0").select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("source"), F.col("top").alias("digest"))
    sources = cut(placed(one, "grp", F.col("source").asc_nulls_first()))
    roots = with_paths(sources.select("grp", "pos", "size", "digest"))
    of_source = sources.select("pos", "source").join(
        roots.select("pos", F.col("size").alias("sources"), F.col("path").alias("outer"), F.col("top").alias("root")), "pos"
    )
    lead = tops.join(of_source.withColumnRenamed("pos", "source_pos"), F.col("grp").eqNullSafe(F.col("source"))).select(
        "grp",
        F.col("pos").alias("_block"),
        F.lit(-1).cast("long").alias("pos"),
        F.col("size").alias("tops"),
        F.length("path").alias("inner"),
        F.concat("path", "outer").alias("path"),
        "top",
        "source_pos",
        "sources",
        "root",
    )
    own = nodes.select("*", F.floor(F.col("pos") / BLOCK).alias("_block"))
    both = own.unionByName(lead, allowMissingColumns=True).repartition("grp", "_block").sortWithinPartitions("grp", "_block", "pos")
    schema = "doc_id long, source string, position long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<struct<level: int, at: long, digest: string>>"
    return map_batches(both, _prove(copies), schema)
