"""The Merkle manifest against a plain tree, on the given documents and on odd rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from sessionloom.llm import merkle
from sessionloom.llm.queries import QUERIES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The top of a level and, per node, its (left, right) siblings up to there."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for n, i in enumerate(at):
            run = i - i % 16
            paths[n].append((level[run:i], level[i + 1 : run + 16]))
        level = [sha(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], paths


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text). Per row what the manifest says of it."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    root, outer = climb([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, outer):
        subroot, paths = trees[s]
        for (_, _, own, r), path in zip(sorted(by_source[s], key=lambda x: x[:3]), paths):
            full = path + above
            fold = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                fold = leaf((*r[:4], r[4].translate(str.maketrans(UPPER, LOWER))))
            for left, right in full:
                fold = sha(*left, fold, *right)
            proof = sha(*(d for left, right in full for d in (*left, *right)))
            out.append((r[0], own, subroot, root, proof, fold, fold == root))
    return sorted(map(str, out))


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def shown(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.select(*COLUMNS).collect())


def test_query_against_a_plain_tree(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*merkle.FIELDS).collect()
    got = QUERIES["op13_merkle_manifest"](spark, folder)
    assert shown(got) == plain([tuple(r) for r in docs])
    assert {r.verified for r in got.collect()} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4097, 9000])
def test_sizes_around_runs_and_blocks(spark, n):
    rows = [(i, "s" if i % 3 else None, "en", i, f"Text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert shown(merkle.manifest(df)) == plain(rows)


def test_many_sources(spark):
    rows = [(i, f"source {i % 300} é", None, None, "Many") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert shown(merkle.manifest(df)) == plain(rows)


ODD = [
    (None, None, None, None, None), (None, "b", "en", 3, "No Id"), (None, "b", "en", 3, "No Id"), (1, "", None, 0, ""), (1, "", None, 0, ""),
    (1, "", "de", 2, "ÄÖ Zz"), (-5, "b", "en", None, "Neg"), (10, "-", "-", 1, "-"), (15, "b", "x" * 9, 7, "Long Text " * 400_000), (2**62, "b", "", 1, " \n"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, source string, lang string, n_chars long, text string")
    wide = df.selectExpr("*", "1 AS grp", "2 AS pos", "3 AS digest", "4 AS size", "5 AS _block", "6 AS nth", "7 AS path", "8 AS top")
    assert shown(merkle.manifest(wide)) == plain(ODD)
    assert merkle.manifest(df.where("doc_id = 77")).collect() == []


def test_versions_share_all_but_their_path():
    nodes = [hashlib.sha256(b"%d" % i).hexdigest().encode() for i in range(300)]
    block = merkle.Block(b"".join(nodes), 3)
    before = list(block.levels)
    version = block.version(77, b"f" * 64)
    changed = merkle.Block(b"".join([*nodes[:77], b"f" * 64, *nodes[78:]]), 3)
    assert version.top == changed.top != block.top
    assert set(version.copied) == {(0, 77), (1, 4), (2, 0), (3, 0)}
    for level, digests in enumerate(changed.levels):
        assert b"".join(version.node(level, i) for i in range(len(digests) // 64)) == digests
    assert block.levels == before


def test_copied_nodes_are_listed(spark):
    rows = [(i, "s", None, None, "Text") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = {r.doc_id: r for r in merkle.manifest(df, copies=True).collect()}
    hit = next(i for i in range(4200, 5000) if zlib.crc32(b"%d" % i) % 5 == 0)
    assert [(c.level, c["at"]) for c in got[hit].copied] == [(0, hit), (1, hit // 16), (2, hit // 256), (3, hit // 4096)]
    assert all((r.copied is None) == (zlib.crc32(b"%d" % i) % 5 != 0) for i, r in got.items())
