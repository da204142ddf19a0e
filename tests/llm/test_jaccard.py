"""The n-gram join against all pairs, on the given documents, on crowded keys and on odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.llm import jaccard
from sessionloom.llm.queries import QUERIES
from tests.llm.test_operators import ODD, reachable


def shingles(text, width=4):
    words = [w for w in re.split(r"[ \t-\r]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def plain(texts, percent=85, width=4):
    """texts: id -> text. id -> (shingles, smallest id in reach)."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    own = sorted(i for i in sets if sets[i])
    links = [(i, i) for i in own]
    for n, a in enumerate(own):
        for b in own[n + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
    roots = reachable(links)
    return {i: (len(sets[i]), roots.get(i, i)) for i in sets}


def shown(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_query_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert shown(QUERIES["op12_jaccard_join"](spark, folder)) == plain({r.doc_id: r.text for r in docs})


def altered(rng, words, times):
    out = list(words)
    for _ in range(times):
        at = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                out[at] = f"new{rng.randrange(10**6)}"
            case 1:
                out.insert(at, f"more{rng.randrange(10**6)}")
            case _:
                del out[at]
    return out


def family(rng, n, size, times):
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    return [" ".join(altered(rng, base, rng.randrange(times + 1))) for _ in range(n)]


def mixed_texts(seed):
    """Families of near copies around the limit, texts of one template, chains, short and unrelated texts."""
    rng = random.Random(seed)
    out = []
    for size, times in ((8, 1), (15, 1), (40, 2), (80, 4), (300, 14), (1500, 60)):
        out += family(rng, 25, size, times)
    template = " ".join(f"t{i}" for i in range(60))
    out += [f"{template} " + " ".join(f"u{rng.randrange(10**5)}" for _ in range(rng.randrange(5, 80))) for _ in range(60)]
    chain = [f"c{i}" for i in range(200)]
    for _ in range(30):
        chain = altered(rng, chain, 3)
        out.append(" ".join(chain))
    out += [" ".join(f"x{rng.randrange(300)}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    out += out[:40]
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("seed", [2])
def test_mixed_texts(spark, seed):
    texts = mixed_texts(seed)
    want = plain(texts)
    assert 50 < sum(c != i for i, (_, c) in want.items()) < len(texts)
    assert shown(jaccard.similar_documents(table(spark, texts))) == want


@pytest.mark.parametrize("bound", [0, 40, 10**6])
def test_every_boundary_gives_the_same(spark, monkeypatch, bound):
    texts = {i: t for i, t in mixed_texts(3).items() if len(t.split()) < 200}
    monkeypatch.setattr(jaccard, "boundary", lambda *_: bound)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "STAR", 3)
    monkeypatch.setattr(jaccard, "CELL_BITS", 8)
    assert shown(jaccard.similar_documents(table(spark, texts))) == plain(texts)


def test_other_widths_and_percentages(spark):
    texts = {i: t for i, t in mixed_texts(4).items() if len(t.split()) < 100}
    assert shown(jaccard.similar_documents(table(spark, texts), 2, 60)) == plain(texts, 60, 2)
    assert shown(jaccard.similar_documents(table(spark, texts), 1, 100)) == plain(texts, 100, 1)


def test_odd_rows(spark):
    wide = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS sid", "2 AS n", "3 AS key", "4 AS a", "5 AS s0", "6 AS first_id")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_documents(wide).collect())
    want = plain({i: t for i, t in ODD if i is not None})
    assert got == sorted([("None", 1, "None"), *((str(i), n, str(c)) for i, (n, c) in want.items())])
    assert jaccard.similar_documents(wide.where("doc_id = 77")).collect() == []
    assert shown(jaccard.similar_documents(table(spark, {1: "", 2: None, 3: " \n"}))) == {i: (0, i) for i in (1, 2, 3)}


def test_rows_that_share_an_id(spark):
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, same), (1, "another text altogether here"), (1, same), (None, same), (2, same)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 1, "1"), ("1", 9, "None"), ("2", 9, "None"), ("None", 9, "None")]


@pytest.mark.parametrize("k", [1, 2])
@pytest.mark.parametrize("percent", [60, 85, 95])
def test_prefixes_share_enough(k, percent):
    rng = np.random.default_rng(k * percent)
    for _ in range(300):
        n = int(rng.integers(6, 120))
        x = np.unique(rng.integers(0, 10**6, n))
        y = np.union1d(rng.choice(x, len(x) - int(rng.integers(0, 1 + len(x) * (100 - percent) // 100)), replace=False), rng.integers(0, 10**6, int(rng.integers(0, 4))))
        if len(x) != len(y) or (x != y).any():
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both) and min(jaccard.least_overlap(len(x), percent), jaccard.least_overlap(len(y), percent)) >= k:
                a, b = (set(z[: jaccard.prefix_length(len(z), k, percent)].tolist()) for z in (x, y))
                assert len(a & b) >= k


def test_shingles_of_many_texts():
    rng = random.Random(6)
    texts = ["", " ", *(" ".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(200)), "a b c", "A  b\tc", "d"]
    elements, ends = jaccard.Shingler(4, 0)([t.encode() for t in texts])
    sets = [frozenset(x.tolist()) for x in np.split(elements, ends[:-1])]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts] == np.diff(ends, prepend=0).tolist()
    same = {}
    for t, s in zip(texts, sets):
        assert same.setdefault(frozenset(shingles(t)), s) == s
    assert len(set(same.values())) == len(same)


def test_bitmaps_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 2**63, int(rng.integers(0, 900)), dtype=np.uint64)) for _ in range(2))
        z = np.union1d(rng.choice(x, len(x) // 2, replace=False) if len(x) else x, y)
        maps = jaccard.bitmaps(np.concatenate((x, z)), np.array([len(x), len(x) + len(z)])).view(np.uint64)
        apart = int(np.bitwise_count(maps[0] ^ maps[1]).sum())
        assert apart <= len(np.setxor1d(x, z))


def test_heavy_elements_come_last(spark):
    texts = [f"all these common words stand here and then {i} ends" for i in range(40)]
    docs = table(spark, dict(enumerate(texts)))
    order, met = jaccard.order_of(docs, 40 * 7, 4, 0)
    elements = [jaccard.Shingler(4, 0).one(t.encode()) for t in texts]
    common = set.intersection(*(set(e.tolist()) for e in elements))
    for e in elements:
        first = order.sorted(e, np.array([len(e)])).tolist()
        assert set(first[-len(common) :]) == common and met == 0
    assert set(order.cells.tolist()) == {0, 5}


def test_boundary_is_the_cheapest():
    sizes = {s: 1000 // s + 1 for s in range(1, 400)}

    def cost(bound, met):
        small = sum(c * jaccard.prefix_length(s, 2, 85) * (jaccard.prefix_length(s, 2, 85) - 1) / 2 for s, c in sizes.items() if s < bound and not jaccard.alone(s, 85))
        large = sum(c * jaccard.prefix_length(s, jaccard.SHARED, 85) * (1 + jaccard.SCAN_COST * met) for s, c in sizes.items() if s >= jaccard.least_overlap(bound, 85) and not jaccard.alone(s, 85))
        return small + large

    bounds = []
    for met in (0, 50, 1000, 10**6):
        bounds.append(jaccard.boundary(sizes, met, 85))
        assert cost(bounds[-1], met) == pytest.approx(min(cost(b, met) for b in [*range(6, 400), 1000]))
    assert bounds == sorted(bounds) and bounds[0] < bounds[-1]


def test_a_family_gives_few_pairs(spark, monkeypatch):
    """Near copies of one text, most of them too far from the first star's centre, are not all paired with each other."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = {i: " ".join(altered(rng, base, rng.randrange(1, 4))) for i in range(300)}
    rows, plain_map = [], jaccard.map_batches

    def counted(df, fn, schema):
        out = plain_map(df, fn, schema)
        if "need" in schema:
            rows.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "map_batches", counted)
    assert shown(jaccard.similar_documents(table(spark, texts))) == plain(texts)
    assert sum(rows) < 2 * len(texts)


@pytest.mark.parametrize("carried", [1, 3])
def test_pairs_at_the_first_key_that_both_carry(spark, monkeypatch, carried):
    texts = {i: t for i, t in mixed_texts(5).items() if len(t.split()) < 400}
    monkeypatch.setattr(jaccard, "CARRIED", carried)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "_middle_stars", lambda members, _: members.selectExpr("sid AS a", "sid AS b").limit(0))
    assert shown(jaccard.similar_documents(table(spark, texts))) == plain(texts)


def test_pairs_of_a_key_by_hand():
    """Two sets that share keys 5, 7, 8 and 9 are one row where all are carried, else one at each key; too few keys are left to the count."""

    def rows(keys, *lists):
        fields = {"key": [], "sid": [], "carried": []}
        for k in keys:
            for sid, own in enumerate(lists):
                fields["key"].append(k), fields["sid"].append(sid), fields["carried"].append(own)
        n = len(fields["key"])
        rest = {"_i": [0] * n, "_j": [0] * n, "_block": [0] * n, "comp": fields["sid"], "n": [100] * n, **{f"s{i}": [0] * n for i in range(jaccard.WORDS)}}
        made = jaccard._block_pairs(85, 0)(iter([pa.RecordBatch.from_pydict(fields | rest)]))
        return [tuple(r.values()) for batch in made for r in batch.to_pylist()]

    assert rows([5, 7, 8, 9], [5, 7, 8, 9], [4, 5, 7, 8, 9]) == [(0, 1, 4, 4)]
    assert rows([5, 7, 8, 9], [5, 7, 8], [4, 5, 7, 8]) == [(0, 1, 1, 4)] * 4
    assert rows([5, 7], [5, 6, 7], [5, 7]) == [(0, 1, 1, 4)] * 2
