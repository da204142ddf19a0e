"""The operators' methods without Spark, against plain versions."""

import random
import re
import tempfile
import zlib
from collections import Counter
from math import comb

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, pre_tokenizers

from sessionloom.llm import bpe, chat, dac, decontaminate, html, quality, simhash, suffix, urls


@given(st.lists(st.integers(1, 3), max_size=60))
@settings(deadline=None, max_examples=60)
def test_fm_index_finds_every_occurrence(symbols):
    values = np.array(symbols, np.int64)
    order, _ = decontaminate.suffix_array(np.append(values, 0), 2)
    assert order.tolist() == sorted(range(len(symbols) + 1), key=lambda i: symbols[i:] + [0])
    index = decontaminate.FMIndex(values, 2, sample=4)
    phrases = np.array([[0, 1, 2], [1, 1, 1], [0, 0, 3], [2, 3, 1]])
    for phrase, low, high in zip(phrases, *index.search(phrases)):
        wanted = [x for x in phrase if x]
        places = [i for i in range(len(symbols)) if symbols[i : i + len(wanted)] == wanted]
        assert sorted(index.locate(np.arange(low, max(low, high)))) == places


@given(st.lists(st.text("abc", max_size=12), min_size=1, max_size=9))
@settings(deadline=None, max_examples=60)
def test_collection_transform(texts):
    strings = [t.encode() for t in texts]
    with tempfile.TemporaryDirectory() as folder:
        built = suffix.CollectionTransform(strings, folder)
    suffixes = sorted(([*s[i:], -1], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
    shown = np.concatenate(([-1], built.bytes))[built.transform]
    assert shown.tolist() == [strings[k][i - 1] if i else -1 for _, k, i in suffixes]
    common = [0]
    for (a, *_), (b, *_) in zip(suffixes, suffixes[1:]):
        common.append(next((n for n, (x, y) in enumerate(zip(a, b)) if x != y or x == -1), 0))
    assert built.common.tolist() == common


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    part = bytes(rng.randrange(97, 105) for _ in range(300))
    data = np.frombuffer(part * 4, np.uint8)
    hashes, places = suffix.anchors(data)
    assert (hashes[:300] == hashes[300:600]).all()
    assert (places[:300] - np.arange(300) == places[300:600] - np.arange(300, 600)).all()


def test_hot_anchors_lose_nothing(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = text(90)
    texts = [text(rng.randrange(40)) + line + (text(15) if i % 3 else "the same end of it") + text(200) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain, split = (
        sorted(map(str, suffix.without_repeats(docs, hot=hot, block=7).collect())) for hot in (1000, 1)
    )
    assert plain == split


def test_many_strings_under_one_anchor():
    rng = np.random.default_rng(6)
    pool = rng.integers(97, 123, 1 << 20, np.uint8)
    least = int(suffix._hashes(pool, suffix.K, 1).argmin())
    around = rng.integers(97, 123, (54_000, 152), np.uint8)
    anchor = np.tile(pool[least : least + suffix.K], (len(around), 1))
    strings = [x.tobytes() for x in np.hstack((around[:, :76], anchor, around[:, 76:]))]
    strings[-1] = strings[-2]
    assert sum(map(len, strings)) > 9_000_000
    found = suffix.shared_parts(strings, np.zeros(len(strings), np.int64), suffix.LENGTH, suffix.K)
    last = len(strings) - 1
    assert [x for x in found if x[0] >= last - 1] == [(last - 1, 0, 176), (last, 0, 176)]


def test_windows_of_hot_anchors_are_dealt_out(spark, monkeypatch):
    """No transform sees them, so its memory doesn't grow with a group."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = text(120)
    docs = spark.createDataFrame([(i, text(150) + line + text(150)) for i in range(40)], "doc_id long, text string")
    plain = sorted(map(str, suffix.without_repeats(docs, hot=1000).collect()))
    monkeypatch.setattr(suffix, "_cut_out", lambda batches: iter(()))
    assert sorted(map(str, suffix.without_repeats(docs, hot=1).collect())) == plain


@given(st.lists(st.sampled_from([0, 1, 255, 256, 50256, 70000, 2**24 + 5, 2**32 - 1]), max_size=700))
@settings(deadline=None, max_examples=30)
def test_codes_give_random_access(ids):
    documents = [np.array(ids, np.uint32), np.empty(0, np.uint32), np.array(ids[:3], np.uint32)]
    segment = dac.Segment(dac.encode_segment([5, 6, 7], documents))
    whole = np.concatenate(documents)
    places = np.random.default_rng(0).permutation(len(whole))
    assert (segment.access(places) == whole[places]).all()
    for k, document in enumerate(documents):
        assert np.concatenate([*segment.document(k, 64), np.empty(0, np.uint32)]).tolist() == document.tolist()


ODD_TEXTS = ["", " ", "a", " a  b", "\n a\n\nb", "don't  's 't", "a\x1c b\u3000 c ", "né e", "<|endoftext|> a", "b<|endoftext|>c  <|endoftext|>",
             "x.y, z. 1 2½ ²", "word " * 50 + "\n" * 9, "𝔘nïcode 😀😀 z" * 9]


def test_stretches_are_tokens_of_the_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encode = dac.Encoder(path)
    for text in ODD_TEXTS:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    for texts in (ODD_TEXTS, ODD_TEXTS[::-1] * 3, [], [""], [" a"], ["a b c", "c b. a"]):
        assert [x.tolist() for x in encode.many(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


@given(st.lists(st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "\t", "é", "23", ".", ",", "'ll", "<|endoftext|>", " word", "日本", "😀"]), max_size=9).map("".join), max_size=9))
@settings(deadline=None, max_examples=200)
def test_many_texts_at_once(texts):
    encode = dac.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [x.tobytes() for x in encode.many(texts)] == [encode(x) for x in texts]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 18])
def test_documents_read_at_once(monkeypatch, at_once):
    monkeypatch.setattr(dac, "READ_TOKENS", at_once)
    rng = np.random.default_rng(at_once)
    documents = [rng.integers(0, 60_000, int(n)).astype(np.uint32) for n in rng.choice([0, 1, 2, 9, 700], 60)]
    segment = dac.Segment(dac.encode_segment(list(range(60)), documents))
    assert dac._crcs(segment) == [zlib.crc32(d.astype("<u4").tobytes()) for d in documents]
    assert dac._crcs(dac.Segment(dac.encode_segment([], []))) == []


def test_files_of_other_tokenizers_are_refused(tmp_path):
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError, match="byte-level"):
        dac.Encoder(str(tmp_path / "other.json"))


def test_long_texts_are_cut_safely(monkeypatch):
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    for size in (1, 5, 1 << 18):
        for text in ODD_TEXTS:
            assert "".join(bpe.pieces(text, size)) == text
            assert [i for p in bpe.pieces(text, size) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_pivot_keys_keep_every_link():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 3), replace=False)) for _ in a], np.uint64)
    b = a ^ flips
    tables = simhash.pivot_table(a), simhash.pivot_table(b)
    assert (np.abs(tables[0].astype(int) - tables[1]) <= 2).all()
    shared = np.zeros(len(a), bool)
    for x, y in zip(*map(simhash._keys, tables)):
        shared |= x == y
    assert shared.all()


def test_fingerprint_against_counting():
    import xxhash

    for text in (b"", b"One", b"a b", b"A b\x0bc  d e", b"x y z " * 40):
        words = text.lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        wanted = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) == wanted


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


@given(st.text("ab \n\x0b\x1f#é", max_size=60))
@settings(deadline=None, max_examples=200)
def test_measures(text):
    assert quality.measure(text)[:6] == brute_measures(text)


def test_exact_binomial_bound():
    below = lambda k, n, p: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n in ((0, 10), (3, 50), (7, 400)):
        bound = quality.upper_bound(k, n, 0.05)
        assert abs(below(k, n, bound) - 0.05) < 1e-9
    assert quality.upper_bound(5, 5, 0.05) == 1.0
    assert quality.certify({}, 0.02, 0.05) is None
    assert quality.certify({0: 500}, 0.02, 0.05) == 0
    assert quality.certify({0: 400, 3: 100}, 0.02, 0.05) == 3


def test_languages_without_labels_have_no_cutoffs(spark):
    plain, shouted = (" ".join(f"{w}{i}" for i in range(60)) for w in "wW")
    made = [(i, "xx", shouted if i % 2 else plain) for i in range(880)] + [(10_000 + i, "yy", shouted) for i in range(9)]
    docs = spark.createDataFrame(made, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(d, int(t is plain)) for d, lang, t in made if lang == "xx"], "doc_id long, quality int")
    kept = {(r.lang, r.kept): r["count"] for r in quality.judge(docs, labels).groupBy("lang", "kept").count().collect()}
    assert kept == {("xx", True): 440, ("xx", False): 440, ("yy", True): 9}


def test_each_language_is_certified_alone(spark):
    """A language whose labels are too few for the bound keeps the base rules only, whatever others have."""
    plain, shouted = (" ".join(f"{w}{i}" for i in range(60)) for w in "wW")
    sizes = {"xx": 2000, "yy": 300, "zz": 40}
    made = [(n * 10_000 + i, lang, shouted if i % 4 == 0 else plain) for n, (lang, size) in enumerate(sizes.items()) for i in range(size)]
    docs = spark.createDataFrame(made, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(d, int(t is plain)) for d, _, t in made], "doc_id long, quality int")
    limits = quality.cutoffs(quality.measures(docs), labels)
    assert set(limits) == {"xx"}
    kept = {(r.lang, r.kept): r["count"] for r in quality.judge(docs, labels).groupBy("lang", "kept").count().collect()}
    assert kept == {("xx", True): 1500, ("xx", False): 500, ("yy", True): 300, ("zz", True): 40}


PIECES = ["<", "s", ">", "\\", "/", "[", "INST", "]", " ", "ROLE", "\n", "<SYS>>"]


@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join),
       st.sampled_from(["user", "assistant", "system", "tool", "a] b%5D", ""]))
@settings(deadline=None, max_examples=300)
def test_formatted_turns_read_back(text, role):
    turn, begin, end = chat.format_turn(role, text)
    assert chat.parse_all(turn * 2) == [(role, text)] * 2
    assert chat.unescape(turn[begin:end]) == text
    assert not any(x in turn[begin:end] for x in chat.CONTROL)


def test_chat_grammar_rejects_other_texts():
    for bad in ("x", "<s>[INST] a", "[ROLE tool", "<s>[INST] <s> [/INST]", " a"):
        with pytest.raises(ValueError):
            chat.parse_all(bad)


PAGE = """<html><head><title>No</title><script>x="<p>";</script></head><body><header>Site</header>
<nav><ul><li><a href=/a>Menu one</a></li><li><a href=/b>Menu two</a></li></ul></nav>{open}<h1>Head &amp; line</h1>
<p>First <b>bold</b>   words of it.<p>Second&nbsp;part <a href=x>with a link</a> in the middle.<div class="ad-box">Buy now</div>
<ul><li>One item in the text</li></ul><p>Last words</p><section class="comments"><p>I disagree</p></section>{close}
<aside>Aside text</aside><div id="cookie-notice">We use cookies</div><form>Name <input></form><footer>&copy; me</footer></body></html>"""


def test_main_text():
    counted = sum((html.counts(PAGE.format(open="<article>", close="</article>")) for _ in range(20)), Counter())
    score = html.weights(counted)
    assert score["#text"] > 0 and all(v < 0 for k, v in score.items() if k != "#text")
    wanted = "Head & line First bold words of it. Second part with a link in the middle. One item in the text Last words"
    for a, b in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>")):
        assert html.main_text(PAGE.format(open=a, close=b), score) == wanted
    for page in ("", "<", "<p", "<!-- x", "<p>&lt;tag&gt;", "text only", "<nav>menu"):
        assert isinstance(html.main_text(page, score), str)
    assert html.main_text("<p>&lt;tag&gt;</p>", score) == "<tag>"


def test_what_is_hidden_or_beside():
    def shown(page):
        return " ".join(" ".join(t for k, t, beside, _ in html.tokens(page) if k == "#text" and not beside).split())

    for attrs in (' data-title="The Hidden Cost"', ' title="a hidden gem"', ' class="x hidden md:block"', ' data-id="comments"', ' title="display: none"', ' style="--display: none-such"', " aria-hidden=false"):
        assert shown(f"<div>a <a{attrs}>b</a> c</div>") == "a b c"
        assert shown(f"<article{attrs}><p{attrs}>a</p></article>") == "a"
    for attrs in (" hidden", " HIDDEN=''", " hidden class=x", ' style="color: red; Display : none"', " aria-hidden='true'", ' class="x advert"'):
        assert shown(f"<div>a <a{attrs}>b</a> c</div>") == "a c"
        assert shown(f"<div{attrs}><p>b</p></div><p>c") == "c"
        page = f"<article{attrs}>a <p{attrs}>b<p>c <p{attrs}>b</p>d <p{attrs}>b<div>e </div>f </article>g"
        assert shown(page) == "a c d e f g"
        assert shown(f"<ul><li>a <li{attrs}>b<ul><li>b</li></ul>b</li><li>c <p{attrs}>b</li>d <li{attrs}>b</ul>e") == "a c d e"
        assert shown(f"<table><tr><td{attrs}>b<td>a <tr{attrs}><td>b</td><tr><td>c </table>d") == "a c d"


def test_names_inside_content_cut_nothing_of_it():
    """Anchors, compound names and names on tables, quotes and words are no sign of something beside the content."""
    score = html.weights(Counter())
    for piece in (
        '<section id="discussion"><p>b</p></section>', '<h2 id="search">b</h2>', '<ul><li class="related-work">b</li></ul>', '<p><span class="share">b</span></p>',
        '<div class="share-price">b</div>', "<p><math><mi>b</mi></math></p>", '<div class="post social-science">b</div>', '<table class="widget"><tr><td>b</td></tr></table>',
        '<blockquote id="reply">b</blockquote>', '<p id="notice">b</p>',
    ):
        assert html.main_text(f"<article><p>a</p>{piece}<p>c</p></article>", score) == "a b c"
    for piece in (
        '<div class="share-buttons">b</div>', '<ul class="related-posts"><li>b</li></ul>', '<div class="comments">b</div>', '<section id="comments">b</section>', '<div class="google-ad x">b</div>',
        '<div class="shareBox">b</div>', '<p class="notice">b</p>', '<aside>b</aside>', '<nav>b</nav>', '<form>b</form>', '<div role="search">b</div>', '<div id="cookie-notice">b</div>',
    ):
        assert html.main_text(f"<article><p>a</p>{piece}<p>c</p></article>", score) == "a c"


@pytest.fixture(scope="module")
def some_pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id")


def stripped(page):
    """The page of div elements without names."""
    page = re.sub(r"<(/?)(?:nav|footer|article|header|aside)\b[^>]*>", r"<\1div>", page)
    return re.sub(r' (?:class|id|role)="[^"]*"', "", page)


def test_the_run_finds_content_without_markup(spark, some_pages):
    """Held-out pages with sectioning elements and names taken out: the run decides, and finds the same text in over 95 % of them."""
    score = html.learn(some_pages.where("page_id % 2 = 0"))
    held = [r.html for r in some_pages.where("page_id % 2 = 1").collect()]
    wanted = [html.main_text(x, score) for x in held]
    found = [html.main_text(stripped(x), score) for x in held]
    everything = [html.main_text(stripped(x), dict.fromkeys(score, 0.0) | {"#text": 1e6}) for x in held]
    assert sum(a == b for a, b in zip(wanted, found)) >= 0.95 * len(held)
    assert sum(a == b for a, b in zip(wanted, everything)) <= 0.05 * len(held)


def test_only_labelled_pages_teach(spark, some_pages):
    """Many pages without labels take no part, and a bound below the number of labelled pages draws some of them."""
    plain = some_pages.selectExpr("-page_id - 1 AS page_id", "url", "'<div>no label at all</div>' AS html").crossJoin(spark.range(20)).drop("id")
    assert html.learn(some_pages.unionByName(plain)) == html.learn(some_pages)
    assert set(html.learn(some_pages, 100)) == set(html.learn(some_pages))
    assert html.learn(plain)["#text"] == html.weights({})["#text"]


@given(st.lists(st.integers(-4, 4).map(float), max_size=12))
def test_best_run(scores):
    start, end = html.best_run(scores)
    best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert sum(scores[start:end]) == best


def test_segmentation_is_the_most_probable():
    counts = {"good": 30, "news": 30, "goodnews": 1, "daily": 3, "s": 50}
    assert urls.segment("goodnewsdaily", counts, 100) == ["good", "news", "daily"]
    assert urls.segment("goodxyz", counts, 100) == ["good", "xyz"]
    assert urls.segment("", counts, 0) == []
