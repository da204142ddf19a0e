"""Main text of web pages by the maximum-scoring run of words and tags.

A page is a sequence of words and tags. Words have a positive score, tags negative ones; the
contiguous run with the largest sum, found in one linear scan, is the content region. What is never
shown as running text (scripts, forms, menus) and what its names call a notice, an advert, comments
and the like counts nothing and goes.

The scores are learned from labelled pages: those whose own markup names the content (article, main,
or itemprop="articleBody"). A tag's score is the log of how much likelier it is inside than outside.
The word's score decides how many words outweigh a tag between them and the rest, so it is chosen
by what it does: the labelled pages are stripped of all names and sectioning elements, and of
WORD_SCORES the one holds whose runs agree best with the labelled content (the largest of equals).
Pages without such markup are scored by the same weights.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Batches, cut, map_batches, slices

#: Labelled pages that the scores are learned from, about: a documented bound, drawn by a hash.
TRAINING_PAGES = 2000
BATCH_BYTES = 8 << 20
#: The least score of a tag: a list or table in the content of a page unlike the labelled ones keeps a chance.
LEAST = -2.0
#: The smallest penalty of a tag.
NEARLY_NONE = -0.001

# Elements of HTML by their role.
RAW_TEXT = ("script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
LEFT_OUT = frozenset("head nav footer aside form menu dialog button select option svg object audio video canvas template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Closed by the next of its kind or by its parent, so kept on the stack only where left out.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option".split()) | INLINE | VOID
#: Sectioning elements, which a page made of div elements alone has not.
SECTIONS = frozenset("article aside footer header main nav section".split())
#: Words in class, id and role that name something beside the content, wherever they are.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie "
    "cookies consent disqus gdpr masthead menubar nav navbar navigation newsletter outbrain pager pagination paywall popup sidebar "
    "signup sponsored subscribe subscription taboola toolbar topbar".split()
)
#: Words that do so only as a whole name, or with words of LAYOUT: class="share-buttons", not class="share-price".
MAYBE_BESIDE = frozenset(
    "discussion footer header menu modal notice notices notification promo promoted promotion recommended related replies reply response "
    "responses search share sharing skip social sponsor teaser widget widgets".split()
)
LAYOUT = frozenset(
    "area articles bar block bottom box btn button buttons column container content desktop form group icons inner item items left link "
    "links list main mobile module outer overlay page panel post posts right row section site slot stories top wrap wrapper".split()
)
#: Elements that such a name can stand on: others hold content of their own (<table class="widget">, <span class="share">).
BOXES = frozenset("aside dd div dl li ol p section ul".split())
CONTENT = frozenset(("article", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW_TEXT) + r")\b(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?|"[^"]*"|'[^']*'""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.IGNORECASE)
#: Elements without an end tag of their own end where one of these starts or ends: (what ends, how far up it is looked for).
_LISTS, _TABLE = frozenset(("ul", "ol", "menu", "dir", "table")), frozenset(("table",))
_CELLS = frozenset(("td", "th"))
_ROWS = _CELLS | frozenset(("tr", "thead", "tbody", "tfoot"))
_ENDS = {
    "li": (frozenset(("li",)), _LISTS), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (_CELLS, _TABLE), "th": (_CELLS, _TABLE), "tr": (_CELLS | {"tr"}, _TABLE), "thead": (_ROWS, _TABLE), "tbody": (_ROWS, _TABLE), "tfoot": (_ROWS, _TABLE),
}
#: Starts that end a paragraph.
_P_ENDS = frozenset(_ENDS) | frozenset(
    "address article aside blockquote caption center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_P = frozenset(("p",)), frozenset(("button", "table", "object", "template"))

#: kind, text, left out (NAMED: only for its name or its sectioning element), in labelled content
Token = tuple[str, str, int, bool]
NAMED, HARD = 1, 2


def _attributes(attrs: str) -> dict[str, str]:
    """Values by lowercase name; the first of a repeated name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        if m[1]:
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _names(attributes: dict[str, str]) -> set[str]:
    return {w.lower() for k in ("class", "id", "role", "itemprop") if k in attributes for w in re.split(r"[\s_-]+|(?<=[a-z])(?=[A-Z])", attributes[k])}


def _named_beside(tag: str, attributes: dict[str, str], content: bool) -> bool:
    """Do class, id or role name the element as something beside the content?

    An id is also an anchor (<section id="discussion">), so a word of MAYBE_BESIDE counts there
    only on boxes other than sections, outside labelled content.
    """
    for key in ("class", "role", "id"):
        for name in attributes.get(key, "").split():
            words = {w.lower() for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if w and not w.isdigit()}
            if words & BESIDE:
                return True
            maybe = words & (MAYBE_BESIDE - {"header"} if content else MAYBE_BESIDE)
            if maybe and words <= MAYBE_BESIDE | LAYOUT and tag in BOXES and (key != "id" or not content and tag != "section"):
                return True
    return False


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NOT_SHOWN.search(attributes.get("style", "")))


def _end(stack: list[tuple[str, int, bool]], kinds: frozenset, bounds: frozenset) -> None:
    """Ends the open elements of these kinds, and what is open in them, up to the innermost of bounds."""
    lowest = None
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in bounds:
            break
        if stack[i][0] in kinds:
            lowest = i
    if lowest is not None:
        del stack[lowest:]


def tokens(page: str) -> list[Token]:
    """The page's tags and stretches of text in order.

    The kind is "#text" or the tag's name ("/p" if it closes). Open elements are kept on a stack
    only where they enclose blocks or are left out, so unclosed paragraphs and inline tags do no
    harm; a paragraph, item or cell that is left out ends where HTML implies it. A closing tag
    without its opening one is passed over.
    """
    out: list[Token] = []
    stack: list[tuple[str, int, bool]] = []
    for m in _TOKEN.finditer(page):
        name = (m["tag"] or m["tag2"] or "").lower()
        beside, content = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        if not name:
            if m["raw"]:
                out.append((m["raw"].lower(), "", HARD, content))
            elif m[0][:2] not in ("<!", "<?"):
                out.append(("#text", m[0], beside, content))
            continue
        if m["close"] or m["close2"]:
            if name in _ENDS:
                _end(stack, *_P)
                _end(stack, *_ENDS[name])
            else:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    del stack[depth:]
            out.append(("/" + name, "", beside, content))
            continue
        if stack and name in _P_ENDS:
            _end(stack, *_P)
            if name in _ENDS:
                _end(stack, *_ENDS[name])
            beside, content = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        attributes = _attributes(m["attrs"] or "")
        named = _names(attributes)
        if name not in VOID:
            labelled = content or name in CONTENT or "articlebody" in named or {"article", "body"} <= named and name in ("div", "section")
            kept = name in ("body", "html") or name in CONTENT
            outside = 0
            if name in LEFT_OUT - SECTIONS or not kept and _hidden(attributes):
                outside = HARD
            elif name in LEFT_OUT or (name == "header" and not content) or not kept and _named_beside(name, attributes, content):
                outside = NAMED
            if name not in LOOSE or outside:
                if name == "body" and stack:
                    stack = [x for x in stack if x[0] != "head"]
                    beside = stack[-1][1] if stack else 0
                stack.append((name, max(beside, outside), labelled))
            beside = max(beside, outside)
        out.append((name, "", beside, content))
    return out


def bare(kind: str) -> str:
    """The kind of a tag on a page without sectioning elements."""
    name = kind.lstrip("/")
    return kind[: len(kind) - len(name)] + "div" if name in SECTIONS else kind


def counts(page: str) -> Counter:
    """(kind, inside the labelled content?) of a labelled page's words and tags; others have none.

    Sectioning elements count as div, too, which stands for them on other pages.
    """
    seen = tokens(page)
    if not any(x[3] for x in seen):
        return Counter()
    out: Counter = Counter()
    for kind, text, beside, content in seen:
        out[kind, content and not beside] += len(text.split()) if kind == "#text" else 1
        if bare(kind) != kind:
            out[bare(kind), content and not beside] += 1
    return out


#: Candidates for the word's score.
WORD_SCORES = tuple(0.025 * 2**i for i in range(8))


def weights(seen: dict[tuple[str, bool], int], word: float | None = None) -> dict[str, float]:
    """Score of a word and of each tag: words positive, tags negative, both at least a little.

    A kind's score is the log-ratio of its smoothed shares inside and outside the content; the
    word's is the given one.
    """
    kinds = {k for k, _ in seen} | {"#text"}
    inside = sum(seen.get((k, True), 0) for k in kinds) + len(kinds)
    outside = sum(seen.get((k, False), 0) for k in kinds) + len(kinds)
    score = {k: math.log((seen.get((k, True), 0) + 1) / inside) - math.log((seen.get((k, False), 0) + 1) / outside) for k in kinds}
    out = {k: max(LEAST, min(v, NEARLY_NONE)) for k, v in score.items()}
    out["#text"] = max(score["#text"], 0.25) if word is None else word
    return out


#: The score of a tag that no labelled page has.
UNSEEN = -0.5


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run [start, end) of the largest positive sum, the first and longest of equals."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0 and x > 0 and total + x <= x:
            total, start = 0.0, i
        total += x
        if total > best or total == best and found[0] == start and best > 0:
            best, found = total, (start, i + 1)
    return found


def _words(text: str) -> int:
    return len(html.unescape(text).split()) if "&" in text else len(text.split())


def region(seen: list[Token], score: dict[str, float], by_names: bool = True) -> tuple[int, int]:
    """The best run of a page's tokens; without by_names as if it had neither names nor sectioning elements.

    By names, tags within labelled content have the smallest penalty: a list there is the content's.
    """
    scores = []
    for kind, text, beside, content in seen:
        if beside == HARD or beside and by_names:
            scores.append(0.0)  # what is left out doesn't part the rest
        elif kind == "#text":
            scores.append(_words(text) * score["#text"])
        elif content and by_names:
            scores.append(NEARLY_NONE)
        else:
            scores.append(score.get(kind if by_names else bare(kind), UNSEEN))
    return best_run(scores)


def agreement(page: str, score: dict[str, float]) -> float | None:
    """F1 over words of the run without names against the labelled content; None if nothing is labelled."""
    seen = tokens(page)
    sizes = [_words(text) if kind == "#text" and beside != HARD else 0 for kind, text, beside, _ in seen]
    wanted = [n if content and not beside else 0 for n, (_, _, beside, content) in zip(sizes, seen)]
    if not any(wanted):
        return None
    start, end = region(seen, score, by_names=False)
    return 2 * sum(wanted[start:end]) / (sum(sizes[start:end]) + sum(wanted))


def main_text(page: str, score: dict[str, float]) -> str:
    """The words of the best run, blocks joined by one space; empty if nothing scores."""
    seen = tokens(page)
    start, end = region(seen, score)
    blocks, block = [], []
    for kind, text, beside, _ in seen[start:end]:
        if kind == "#text":
            if not beside:
                block.append(text)
        elif kind.lstrip("/") not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


#: Kinds of tokens that have a score of their own: elements of HTML by form, some thousand at most are in use.
_KIND = re.compile(r"#text|/?(?:[a-z]{1,10}|h[1-6])")
#: Marks that a page may label its content with, as a cheap test before it is drawn.
_LABELLED = r"(?i)<(article|main)[\s>/]|article-?_?body"


def learn(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> dict[str, float]:
    """Scores from about training_pages labelled pages, drawn by a hash of url and page.

    Labelled pages are counted first, so the bound is on them, not on all pages. Only sums for each
    kind of tag and each of WORD_SCORES come to the driver; the drawn pages bound the kinds.
    """
    labelled = pages.where(F.col("html").rlike(_LABELLED))
    total = labelled.count()
    drawn = labelled
    if total > training_pages:
        bound = int(-(2**63) + training_pages / total * 2**64)
        drawn = labelled.where(F.xxhash64("page_id", "url") < F.lit(bound))

    def count(batches: Batches) -> Batches:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                seen.update({k: n for k, n in counts(page or "").items() if _KIND.fullmatch(k[0])})
        rows = sorted(seen.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())],
            ["kind", "inside", "n"],
        )

    drawn = cut(drawn.select("html"))
    sums = map_batches(drawn, count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    seen = {(r.kind, r.inside): r.n for r in sums.collect()}
    candidates = [weights(seen, w) for w in WORD_SCORES]

    def agree(batches: Batches) -> Batches:
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found = [agreement(page or "", score) for score in candidates]
                if found[0] is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([round(x * 1e6) for x in found], pa.int64())], ["i", "f"])

    sums = map_batches(drawn, agree, "i int, f long").groupBy("i").agg(F.sum("f").alias("f")).collect()
    if not sums:
        return weights(seen)
    best = max(r.f for r in sums)
    return candidates[max(r.i for r in sums if r.f == best)]


def extract(pages: DataFrame, score: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every page; scores are learned from the pages if not given.

    NULL and empty pages have an empty text. Repeated pages give repeated rows, NULL ids and
    urls stay NULL. A page cut off in the middle of a tag or of its content gives what there is.
    Without any labelled page the words' least score and UNSEEN hold.
    """
    score = learn(pages) if score is None else score

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for batch in slices(whole, "html", BATCH_BYTES):
                texts = [main_text(x, score) if x else "" for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_batches(own, run, "page_id long, url string, text string, n_chars long")
