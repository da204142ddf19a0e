"""URL verdicts: rules first, else naive Bayes over words that host names are segmented into.

Host labels are concatenated words ("goodnewsdaily"). A unigram model, counted over all words of
the pages' texts, splits each label by Viterbi: the split with the largest product of word
probabilities, unknown strings paying for every character. A multinomial naive Bayes model, counted
over all pages that a rule decides, scores the words of host and path; its features are hashed to
a fixed number of slots, which bounds what the driver and each task hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Batches, cut, map_batches

#: (host, path, verdict): a rule fits the host and its subdomains where the path begins with its path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Letters of the longest word: a domain label has at most 63 characters, so no word in one is longer.
MAX_WORD = 63
#: Parts that the pages of one host are dealt to.
SALTS = 32
#: Slots that features of host and path are hashed to.
SLOTS = 1 << 16
#: Different words that a task counts before it hands its sums on.
FLUSH_WORDS = 200_000


def host(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"(?s)^([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(_after(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)


def _fits(at_host: Column, at_path: Column, rule_host: str, rule_path: str) -> Column:
    return ((at_host == rule_host) | at_host.endswith("." + rule_host)) & at_path.startswith(rule_path)


def rule_of(at_host: Column, at_path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path joined; the first of equals) and its verdict, else NULLs."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = _fits(at_host, at_path, rule_host, rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


_TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]*;?", re.DOTALL | re.IGNORECASE)
_WORDS = re.compile(r"[^\W\d_]+")


def _count_words(batches: Batches) -> Batches:
    """Partial counts; a word may come more than once."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            if page:
                seen.update(w for w in _WORDS.findall(_TAGS.sub(" ", page).lower()) if len(w) <= MAX_WORD)
                if len(seen) >= FLUSH_WORDS:
                    yield rows(seen)
                    seen = Counter()
    yield rows(seen)


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): how often each word of at most MAX_WORD letters is in the pages' texts."""
    return map_batches(pages.select("html"), _count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment(label: str, counts: dict[str, int], total: int) -> list[str]:
    """Viterbi: the most probable split of a label into words.

    A word that was counted n times has the probability n / total; any other string of k characters
    1 / (total * 10**k), so known words win and unknown stretches stay whole. Of equals the one
    with the longer last word.
    """
    log_total = math.log(max(total, 1) + 1)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        found = (-math.inf, 0)
        for start in range(max(0, end - MAX_WORD), end):
            n = counts.get(label[start:end], 0)
            score = math.log(n) - log_total if n else -log_total - 2.302585 * (end - start)
            score += best[start][0]
            if score > found[0]:
                found = (score, start)
        best.append(found)
    words, end = [], len(label)
    while end:
        start = best[end][1]
        words.append(label[start:end])
        end = start
    return words[::-1]


def _labels(column: str) -> Column:
    """The runs of letters and of digits of a host; a run longer than a domain label may be is taken in pieces of MAX_WORD."""
    return F.expr(f"array_distinct(regexp_extract_all({column}, '(\\\\p{{L}}{{1,{MAX_WORD}}}|[0-9]{{1,{MAX_WORD}}})', 1))")


def _segment(total: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            words = [segment(label, dict(zip(parts, ns)), total) for label, parts, ns in zip(*(batch.column(c).to_pylist() for c in ("label", "parts", "ns")))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    return run


def segment_labels(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for distinct labels: their substrings are joined with the counts, never the whole list sent."""
    counts = cut(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    spans = f"flatten(transform(sequence(1, length(label)), i -> transform(sequence(1, least({MAX_WORD}, length(label) - i + 1)), k -> substring(label, i, k))))"
    parts = labels.select("label", F.explode(F.array_distinct(F.expr(spans))).alias("word"))
    known = parts.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    own = labels.join(known, "label", "left").select("label", F.coalesce(F.col("known.word"), F.array().cast("array<string>")).alias("parts"), F.coalesce(F.col("known.n"), F.array().cast("array<bigint>")).alias("ns"))
    return map_batches(own, _segment(total), "label string, words array<string>")


def segment_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) for distinct non-empty hosts."""
    split = hosts.select("host", F.posexplode(_labels("host")).alias("at", "label"))
    words = segment_labels(split.select("label").distinct(), counts)
    joined = split.join(words, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("all"))
    return joined.select("host", F.flatten("all.words").alias("words"))


def _features() -> Column:
    """Slots of host words and whole path tokens; digits count by their number only."""
    tokens = F.expr("filter(split(regexp_replace(lower(path), '[0-9]', '0'), '[^a-z0-9\\\\x{80}-\\\\x{10ffff}]+'), x -> x <> '')")
    named = F.concat(F.transform(F.col("words"), lambda w: F.concat(F.lit("h:"), F.regexp_replace(w, "[0-9]", "0"))), F.transform(tokens, lambda w: F.concat(F.lit("p:"), w)))
    return F.transform(named, lambda x: F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int"))


def train(urls: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, float]:
    """Log-odds of allow for each slot, and of the classes, from rows with features and verdict.

    Counts cover all rows; at most 2 * slots sums come back. Without rows everything is 0.
    """
    labelled = urls.where("verdict is not null")
    prior = {r.verdict: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    counts = np.ones((2, slots))
    for r in labelled.select("verdict", F.explode("features").alias("slot")).groupBy("verdict", "slot").count().collect():
        counts[int(r.verdict == "allow"), r.slot] += r["count"]
    log = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return log[1] - log[0], math.log((prior.get("allow", 0) + 1) / (prior.get("block", 0) + 1))


def _score(odds: np.ndarray, prior: float):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            said = [prior + float(odds[f].sum()) if f else prior for f in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _OUT), pa.array(said, pa.float64())], [*_OUT, "log_odds"])

    return run


_OUT = ("page_id", "host", "path", "rule", "decided", "words")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, log_odds) for every row of pages (page_id, url, html).

    verdict is the longest fitting rule's, else allow if the log-odds are 0 or more, block if less.
    A NULL url, or one without ://, has an empty host and path, which no rule fits. Repeated
    rows and URLs give repeated rows. Without pages that a rule decides everything else is allowed.
    """
    at = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = at.select("*", rule.alias("rule"), verdict.alias("verdict"))
    hosts = segment_hosts(ruled.where("host <> ''").select("host").distinct(), word_counts(pages))
    # A host may have a third of all pages, and so may the empty one: each is dealt to SALTS parts.
    dealt = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = ruled.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    urls = cut(salted.join(dealt, ["host", "salt"], "left").drop("salt").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))).withColumn("features", _features()))
    odds, prior = train(urls)
    scored = map_batches(
        urls.withColumnRenamed("verdict", "decided"), _score(odds, prior), "page_id long, host string, path string, rule string, decided string, words array<string>, log_odds double"
    )
    method = F.when(F.col("log_odds") >= 0, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "words", "log_odds")
