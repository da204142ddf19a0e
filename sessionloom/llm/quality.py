"""Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects a document if a ratio exceeds a cutoff of its stratum (its language). Labelled
documents are split by a hash of their id. One half proposes: for each rule the cutoff that rejects
most bad documents at little cost in good ones, and of equals the largest. The other half, the
holdout, certifies all rules of a stratum together: beginning many steps above the proposals and
going down to them, each set of cutoffs must have an exact binomial (Clopper-Pearson) upper bound
on its share of rejected good documents that is at most LIMIT. The walk ends at the first set that
fails; such a fixed sequence of tests needs no further correction, and strata are corrected for by
Bonferroni. So with probability 1 - DELTA, in no language more than LIMIT of good documents are
rejected by the rules. Each language is certified alone; where it has too few labelled good
documents for any set to pass, it has no cutoffs and the base rules alone hold.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.common import Batches, cut, map_batches

#: Largest share of good documents that all rules together may reject in a stratum.
LIMIT = 0.02
#: Probability that the guarantee fails in any stratum.
DELTA = 0.05
#: A wrongly rejected good document of the proposing half weighs as many caught bad ones.
COST = 20

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Candidate cutoffs of every rule, as shares.
GRID = [round(0.01 * 1.15**i, 6) for i in range(33)]

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_next", "n_upper", "n_letters", "n_marks")
RULES: dict[str, tuple[str, str]] = {
    "symbols per word": ("n_symbols", "n_words"),
    "words in repeated windows": ("n_repeat_words", "n_words"),
    "words equal to the next": ("n_same_next", "n_words"),
    "repeated lines": ("n_dup_lines", "n_lines"),
    "capitals among letters": ("n_upper", "n_letters"),
    "exclamation and question marks per word": ("n_marks", "n_words"),
}

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_MARKS = re.compile(r"[!?]")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def measure(text: str) -> tuple[int, ...]:
    """The numbers in COLUMNS for a whole text; words are split at 0x20 and 0x09-0x0D only."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    seen: set[str] = set()
    lines = dup_lines = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    same = repeated = 0
    if n:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        same = int((ids[1:] == ids[:-1]).sum())
        if n >= 4:
            _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
            _, which, count = np.unique(pairs[:-1].astype(np.int64) * len(number) + ids[2:], return_inverse=True, return_counts=True)
            twice = count[which] >= 2
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    if text.isascii():
        flat = np.frombuffer(data, np.uint8)
        upper = int(((flat >= 65) & (flat <= 90)).sum())
        letters = upper + int(((flat >= 97) & (flat <= 122)).sum())
    else:
        upper, letters = sum(map(str.isupper, text)), sum(map(str.isalpha, text))
    return n, chars, len(_SYMBOLS.findall(text)), dup_lines, repeated, lines, same, upper, letters, len(_MARKS.findall(text))


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, ...COLUMNS), a row for each input row; a NULL text has no words."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    return with_measures(own).select("doc_id", "lang", f"{MEASURED}.*")


#: The column that with_measures adds.
MEASURED = "_measured"


def with_measures(docs: DataFrame, name: str = MEASURED) -> DataFrame:
    """docs, whose column text is measured, with one more column of its numbers."""
    at = docs.columns.index("text")
    kind = pa.struct([(c, pa.int64()) for c in COLUMNS])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = np.array([measure(x or "") for x in batch.column(at).to_pylist()], np.int64).reshape(-1, len(COLUMNS))
            numbers = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COLUMNS))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers], [*batch.schema.names, name])

    numbers = T.StructType([T.StructField(c, T.LongType()) for c in COLUMNS])
    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, numbers)]))


def _columns(numbers: dict[str, Column] | None) -> dict[str, Column]:
    return numbers or {c: F.col(c) for c in COLUMNS}


def base_failed(numbers: dict[str, Column] | None = None) -> Column:
    """Fewer than 50 words, or over half of them in repeated three-word windows."""
    at = _columns(numbers)
    return (at["n_words"] < MIN_WORDS) | (100 * at["n_repeat_words"] > MAX_REPEAT_PERCENT * at["n_words"])


def upper_bound(errors: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which errors or fewer of n still have probability delta."""
    if errors >= n:
        return 1.0

    def below(p: float) -> float:
        if p <= 0:
            return 1.0
        log_p, log_q, term = math.log(p), math.log1p(-p), n * math.log1p(-p)
        total = math.exp(term)
        for k in range(1, errors + 1):
            term += math.log((n - k + 1) / k) + log_p - log_q
            total += math.exp(term)
        return total

    low, high = errors / n, 1.0 - 1e-12
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) > delta else (low, middle)
    return high


def propose(good: list[int], bad: list[int]) -> int | None:
    """Index in GRID of a rule's proposed cutoff, or None. Each list: documents over each cutoff."""
    gain = [b - COST * g for b, g in zip(bad, good)]
    return max(i for i, x in enumerate(gain) if x == max(gain)) if max(gain, default=0) > 0 else None


def certify(levels: dict[int, int], limit: float, delta: float) -> int | None:
    """The smallest certified step from the proposals, or None.

    levels counts the holdout's good documents by level; a document is rejected at all steps
    below its level. The walk goes from the safest step down and ends at the first that fails.
    """
    n, certified = sum(levels.values()), None
    for step in range(len(GRID) - 1, -1, -1):
        if upper_bound(sum(c for level, c in levels.items() if level > step), n, delta) > limit:
            break
        certified = step
    return certified if n else None


def _ratio(rule: str, numbers: dict[str, Column] | None = None) -> Column:
    over, under = (_columns(numbers)[c] for c in RULES[rule])
    return F.when(under > 0, over / under).otherwise(0.0)


def _bucket(rule: str) -> Column:
    """How many cutoffs of GRID the rule's ratio is over."""
    return F.size(F.filter(F.array(*map(F.lit, GRID)), lambda g: _ratio(rule) > g))


def cutoffs(measured: DataFrame, labels: DataFrame) -> dict[str, dict[str, float]]:
    """Per language, the certified cutoff of each rule; languages and rules without one are absent.

    measured is the result of measures; labels has doc_id and quality (1 good, 0 bad). A document
    that is labelled twice alike counts once, one labelled both ways not at all, NULL labels and ids
    neither. Documents that fail the base rules aren't used: the rules judge what is left. All
    labelled documents are counted in Spark; sums per language, rule and cutoff come back.
    """
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    good = (F.col("quality") > 0).alias("good")
    buckets = F.array(*map(_bucket, RULES)).alias("buckets")
    joined = measured.where(~base_failed()).join(own.where("quality = most").select("doc_id", "quality"), "doc_id")
    labelled = cut(joined.select("lang", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), good, buckets))

    counted = labelled.where("half = 0").select("lang", "good", F.posexplode("buckets").alias("rule", "bucket")).groupBy("lang", "good", "rule", "bucket").count().collect()
    over: dict[tuple[str, bool, int], np.ndarray] = {}
    for r in counted:
        at = over.setdefault((r.lang, r.good, r.rule), np.zeros(len(GRID), np.int64))
        at[: r.bucket] += r["count"]
    strata = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    empty, never = np.zeros(len(GRID), np.int64), len(GRID) + 1  # a rule without a proposal rejects at no step
    proposals = {}
    for s in strata:
        own = [propose(over.get((s, True, i), empty).tolist(), over.get((s, False, i), empty).tolist()) for i in range(len(RULES))]
        if any(x is not None for x in own):
            proposals[s] = own
    if not proposals:
        return {}

    start = F.create_map(*(x for s, own in proposals.items() for x in (F.lit(s), F.array(*(F.lit(never if x is None else x) for x in own)))))[F.col("lang")]
    level = F.array_max(F.zip_with("buckets", start, lambda b, p: F.greatest(b - p, F.lit(0)))).alias("level")
    levels: dict[str, dict[int, int]] = {}
    for r in labelled.where(F.col("lang").isin(list(proposals)) & (F.col("half") == 1) & F.col("good")).select("lang", level).groupBy("lang", "level").count().collect():
        levels.setdefault(r.lang, {})[r.level] = r["count"]
    out: dict[str, dict[str, float]] = {}
    for s, own in proposals.items():
        step = certify(levels.get(s, {}), LIMIT, DELTA / len(strata))
        if step is not None:
            out[s] = {rule: GRID[x + step] for rule, x in zip(RULES, own) if x is not None and x + step < len(GRID)}
    return out


def rejected(limits: dict[str, dict[str, float]], numbers: dict[str, Column] | None = None, lang: Column | None = None) -> Column:
    """Over any cutoff of the document's language; none is rejected in a language without cutoffs."""
    lang = F.col("lang") if lang is None else lang

    def any_over(rules: dict[str, float]) -> Column:
        out = F.lit(False)
        for rule, cutoff in sorted(rules.items()):
            out = out | (_ratio(rule, numbers) > cutoff)
        return out

    out = F.lit(False)
    for language, rules in sorted(limits.items()):
        out = F.when(lang == language, any_over(rules)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, ...COLUMNS, base_failed, kept) for every row of docs (doc_id, lang, text).

    kept is false if the base rules fail or a certified cutoff is exceeded. NULL and empty texts fail
    the base rules. NULL languages are one stratum. Without labels only the base rules hold. Repeated
    rows get equal results. No rows give no rows.
    """
    measured = cut(measures(docs))
    limits = cutoffs(measured, labels)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(limits))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge keeps, with all their columns and without a shuffle of texts."""
    limits = cutoffs(cut(measures(docs)), labels)
    own = MEASURED
    while own in map(str.lower, docs.columns):
        own += "_"
    numbers = {c: F.col(f"{own}.{c}") for c in COLUMNS}
    bad = base_failed(numbers) | rejected(limits, numbers, F.coalesce(F.col("lang").cast("string"), F.lit("")))
    return with_measures(docs, own).where(~bad).drop(own)
