"""Line deduplication across documents, near-equal lines included, in DataFrame operations only.

Lines of at least MIN_CHARS characters count. A line goes if an equal line, or one within THRESHOLD
edits (insert, delete, replace a character), stands earlier: in a document of smaller doc_id, or
further up in the same. Shorter lines stay.

Equal lines are grouped by two hashes. Near ones are found by the segment-partition join
(Pass-Join): a line is cut into THRESHOLD + 1 segments of about equal length; a line within the
threshold must hold one of them unchanged, at a place that the lengths and the edits left over
allow. So the index has each line's segments by line length and segment number, and a line probes
it with its few substrings at such places. Lines' texts come along into the join, which stops at a
line's first hit. Where many lines have a segment in common (copies of a template, each with a
change of its own), bitmaps of their letters are compared first. Spark's own bounded distance thins
out the pairs, and those left are verified with a banded bit-parallel edit distance: the vertical differences of one column of the
band are two bitmaps, and a column is a handful of bit operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import cut, keyed, named, shown_id

THRESHOLD = 2
MIN_CHARS = 40
#: Lines with the same segment from which the join looks at bitmaps of letters ahead of texts.
CROWD = 2
#: Words of 64 bits in the table of places whose lines are read again: 2 MB of bits, whatever the corpus.
WORDS = 1 << 18


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _key(number: int, length: Column, begin: Column, width: Column) -> Column:
    return F.xxhash64(F.lit(number), length, F.substr(F.col("line"), begin + 1, width))


def _segment(length: Column, number: int, threshold: int) -> tuple[Column, Column]:
    """Where segment number of a line of this length begins, and its length; later ones take the rest."""
    parts = threshold + 1
    short, rest = F.floor(length / parts).cast("int"), length % parts
    longer = F.greatest(F.lit(0), rest - (parts - number))
    return short * number + longer, short + (F.lit(number) >= parts - rest).cast("int")


def index_keys(threshold: int) -> Column:
    """Keys of the segments of a line, from the columns line and size, its length."""
    length = F.col("size")
    return F.array(*(_key(k, length, *_segment(length, k, threshold)) for k in range(threshold + 1)))


def probe_keys(threshold: int) -> Column:
    """Keys of the substrings that can be a segment of an equally long or shorter line.

    Before segment k at most k edits are left over (else an earlier segment is unchanged), after it
    threshold - k, which bounds how far the substring can be from the segment's place. The line's own
    segments in their places are left out: index_keys has them.
    """
    keys = []
    for shorter in range(threshold + 1):
        length = F.col("size") - shorter
        for k in range(threshold + 1):
            begin, width = _segment(length, k, threshold)
            for shift in range(max(-k, shorter - (threshold - k)), min(k, shorter + (threshold - k)) + 1):
                if shorter or shift:
                    keys.append(_key(k, length, begin + shift, width))
    return F.array(*keys) if keys else F.expr("cast(array() as array<bigint>)")


def within(a: str, b: str, threshold: int) -> Column:
    """Are the texts of two columns within threshold edits? NULL if either is.

    A band of 2 * threshold + 1 diagonals: bit k of a column's bitmaps is row j - threshold + k.
    Moving on by a column moves the window down a row. Above and below the band differences are
    taken as +1, which no path within the threshold needs. The distance is followed along the
    diagonal that ends in the last cell.
    """
    if not 0 <= threshold <= 15:
        raise ValueError("the band must fit into 31 bits")
    width = 2 * threshold + 1
    every, top = (1 << width) - 1, 1 << (width - 1)
    s, t = f"if(length({a}) >= length({b}), {a}, {b})", f"if(length({a}) >= length({b}), {b}, {a})"
    equal = " | ".join(f"if(get(p.s, j - {threshold + 1 - k}) <=> get(p.t, j - 1) and j - {threshold + 1 - k} >= 0, {1 << k}, 0)" for k in range(width))
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    diagonal = f"({threshold} + size(p.s) - size(p.t))"
    step = let(
        "x",
        f"named_struct('m', {equal}, 'vp', shiftright(acc.vp, 1) | {top}, 'vn', shiftright(acc.vn, 1), 'd', acc.d)",
        let(
            "y",
            f"named_struct('x', x, 'd0', ((((x.m & x.vp) + x.vp) ^ x.vp) | x.m | x.vn) & {every})",
            let(
                "z",
                f"named_struct('d0', y.d0, 'hp', ((shiftleft(y.x.vn | (~(y.d0 | y.x.vp) & {every}), 1)) | 1) & {every}, 'hn', shiftleft(y.d0 & y.x.vp, 1) & {every}, 'd', y.x.d)",
                f"named_struct('vp', z.hn | (~(z.d0 | z.hp) & {every}), 'vn', z.d0 & z.hp, 'd', z.d + 1 - (shiftright(z.d0, {diagonal}) & 1))",
            ),
        ),
    )
    start = f"named_struct('vp', {every & ~((1 << (threshold + 1)) - 1)}, 'vn', 0, 'd', size(p.s) - size(p.t))"
    distance = f"aggregate(if(size(p.t) = 0, cast(array() as array<int>), sequence(1, size(p.t))), {start}, (acc, j) -> {step}, acc -> acc.d)"
    chars = f"named_struct('s', regexp_extract_all({s}, '(?s).', 0), 't', regexp_extract_all({t}, '(?s).', 0))"
    # What both begin and end with needs no columns.
    same = "least(coalesce(nullif(array_position(zip_with({0}, {1}, (x, y) -> x <=> y), false), 0) - 1, size(p.t)), size(p.t))"
    tails = "named_struct('s', slice(p.s, h + 1, size(p.s) - h), 't', slice(p.t, h + 1, size(p.t) - h))"
    cut_off = "named_struct('s', slice(p.s, 1, size(p.s) - e), 't', slice(p.t, 1, size(p.t) - e))"
    middle = let("p", let("p", chars, let("h", f"int({same.format('p.s', 'p.t')})", tails)), let("e", f"int({same.format('reverse(p.s)', 'reverse(p.t)')})", cut_off))
    near = f"if(abs(length({a}) - length({b})) > {threshold}, false, {let('p', middle, distance)} <= {threshold})"
    return F.expr(f"if({a} is null or {b} is null, null, {near})")


def _at_lines(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, at, line) of different places (doc_id, at); a document's places meet its text as one row."""
    wanted = places.groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    picked = docs.join(wanted, "doc_id").select("doc_id", _lines().alias("lines"), "places")
    taken = picked.select("doc_id", F.explode(F.expr("transform(places, i -> named_struct('at', i, 'line', lines[i]))")).alias("x"))
    return taken.select("doc_id", "x.at", "x.line")


def _at_few_lines(docs: DataFrame, places: DataFrame, min_chars: int) -> DataFrame:
    """_at_lines for places of a small part of the lines, of at least min_chars: no text is shuffled but theirs.

    Hashes of the places set bits of a table of bounded size. Lines without their bit stay behind,
    and the rest, of which some have it by chance, meet the places.
    """
    cell = F.xxhash64("doc_id", "at")
    word, bit = F.pmod(cell, F.lit(WORDS)), F.shiftrightunsigned(cell, 58).cast("int")
    one = F.expr("shiftleft(1L, _bit)")
    bits = places.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(one).alias("_bits"))
    lines = docs.select("doc_id", F.posexplode(_lines()).alias("at", "line")).where(F.length("line") >= min_chars)
    met = lines.select("*", word.alias("_word"), bit.alias("_bit")).join(F.broadcast(bits), "_word")
    return met.where(F.col("_bits").bitwiseAND(one) != 0).select("doc_id", "at", "line").join(places, ["doc_id", "at"])


def _letters(line: str) -> Column:
    """64 bits: which characters, by the last bits of their codes, are there an odd number of times. An edit changes two at most."""
    return F.expr(f"aggregate(regexp_extract_all({line}, '(?s).', 0), 0L, (acc, c) -> acc ^ shiftleft(1L, ascii(c) & 63))")


def first_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, at) of the first of equal lines; at is the line's number from 0."""
    lines = docs.select("doc_id", F.posexplode(_lines()).alias("at", "line")).where(F.length("line") >= min_chars)
    hashed = lines.select("doc_id", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    return hashed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first")).select("first.doc_id", "first.at")


def _near_later(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, at) of the later lines of pairs (a, b) of places that are within the threshold."""
    later, earlier = F.greatest("a", "b"), F.least("a", "b")
    ends = pairs.select(later.doc_id.alias("doc_id"), later.at.alias("at"), earlier.doc_id.alias("by_doc"), earlier.at.alias("by_at")).distinct()
    by = texts.select(F.col("doc_id").alias("by_doc"), F.col("at").alias("by_at"), F.col("line").alias("by_line"))
    both = ends.join(texts, ["doc_id", "at"]).join(by, ["by_doc", "by_at"])
    thin = F.levenshtein("line", "by_line", threshold) >= 0  # thins out, and is itself verified
    return both.where(thin).where(within("line", "by_line", threshold)).select("doc_id", "at").distinct()


def _stars(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of places: every line of a key with the first that it can be near to there."""
    place, is_index = F.struct("doc_id", "at"), F.col("is_index")
    heads = met.groupBy("key").agg(F.min(F.when(is_index, place)).alias("index"), F.min(place).alias("any"))
    both = met.join(heads, "key").select(F.when(is_index, F.col("any")).otherwise(F.col("index")).alias("a"), place.alias("b"))
    return both.where("a <> b").distinct()


def _open_later(met: DataFrame, texts: DataFrame, settled: DataFrame, threshold: int, crowd: int) -> DataFrame:
    """(doc_id, at) of the lines of met that are not settled and near an earlier one of the same key.

    A line's first hit ends its search, so the join makes no more rows than it is given lines.
    """
    whole = met.join(texts, ["doc_id", "at"]).select("key", "n", "is_index", F.struct("doc_id", "at").alias("place"), "line", "letters")
    later = whole.join(settled.select(F.struct("doc_id", "at").alias("place")), "place", "left_anti")
    earlier = whole.select(F.col("key").alias("by_key"), F.col("is_index").alias("by_index"), F.col("place").alias("by_place"), F.col("line").alias("by_line"), F.col("letters").alias("by_letters"))
    can_be = (F.col("is_index") | F.col("by_index")) & (F.col("by_place") < F.col("place"))
    alike = (F.col("n") <= crowd) | (F.bit_count(F.col("letters").bitwiseXOR(F.col("by_letters"))) <= 2 * threshold)
    thin = F.levenshtein("line", "by_line", threshold) >= 0  # thins out, and is itself verified
    on = (F.col("key") == F.col("by_key")) & can_be & alike & thin & within("line", "by_line", threshold)
    return later.join(earlier, on, "left_semi").select("place.doc_id", "place.at").distinct()


def near_lines(docs: DataFrame, firsts: DataFrame, threshold: int = THRESHOLD, crowd: int = CROWD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, at) of the first lines, of at least min_chars, that have an earlier first line within the threshold.

    One such line is enough. So each line of a key is compared with the key's first line, which
    settles most lines of a template, and only lines that are not settled are compared with
    earlier ones of their keys, up to the first that is near.
    """
    lines = _at_lines(docs, firsts)
    keys = F.concat(index_keys(threshold), probe_keys(threshold))
    sized = lines.withColumn("size", F.length("line"))  # a pass over the line, and many keys need it
    exploded = sized.select("doc_id", "at", F.posexplode(keys).alias("nth", "key"))
    # The place in the text and the kind of key are one number in the shuffle: _at is odd for segments.
    keyed = exploded.select("key", "doc_id", (F.col("at") * 2 + (F.col("nth") <= threshold).cast("int")).alias("_at"))
    # Most keys are of one line alone; what is left is little, and stored for all its uses.
    same = Window.partitionBy("key")
    least, most = F.min("_at").over(same), F.max("_at").over(same)
    several = (F.min("doc_id").over(same) != F.max("doc_id").over(same)) | (F.shiftright(least, 1) != F.shiftright(most, 1))
    counted = keyed.select("*", F.sum(F.col("_at").bitwiseAND(1)).over(same).alias("n"), several.alias("_several")).where("_several and n > 0")
    met = cut(counted.select("key", "doc_id", F.shiftright("_at", 1).alias("at"), (F.col("_at").bitwiseAND(1) == 1).alias("is_index"), "n"))
    texts = cut(_at_few_lines(docs, met.select("doc_id", "at").distinct(), min_chars).withColumn("letters", _letters("line")))
    settled = cut(_near_later(_stars(met), texts, threshold))
    return settled.unionByName(_open_later(met, texts, settled, threshold, crowd)).distinct()


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for every document: its text without repeated lines.

    The rest of the lines are joined as they were. Lines are split at \\n only; min_chars must be at
    least three times threshold + 1. Rows that repeat a doc_id with another text follow
    by text (see in_order), NULL is the smallest id; a NULL text is empty. A text whose lines all go is empty. No rows give no rows.
    """
    if min_chars < 3 * (threshold + 1):
        raise ValueError("segments of such short lines say too little")
    own, names = keyed(docs)
    firsts = cut(first_lines(own, min_chars))
    kept = firsts.join(near_lines(own, firsts, threshold, crowd, min_chars), ["doc_id", "at"], "left_anti")
    by_doc = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("at")).alias("kept"))
    flags = F.expr(
        "if(kept is null, cast(array() as array<boolean>), flatten(transform(kept, (k, i) -> concat(array_repeat(false, k - if(i = 0, -1, kept[i - 1]) - 1), array(true)))))"
    )
    joined = own.join(by_doc, "doc_id", "left").select("doc_id", _lines().alias("lines"), flags.alias("flags"))
    left = F.expr(f"filter(lines, (x, i) -> length(x) < {min_chars} or coalesce(get(flags, i), false))")
    rest = joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), left.alias("rest"))
    done = rest.select("doc_id", F.array_join("rest", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("rest")).alias("n_removed"))
    return named(done, names)


def line_report(docs: DataFrame) -> DataFrame:
    """dedup_lines as counts and a digest of the remaining text."""
    done = dedup_lines(docs)
    return done.select(shown_id(), "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))
