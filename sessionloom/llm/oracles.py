"""Expected results of the queries that SQL can express, for DuckDB over the given tables.

The others have no SQL: XXH64 with a seed (op2), learned scores and cutoffs (op3, op4, op6),
tokenizers (op7, op8, pipeline) and eigenvectors (op11); tests/llm holds them against brute force instead.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP1 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
i AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[pos:pos + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM i WHERE len(w) > 0)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos, len(w) AS size FROM d WHERE len(w) > 0),
place AS (
  SELECT doc_id, pos, n, size, string_agg(x, ' ') OVER (PARTITION BY doc_id, n ORDER BY pos ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS p
  FROM word, (SELECT DISTINCT n FROM phrase) AS sizes),
found AS (SELECT DISTINCT doc_id, pos, n, item_id FROM place JOIN phrase USING (n, p) WHERE pos + n - 1 <= size),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS x FROM found) GROUP BY 1),
own AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (
  SELECT *, CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 10 + 8 WHEN 'assistant' THEN 1 + 5 ELSE 6 + length(role) + 2 + 8 END AS around,
    len(regexp_extract_all(text, '<\\*(s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\]|ROLE |/ROLE\])')) AS escaped
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(around + length(text) + escaped)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, pos, md5(substr(h, 2 * pos + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS pos FROM d)),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY m ORDER BY doc_id, pos) AS n FROM w) WHERE n > 1),
run AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b
  FROM (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS r
        FROM (SELECT doc_id, pos, if(pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100, 0, 1) AS new FROM again))
  GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM run),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10 = """
WITH l AS (
  SELECT doc_id, text, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
f AS (SELECT line, min({'d': doc_id, 'a': pos}) AS p, length(line) AS n FROM l WHERE length(line) >= 40 GROUP BY line),
near AS (
  SELECT DISTINCT x.line FROM f AS x JOIN (SELECT *, n + unnest([-2, -1, 0, 1, 2]) AS m FROM f) AS y
  ON x.n = y.m AND y.p < x.p AND levenshtein(x.line, y.line) <= 2),
kept AS (
  SELECT l.doc_id, l.pos, l.line FROM l LEFT JOIN f ON l.line = f.line AND l.doc_id = f.p.d AND l.pos = f.p.a LEFT JOIN near ON l.line = near.line
  WHERE length(l.line) < 40 OR (f.line IS NOT NULL AND near.line IS NULL)),
rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, (n_lines - coalesce(n, 0))::BIGINT AS n_removed, length(coalesce(t, ''))::BIGINT AS n_chars, sha256(coalesce(t, '')) AS kept_sha256
FROM (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id) LEFT JOIN rest USING (doc_id)
"""

OP12 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + least(4, len(w)) - 1], ' ') FOR i IN range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)]) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a),
least_ AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN least_ USING (doc_id)
"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    parts = " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in fields)
    return f"sha256({parts})"


#: Levels of 16 per source, then levels of 16 over the sources' tops; grp 0 is a source's tree, grp 1 the one above.
OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
    {_leaf("text")} AS leaf, {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS lowered,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::UBIGINT FOR k IN range(8)]), lambda v, k: xor(v >> 1, (v & 1) * 3988292384::UBIGINT)))) % 5 = 0 AS tampered
  FROM documents),
low AS (
  SELECT 0 AS lv, s, pos, leaf AS digest, count(*) OVER (PARTITION BY s) AS n FROM d
  UNION ALL
  SELECT any_value(lv) + 1, s, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM low WHERE n > 1 GROUP BY s, pos // 16),
top AS (SELECT s, max(lv) AS lv, arg_max(digest, lv) AS subroot FROM low GROUP BY s),
high AS (
  SELECT 0 AS lv, s AS pos, subroot AS digest, count(*) OVER () AS n FROM top
  UNION ALL
  SELECT any_value(lv) + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16) FROM high WHERE n > 1 GROUP BY pos // 16),
root AS (SELECT arg_max(digest, lv) AS root FROM high),
step AS (
  SELECT doc_id, low.lv AS step, coalesce(string_agg(digest, '' ORDER BY low.pos) FILTER (low.pos < (d.pos >> (4 * low.lv))), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY low.pos) FILTER (low.pos > (d.pos >> (4 * low.lv))), '') AS r
  FROM d JOIN low ON d.s = low.s AND low.n > 1 AND low.pos // 16 = (d.pos >> (4 * low.lv)) // 16 GROUP BY ALL
  UNION ALL
  SELECT doc_id, top.lv + high.lv, coalesce(string_agg(digest, '' ORDER BY high.pos) FILTER (high.pos < (d.s >> (4 * high.lv))), ''),
    coalesce(string_agg(digest, '' ORDER BY high.pos) FILTER (high.pos > (d.s >> (4 * high.lv))), '')
  FROM d JOIN top USING (s) JOIN high ON high.n > 1 AND high.pos // 16 = (d.s >> (4 * high.lv)) // 16 GROUP BY ALL),
fold AS (
  SELECT doc_id, 0 AS step, if(tampered, lowered, leaf) AS digest FROM d
  UNION ALL
  SELECT doc_id, fold.step + 1, sha256(l || digest || r) FROM fold JOIN step USING (doc_id, step)),
folded AS (SELECT doc_id, arg_max(digest, step) AS folded_root FROM fold GROUP BY doc_id),
proof AS (SELECT doc_id, string_agg(l || r, '' ORDER BY step) AS p FROM step GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN top USING (s) CROSS JOIN root JOIN folded USING (doc_id) LEFT JOIN proof USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1,
    "op5_chat": OP5,
    "op9_repeated_passages": OP9,
    "op10_line_dedup": OP10,
    "op12_jaccard_join": OP12,
    "op13_merkle_manifest": OP13,
}
