"""DuckDB SQL of the training-data queries that SQL can express, over the whole tables."""

from __future__ import annotations

from newsloom.llm import collocations, fim, mixing, quality, warc

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.LEAST_PAYLOAD} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= {warc.LEAST_PAYLOAD} AND page_id <> first_id THEN first_id END AS refers_to FROM f"""

OP4 = rf"""
WITH s AS (SELECT doc_id, source, md5(coalesce(text, '')) AS print, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s GROUP BY source),
w AS (SELECT *, {list(mixing.WEIGHTS)}[CAST(place % {len(mixing.WEIGHTS)} AS INT) + 1] AS weight, source_size * {mixing.REPEATS} AS most, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM per),
o AS (SELECT *, CAST(total - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
l AS (SELECT (SELECT level FROM o WHERE most > level * weight ORDER BY most / weight, place LIMIT 1) AS shared),
t AS (SELECT source, place, source_size, total, coalesce(least(CAST(most AS DOUBLE), shared * weight), CAST(most AS DOUBLE)) AS target, greatest({mixing.LEAST_BLOCK}, (total + {mixing.SLOTS - 1}) // {mixing.SLOTS}) AS width FROM o, l),
b AS (SELECT *, greatest((source_size + width - 1) // width, least((source_size + {mixing.LEAST_BLOCK - 1}) // {mixing.LEAST_BLOCK}, {mixing.SOURCE_BLOCKS})) AS blocks FROM t),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target * blocks / source_size * {mixing.PARTS} + 0.5) AS BIGINT) ELSE 0 END AS parts FROM b),
u AS (SELECT *, CAST(sum(parts) OVER () AS BIGINT) AS all_parts, CAST(sum(parts) OVER (ORDER BY place) AS BIGINT) AS upto FROM n),
e AS (SELECT *, (upto - parts) * {mixing.FULL} // greatest(all_parts, 1) AS low, upto * {mixing.FULL} // greatest(all_parts, 1) AS high FROM u),
k AS (SELECT slot, slot * {mixing.GOLDEN} % {mixing.FULL} AS point FROM (SELECT unnest(range((SELECT (max(all_parts) + {mixing.PARTS - 1}) // {mixing.PARTS} FROM e))) AS slot)),
m AS (SELECT e.place, e.blocks, row_number() OVER (PARTITION BY e.place ORDER BY k.slot) - 1 AS turn FROM k JOIN e ON k.point >= e.low AND k.point < e.high),
c AS (SELECT place, turn % blocks AS block, count(*) AS copies FROM m WHERE turn < blocks * {mixing.REPEATS} GROUP BY 1, 2),
d AS (SELECT s.doc_id, s.size, e.source_size, e.target, e.place, e.blocks, CAST(coalesce(sum(s.size) OVER (PARTITION BY e.place ORDER BY md5(concat_ws(':', CAST(s.doc_id AS VARCHAR), s.print)), s.doc_id, s.print ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source WHERE s.size > 0),
g AS (SELECT *, unnest(range(greatest((pos * blocks + blocks - 1) // source_size - 1, 0), least(((pos + size - 1) * blocks + blocks - 1) // source_size, blocks - 1) + 1)) AS block FROM d),
h AS (SELECT *, least(pos + size, (block + 1) * source_size // blocks) - greatest(pos, block * source_size // blocks) AS words FROM g),
x AS (SELECT h.doc_id, h.size, h.source_size, h.target, h.place, h.pos, CAST(sum(h.words * coalesce(c.copies, 0)) AS BIGINT) AS taken FROM h LEFT JOIN c ON c.place = h.place AND c.block = h.block WHERE h.words > 0 GROUP BY ALL)
SELECT doc_id, size, source_size, target, taken FROM x
UNION ALL SELECT s.doc_id, s.size, e.source_size, e.target, 0 FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source WHERE s.size = 0"""


def _bits() -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality.RULES.values()))


OP6 = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS body FROM documents),
w AS (SELECT r, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM t),
p AS (SELECT r, unnest(words) AS one, generate_subscripts(words, 1) AS i FROM w),
z AS (SELECT r, i, one, lead(one) OVER q AS two, lead(one, 2) OVER q AS three FROM p WINDOW q AS (PARTITION BY r ORDER BY i)),
v AS (SELECT r, i, count(*) OVER (PARTITION BY r, one, two, three) AS n FROM z WHERE three IS NOT NULL),
a AS (SELECT r, count(DISTINCT i + j) AS n FROM v, (SELECT unnest([0, 1, 2]) AS j) WHERE v.n > 1 GROUP BY r),
n AS (SELECT r, unnest(string_split(body, chr(10))) AS line FROM t),
d AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM n WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT t.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t.body, '[{quality.SYMBOLS}]')) AS BIGINT) AS n_symbols, coalesce(d.n_dup_lines, 0) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words,
  coalesce(d.n_lines, 0) AS n_lines, CAST(len(regexp_extract_all(t.body, '[A-Z]')) AS BIGINT) AS n_upper FROM t JOIN w ON w.r = t.r LEFT JOIN a ON a.r = t.r LEFT JOIN d ON d.r = t.r),
f AS (SELECT *, CAST({_bits()} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, fail_bits & {quality.policy_mask(quality.BASE_POLICY)} <> 0 AS base_failed, fail_bits & {quality.policy_mask(quality.POLICY)} = 0 AS kept, fail_bits FROM f"""

OP11 = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
words AS (SELECT lang, word AS phrase, count(*) AS a FROM (SELECT lang, unnest(w) AS word FROM q) GROUP BY 1, 2),
g AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM q, (SELECT unnest(range(2, {collocations.LONGEST + 1})) AS size) WHERE len(w) >= size),
f AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
known AS (SELECT lang, phrase, a FROM f UNION ALL SELECT lang, phrase, a FROM words),
c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f),
s AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, CAST(CAST({collocations.SCALE} AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score FROM c
  JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s) WHERE place = 1),
z AS (SELECT lang, a, w, n, unnest(range(1, size - n + 2)) AS i FROM (SELECT lang, a, size, string_split(phrase, ' ') AS w, unnest(range(2, size)) AS n FROM f WHERE size > 2)),
around AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer FROM z GROUP BY 1, 2),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM words GROUP BY lang),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY m.score DESC, m.a DESC, m.phrase) AS rank FROM m LEFT JOIN around USING (lang, phrase)
  WHERE around.longer IS NULL OR 100 * CAST(around.longer AS HUGEINT) < {collocations.COVER} * CAST(m.a AS HUGEINT))
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, total.n, o.score FROM o JOIN total ON total.lang = o.lang WHERE o.rank <= {collocations.TOP}"""

OP12 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units FROM t),
h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {fim.RATE} THEN 'plain' WHEN h4 % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
 sha256(prefix || middle || suffix) AS restored_sha256 FROM p"""

ORACLE_SQL: dict[str, str] = {"op1_warc": OP1, "op4_source_mix": OP4, "op6_quality_rules": OP6, "op11_collocations": OP11, "op12_fill_in_middle": OP12}
