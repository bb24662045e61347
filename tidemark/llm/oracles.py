"""The same results in DuckDB's SQL, where SQL can say them."""

from __future__ import annotations

from . import licenses
from .mixing import BLOCK_TOKENS

_GOLDEN = 0.6180339887498949

OP4 = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS tm FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, tm) - 1 AS copy FROM d),
h AS (SELECT *, md5(concat_ws('|', '17', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), tm, CAST(copy AS VARCHAR))) AS h FROM n),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM h GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((no - 1) % 3 + 1 AS INT)]::DOUBLE AS w, source_size * 3.0::DOUBLE AS lim FROM s),
o AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (total - below) / rest AS level FROM o),
t AS (SELECT source, source_size, no, least(lim, coalesce((SELECT arg_min(level, (lim / w, no)) FROM l WHERE lim / w >= level), 0) * w) AS target FROM l),
c AS (SELECT *, sum(target) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(target) OVER () AS hi, row_number() OVER (ORDER BY no DESC) AS last FROM t WHERE target > 0),
r AS (SELECT *, CASE WHEN last = 1 THEN 1.1 ELSE hi END AS upto, coalesce(lag(hi) OVER (ORDER BY no), 0) AS lo FROM c),
p AS (SELECT (i * {_GOLDEN} + 0.5) % 1.0 AS u FROM (SELECT unnest(range(CAST((SELECT ceil(sum(source_size) / {BLOCK_TOKENS}) FROM s) AS BIGINT))) AS i)),
k AS (SELECT no, count(*) * {BLOCK_TOKENS} AS words FROM p JOIN r ON u >= lo AND u < upto GROUP BY no),
a AS (SELECT h.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM h)
SELECT doc_id, size, t.source_size, target, CAST(coalesce(greatest(0, least(start + size, words) - start) + greatest(0, least(start + size + t.source_size, words) - start - t.source_size) + greatest(0, least(start + size + 2 * t.source_size, words) - start - 2 * t.source_size), 0) AS BIGINT) AS taken, a.source
FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.no = t.no"""

OP7 = """WITH RECURSIVE j AS (SELECT DISTINCT doc_id, CAST(coalesce(doc_id, 0) AS HUGEINT) + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END AS k, CAST(0 AS BIGINT) AS nxt, CAST(-1 AS BIGINT) AS shard, CAST(-1 AS BIGINT) AS grown FROM documents
UNION ALL SELECT doc_id, k2, CAST(floor((nxt + 1) * (2147483648.0::DOUBLE / CAST((k2 >> 33) + 1 AS DOUBLE))) AS BIGINT), CASE WHEN nxt < 16 THEN nxt ELSE shard END, nxt FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM j WHERE nxt < 17)),
z AS (SELECT doc_id, shard, grown FROM j WHERE nxt >= 17),
c0 AS (SELECT i AS b, CAST(i AS UBIGINT) AS v, 0 AS n FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END, n + 1 FROM c0 WHERE n < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM c0 WHERE n = 8),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST(('0x' || x) AS UBIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS crc FROM documents, crc)
SELECT d.doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS LAST, crc, size) - 1 AS slot, CAST(grown AS INT) AS grown_shard FROM d JOIN z ON d.doc_id IS NOT DISTINCT FROM z.doc_id"""

OP10 = """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
OP5 = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT n, doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, a.n AS an, b.n AS bn FROM x a JOIN x b ON a.g = b.g AND a.n < b.n GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON sa.n = an JOIN s sb ON sb.n = bn WHERE 100 * shared >= 90 * (len(sa.s) + len(sb.s) - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
m AS (SELECT a, min(b) AS least FROM c GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(doc_id, least), doc_id) AS component_id FROM s LEFT JOIN m ON a = doc_id"""

_PART = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: CRC-32 of the decimal doc_id, byte by byte.
_CRC = """c0 AS (SELECT i AS b, CAST(i AS UBIGINT) AS v, 0 AS n FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END, n + 1 FROM c0 WHERE n < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM c0 WHERE n = 8)"""
_TREE = """{name} AS (SELECT g, 0 AS level, pos, digest, n FROM {of} UNION ALL SELECT g, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, level, pos // 3, n)"""
_SIDES = """SELECT a.g, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
FROM {tree} a JOIN {tree} b ON a.g = b.g AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL"""
OP11 = f"""WITH RECURSIVE {_CRC},
d AS (SELECT *, CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST(('0x' || x) AS UBIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents, crc),
l AS (SELECT doc_id, coalesce('s' || source, '') AS g, {_LEAF.format(text="text")} AS digest, {_LEAF.format(text="other")} AS other FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, digest, other) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS row FROM l),
{_TREE.format(name="t", of="p")},
s AS (SELECT '' AS g, g AS source, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{_TREE.format(name="u", of="s")},
a AS ({_SIDES.format(tree="t")}), b AS ({_SIDES.format(tree="u")}),
w AS (SELECT row, g, 0 AS level, pos, '' AS proof, other AS digest FROM p UNION ALL SELECT row, w.g, w.level + 1, w.pos // 3, proof || l || r, sha256(l || digest || r) FROM w JOIN a ON w.g = a.g AND w.level = a.level AND w.pos = a.pos),
x AS (SELECT row, g, arg_max(proof, level) AS proof, arg_max(digest, level) AS digest FROM w GROUP BY row, g),
y AS (SELECT row, 0 AS level, s.pos, proof, x.digest FROM x JOIN s ON s.source = x.g UNION ALL SELECT row, y.level + 1, y.pos // 3, proof || l || r, sha256(l || digest || r) FROM y JOIN b ON y.level = b.level AND y.pos = b.pos),
z AS (SELECT row, arg_max(proof, level) AS proof, arg_max(digest, level) AS folded FROM y GROUP BY row)
SELECT doc_id, p.digest AS leaf, s.digest AS subroot, u.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.digest AS verified FROM p JOIN s ON s.source = p.g JOIN z USING (row) JOIN u ON u.n = 1"""

OP12 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS e FROM d),
f AS (SELECT *, least(a, b) AS i, greatest(a, b) - least(a, b) AS m, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, substring(t, 1, i) AS pre, substring(t, i + 1, m) AS mid, substring(t, i + m + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ", ".join(f"('{label}', {_list(sorted(set(t.split())))}, {licenses.width(len(t.split()))}, {licenses.needed(len(set(t.split())))})" for label, t in licenses.TEMPLATES)
_PHRASES = " UNION ALL ".join(
    f"SELECT n, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))})) - 1 AS place FROM d" for p, label in licenses.PHRASES.items()
)
OP13 = f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.WORD}') AS w FROM documents),
b AS ({_PHRASES}),
t AS (SELECT * FROM (VALUES {_TEMPLATES}) AS v(label, words, width, need)),
k AS (SELECT n, w, width, unnest(range(0, CAST(ceil(len(w) / width) AS BIGINT))) AS k FROM d, (SELECT DISTINCT width FROM t)),
s AS (SELECT n, width, list_distinct(w[k * width + 1:k * width + 2 * width]) AS w FROM k),
m AS (SELECT n, label, len(list_intersect(w, words)) / len(words) AS contained FROM s JOIN t USING (width) WHERE len(list_intersect(w, words)) >= need),
f AS (SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT n, label FROM b UNION SELECT n, label FROM m) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(own, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN c > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM d LEFT JOIN (SELECT n, count(*) AS c, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS own FROM b GROUP BY n) USING (n) LEFT JOIN (SELECT n, max(contained) AS best FROM m GROUP BY n) USING (n) LEFT JOIN f USING (n)"""
