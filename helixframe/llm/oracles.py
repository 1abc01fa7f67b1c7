"""DuckDB SQL for the operators whose results SQL can express."""

from __future__ import annotations

from helixframe.llm.url_filter import LOWER, UPPER

WORDS = r"[^\x20\x09-\x0D]+"

OP4 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, near) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, k.b FROM r JOIN k ON r.near = k.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(near) AS component_id FROM r GROUP BY 1) m USING (doc_id)"""

OP8 = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, v, r FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM q JOIN v c ON q.r <> c.r),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP9 = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size, substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, cap / w AS level, coalesce(sum(cap) OVER b, 0) AS caps, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, caps + level * open <= total AS full_ FROM l),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE least(cap, (total - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ()) END AS target FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
e AS (SELECT d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest, size * 100 > q.target - q.whole * q.source_size AS large FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
u AS (SELECT *, sum(size) OVER (PARTITION BY source, large ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto, sum(CASE WHEN large THEN size ELSE 0 END) OVER (PARTITION BY source) AS large_size FROM e),
g AS (SELECT *, large AND upto <= rest * large_size / greatest(source_size, 1) AS large_in FROM u),
k AS (SELECT *, sum(CASE WHEN large_in THEN size ELSE 0 END) OVER (PARTITION BY source) AS large_taken FROM g)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN large_in OR (NOT large AND upto - size / 2.0::DOUBLE <= rest - large_taken) THEN 1 ELSE 0 END)::BIGINT AS taken FROM k"""

#: The rules written out by themselves, so that the operator's own strings are checked.
BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate((
    "n_words < 10", "n_repeat_words * 5 > n_words", "n_symbols * 4 > n_words", "n_exclamations * 10 > n_words * 3", "n_lines > 3 AND n_dup_lines * 2 > n_lines", "n_words > 0 AND NOT word_chars BETWEEN n_words * 2 AND n_words * 20",
)))
OP10 = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORDS}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l FROM d),
g AS (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
h AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
c AS (SELECT row, sum(least(5, coalesce(gap, 5)))::BIGINT AS n FROM (SELECT row, lead(i) OVER (PARTITION BY row ORDER BY i) - i AS gap FROM h) GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '!'))::BIGINT AS n_exclamations FROM w LEFT JOIN c USING (row)),
b AS (SELECT *, ({BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, fail_bits FROM b"""

NAMES = ("few_words", "repeated_words", "symbols", "shouting", "repeated_lines", "word_length")
ABLATIONS = f"""WITH b AS ({OP10}), r(rule, bit) AS (VALUES {", ".join(f"('{n}', {1 << i})" for i, n in enumerate(NAMES))})
SELECT rule, bit, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & 63 = bit) AS n_only, count(*) FILTER (fail_bits & (63 - bit) = 0) AS n_kept_without FROM b, r GROUP BY rule, bit"""

#: The crc32 of each distinct feature goes byte by byte through a table that the query makes itself.
OP11 = rf"""WITH RECURSIVE c(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM c WHERE k < 8),
t AS (SELECT i, c FROM c WHERE k = 8),
x AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
f AS (SELECT side, row, array_to_string(w[i:i + n - 1], ' ') AS f FROM (SELECT side, row, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w)),
r(f, h, k, c) AS (SELECT f, hex(f), 0, 4294967295 FROM (SELECT DISTINCT f FROM f) UNION ALL SELECT f, h, k + 1, xor(r.c >> 8, t.c) FROM r JOIN t ON t.i = xor(r.c & 255, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) WHERE 2 * k < length(h)),
b AS (SELECT f, xor(c, 4294967295) % 10000 AS b FROM r WHERE 2 * k = length(h)),
n AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN b USING (f) GROUP BY 1),
g AS (SELECT b, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS g FROM n),
d AS (SELECT row, count(*) AS n_features, sum(g)::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (b) WHERE side = 'd' GROUP BY 1),
z AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, (('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM w LEFT JOIN d USING (row) WHERE side = 'd'),
s AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln(u)))::BIGINT AS score FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM o"""

#: Five hexadecimal digits of the SHA-1 are four of base 32.
OP13 = """WITH p AS (SELECT row_number() OVER () AS row, page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
o AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST))
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first END AS refers_to, NULL::VARCHAR AS problem FROM o"""
