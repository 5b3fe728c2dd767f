"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


def _leaf(count: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", count, "text")) + ")"


#: crc32 of the decimal doc_id, bit by bit, with the reversed polynomial.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
 lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda k: k::UBIGINT)),
  lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"""
_PAIRS = "list_transform(range(1, len({x}) + 1, 2), lambda i: sha256({x}[i] || coalesce({x}[i + 1], '')))"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda k: array_to_string(w[k:k + least(5, len(w)) - 1], ' '))) AS g
 FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
""",
    "op10_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS g
 FROM i WHERE len(w) > 0),
z AS (SELECT DISTINCT size FROM t),
g AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS p, w FROM d, z WHERE len(w) >= size),
m AS (SELECT doc_id, p, g.size, item_id FROM (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS g FROM g) g JOIN t ON t.g = g.g AND t.size = g.size),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE l AS (SELECT lang, doc_id, {_leaf('n_chars')} AS leaf, {_leaf(f'(n_chars::HUGEINT + CASE WHEN {_CRC32} % 7 = 0 THEN 1 ELSE 0 END)')} AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
t(lang, level, nodes) AS (SELECT lang, 0, list(leaf ORDER BY place) FROM p GROUP BY lang
 UNION ALL SELECT lang, level + 1, {_PAIRS.format(x='nodes')} FROM t WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
u(level, nodes) AS (SELECT 0, list(subroot ORDER BY place) FROM s UNION ALL SELECT level + 1, {_PAIRS.format(x='nodes')} FROM u WHERE len(nodes) > 1),
a AS (SELECT p.doc_id, p.leaf, p.other, s.subroot, s.place AS top,
  list({{'at': (p.place >> t.level) % 2, 'sib': coalesce(t.nodes[xor(p.place >> t.level, 1) + 1], '')}} ORDER BY t.level) FILTER (len(t.nodes) > 1) AS low
 FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN t ON t.lang IS NOT DISTINCT FROM p.lang GROUP BY p.doc_id, p.leaf, p.other, s.subroot, s.place, p.place),
h AS (SELECT s.place AS top, list({{'at': (s.place >> u.level) % 2, 'sib': coalesce(u.nodes[xor(s.place >> u.level, 1) + 1], '')}} ORDER BY u.level) FILTER (len(u.nodes) > 1) AS high
 FROM s, u GROUP BY s.place),
f AS (SELECT doc_id, leaf, other, subroot, list_concat(coalesce(low, []), coalesce(high, [])) AS path FROM a JOIN h USING (top)),
g AS (SELECT *, list_reduce(list_prepend({{'at': 0::BIGINT, 'sib': other}}, path), lambda x, y:
  {{'at': 0::BIGINT, 'sib': sha256(CASE WHEN y['at'] = 1 THEN y['sib'] || x['sib'] ELSE x['sib'] || y['sib'] END)}})['sib'] AS folded_root FROM f)
SELECT doc_id, leaf, subroot, nodes[1] AS root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x['sib']), ''), '')) AS proof_sha256,
 folded_root, folded_root = nodes[1] AS verified FROM g, u WHERE len(nodes) = 1
""",
    "op12_suffix_array_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
b AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
n AS (SELECT r, i, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS s
 FROM (SELECT r, i, i > lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) + 200 AS gap FROM b)),
s AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM n GROUP BY r, s),
e AS (SELECT r, lo, hi FROM s UNION ALL SELECT r, length(h) // 2, length(h) // 2 FROM d),
g AS (SELECT r, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo, hi) AS start FROM e),
k AS (SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*) - 1 AS n_spans, unhex(string_agg(substr(h, 2 * start + 1, 2 * (lo - start)), '' ORDER BY lo, hi)) AS kept
 FROM g JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, n_removed, n_spans, sha256(kept) AS kept_sha256 FROM d JOIN k USING (r)
""",
    "op13_phrase_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
c AS MATERIALIZED (SELECT lang, g, k, count(*)::HUGEINT AS a FROM (
 SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM p, range(1, 6) t(k) WHERE len(w) >= k)
 GROUP BY lang, g, k HAVING count(*) >= 100),
u AS (SELECT *, string_split(g, ' ') AS w FROM c WHERE k > 1),
x AS (SELECT u.lang, u.g, u.k, u.a, t.cut, l.a AS l, r.a AS r, n.n, (1000 * u.a * n.n) // (l.a * r.a) AS score
 FROM u JOIN range(1, 5) t(cut) ON t.cut < u.k JOIN n ON n.lang = u.lang JOIN c l ON l.lang = u.lang AND l.g = array_to_string(u.w[:t.cut], ' ')
 JOIN c r ON r.lang = u.lang AND r.g = array_to_string(u.w[t.cut + 1:], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
z AS (SELECT y.* FROM y WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = y.lang AND q.k > y.k AND q.a >= y.a AND contains(' ' || q.g || ' ', ' ' || y.g || ' ')))
SELECT lang, rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM z) WHERE rank <= 2000
""",
}
