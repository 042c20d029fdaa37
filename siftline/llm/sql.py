"""DuckDB SQL for the rows of those operators that SQL can express."""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {10 * i + 1}, 10) AS BIGINT) >> {35 - 5 * k}) & 31 AS INT) + 1, 1)"
    for i in range(4) for k in range(8)
)

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)"""

URLS = r"""
WITH g AS (SELECT page_id, url,
  regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*[^/?#:@.])', 1) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, regexp_extract(path, '^(/[^/]*)', 1) AS dir, string_split(host, '.') AS labels FROM g),
daily AS (SELECT concat('list', page_id % 3) AS list,
  CASE WHEN page_id % 8 = 0 THEN 'host' WHEN page_id % 8 = 1 THEN 'domain' WHEN page_id % 8 < 4 THEN 'prefix' ELSE 'url' END AS kind,
  CASE WHEN page_id % 8 < 2 THEN host WHEN page_id % 8 < 4 THEN host || dir ELSE host || path END AS pattern,
  DATE '2024-01-01' + CAST(page_id * 53 % 360 AS INT) AS day, max(page_id % 5 < 2) AS gone
 FROM p WHERE url IS NOT NULL AND page_id IS NOT NULL GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS until FROM daily),
keys AS (
 SELECT page_id, 'domain' AS kind, unnest(list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(labels[i:], '.'))) AS pattern FROM p WHERE host <> ''
 UNION ALL SELECT page_id, 'host', host FROM p WHERE host <> ''
 UNION ALL SELECT page_id, 'prefix', host || dir FROM p WHERE host <> ''
 UNION ALL SELECT page_id, 'url', host || path FROM p WHERE host <> ''),
hits AS (SELECT k.page_id, s.list, list_position(['domain', 'host', 'prefix', 'url'], k.kind) AS rank
 FROM keys k JOIN p USING (page_id) JOIN spans s ON s.kind = k.kind AND s.pattern = k.pattern AND NOT s.gone
  AND s.day <= DATE '2024-01-01' + CAST(k.page_id * 37 % 360 AS INT)
  AND (s.until IS NULL OR DATE '2024-01-01' + CAST(k.page_id * 37 % 360 AS INT) < s.until))
SELECT p.page_id, DATE '2024-01-01' + CAST(p.page_id * 37 % 360 AS INT) AS day, count(h.list) AS n_entries,
 count(h.list) > 0 AS blocked, min(h.list) AS first_list, ['domain', 'host', 'prefix', 'url'][max(h.rank)] AS narrowest
FROM p LEFT JOIN hits h ON h.page_id = p.page_id GROUP BY p.page_id"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
 least(vec_id, coalesce(c, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, j, substr(h, CAST(1024 * j + 1 AS BIGINT), 1122) AS g FROM d, unnest(range(strlen(h) // 1024 + 1)) AS t(j)),
w AS (SELECT doc_id, 512 * j + i AS i, substr(g, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM part, unnest(range(512)) AS t(i) WHERE strlen(g) >= 2 * i + 100),
least AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT doc_id, i FROM w JOIN least USING (s) WHERE first < doc_id),
edge AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS opens FROM cut WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
span AS (SELECT doc_id, run, min(i) AS b, max(i) + 50 AS e FROM
 (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edge) GROUP BY doc_id, run),
kept AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS after FROM span),
told AS (SELECT doc_id, sum(e - b) AS gone, count(*) AS spans, max(e) AS e,
  string_agg(substr(h, CAST(2 * after + 1 AS BIGINT), CAST(2 * (b - after) AS BIGINT)), '' ORDER BY b) AS rest FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
 coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN e IS NULL THEN h ELSE rest || substr(h, CAST(2 * e + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN told USING (doc_id)"""

TRIE = r"""
WITH crc AS (SELECT conv_id, xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
   lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
   lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, CAST(4294967295 AS BIGINT)),
   CAST(4294967295 AS BIGINT)) % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS t FROM conversations GROUP BY conv_id),
built AS (SELECT c.conv_id, list_concat(coalesce(b.t, [])[1:h], o.t[h + 1:]) AS t
 FROM crc c JOIN own o USING (conv_id) LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
keyed AS (SELECT conv_id, t, list_transform(range(len(t) + 1), lambda d: sha256(CAST(t[1:d] AS VARCHAR))) AS k FROM built),
steps AS (SELECT conv_id, k[d + 1] AS key, k[d] AS up, d AS depth, len(t) AS size,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(t[d][2], '[^\x20\x09-\x0D]+')) END AS words
 FROM keyed, unnest(range(len(t) + 1)) AS u(d)),
nodes AS (SELECT key, any_value(up) AS up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
 FROM steps GROUP BY key, depth),
family AS (SELECT up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
above AS (SELECT DISTINCT s.key, a.key AS top FROM steps s JOIN steps a ON a.conv_id = s.conv_id AND a.depth <= s.depth),
sums AS (SELECT top, sum((n_convs - 1) * words) AS saved, count(*) FILTER (WHERE f.n IS NULL) AS leaves
 FROM above JOIN nodes USING (key) LEFT JOIN family f ON f.up = key GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n, 0) AS n_children, leaves AS n_leaves,
 CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums ON top = n.key LEFT JOIN nodes p ON p.key = n.up AND n.depth > 0 LEFT JOIN family f ON f.up = n.key"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
known AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM b, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE n > 0),
asked AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
 FROM d, (SELECT DISTINCT n FROM known), unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT DISTINCT doc_id, item_id, n, i FROM asked JOIN known USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

SQL = {
    "op2_warc": WARC, "op5_url_filter": URLS, "op8_near_vectors": VECTORS, "op9_suffix_dedup": REPEATS,
    "op11_conversation_trie": TRIE, "op13_decontaminate": LEAKS,
}
