"""SQL twins, for DuckDB, of the corpus queries that SQL expresses. They compare all with all where the operators do not."""

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, sum(hash(shingle)::HUGEINT) AS f FROM s GROUP BY doc_id),
classes AS (SELECT min(doc_id) AS doc_id, n, f FROM sizes GROUP BY n, f),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM (SELECT s.* FROM s JOIN classes USING (doc_id)) a JOIN (SELECT s.* FROM s JOIN classes USING (doc_id)) b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN classes x ON x.doc_id = a JOIN classes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
cc(id, comp) USING KEY (id) AS (SELECT doc_id, doc_id FROM classes UNION (SELECT l.b, min(c.comp) FROM cc c JOIN both_ways l ON l.a = c.id JOIN recurring.cc r ON r.id = l.b WHERE c.comp < r.comp GROUP BY l.b))
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(cc.comp, d.doc_id) AS component_id, d.doc_id = coalesce(cc.comp, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN classes k ON k.n = z.n AND k.f = z.f LEFT JOIN cc ON cc.id = k.doc_id
"""

_URL = r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)"

WARC = rf"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, trim(coalesce(url, '')) AS u, 1577836800 + page_id % 2147483648 AS captured FROM pages),
g AS (SELECT payload_digest, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY 1),
parts AS (SELECT page_id, captured, u, regexp_replace(lower(regexp_extract(u, '{_URL}', 1, 'i')), '^www\.', '') AS host, regexp_extract(u, '{_URL}', 2, 'i') AS port, lower(regexp_extract(u, '{_URL}', 3, 'i')) AS rest FROM p),
keyed AS (SELECT page_id, captured, CASE WHEN u = '' THEN '-' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN port NOT IN ('', '80', '443') THEN ':' || port ELSE '' END || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END AS urlkey FROM parts)
SELECT p.page_id, payload_bytes, p.payload_digest, CASE WHEN p.page_id < m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN p.page_id < m THEN m END AS refers_to,
  urlkey, p.captured, row_number() OVER (ORDER BY urlkey, p.captured, p.page_id) - 1 AS position
FROM p JOIN keyed USING (page_id) LEFT JOIN g ON g.payload_digest = p.payload_digest AND payload_bytes >= 1000
"""

SUFFIXES = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, s, hash(substr(h, 2 * s - 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(1, n - 198)) AS s FROM d WHERE n >= 200)),
often AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS b FROM win SEMI JOIN often USING (k)),
runs AS (SELECT doc_id, min(s) AS lo, max(s) + 199 AS hi FROM (SELECT doc_id, s, sum((b IS NULL OR s > b + 200)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM hit) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS was FROM runs),
kept AS (SELECT c.doc_id, string_agg(substr(h, 2 * was + 1, 2 * (lo - 1 - was)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS h, sum(hi - lo + 1)::BIGINT AS gone, count(*) AS spans FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

PASSAGES = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, s, hash(array_to_string(ws[s : s + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM win JOIN least USING (k) WHERE doc_id > m),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_CONTROLS = r"<\\*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|\|endoftext\|>)|\[\\*(?:INST\]|/INST\])"

CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|><|im_sep|><|im_end|>') + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '{_CONTROLS}')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_TERMS = r"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS.format(text="text")} AS ts FROM documents),
size AS (SELECT doc_id, r, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY 1, 2),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS.format(text="text")} AS ts FROM benchmark)) GROUP BY 1, 2, 3),
score AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (r), total GROUP BY 1, 2, 3, 4)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0) WHERE rank <= 10
"""

TRIE = """
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS k, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
crc(c, s, i, v) AS (SELECT c, c::VARCHAR, 0, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id AS c FROM t) UNION ALL
  SELECT c, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(s[i // 8 + 1])) ELSE v END AS x FROM crc WHERE i < 8 * length(s))),
h AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = 8 * length(s)),
raw AS (SELECT c, 0 AS own, k, role, text FROM h JOIN t ON t.conv_id = c - c % 100 AND k <= h UNION ALL SELECT c, 1, k, role, text FROM h JOIN t ON t.conv_id = c AND k > h),
seq AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, k) AS d, length(text) AS n, sha256(length(role) || ':' || role || text) AS id FROM raw),
pre AS (SELECT c, d, n, list(id) OVER (PARTITION BY c ORDER BY d) AS p FROM seq UNION ALL SELECT c, 0, 0, [] FROM h),
len AS (SELECT c, max(d) AS len FROM pre GROUP BY c),
node AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '') AS ends FROM pre JOIN len USING (c) GROUP BY d, p),
kids AS (SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
sums AS (SELECT p[1 : u] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM full_) GROUP BY 1)
SELECT f.conv_id, f.d::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sums USING (p) LEFT JOIN node q ON f.d > 0 AND q.d = f.d - 1 AND q.p = f.p[1 : f.d - 1]
"""

QUERIES = {"op13_prefix_trie": TRIE, "op12_lexical_search": LEXICAL, "op11_chat_masks": CHAT, "op1_near_duplicates": NEAR_DUPLICATES, "op4_warc_archives": WARC, "op8_suffix_dedup": SUFFIXES, "op10_substring_dedup": PASSAGES}
