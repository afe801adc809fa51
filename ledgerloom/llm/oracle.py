"""SQL (DuckDB) for the operators that SQL can express: 1, 2, 6, 7, 8, 9, 11 and 13.

The others are models or searches; tests/llm holds them against plain versions.
"""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANK = r"[^\x20\x09-\x0D]+"


def _components(nodes: str, links: str) -> str:
    """CTEs ``reach`` and ``component`` (node, root) from CTEs of nodes (node) and of links (a, b) in both directions."""
    return f"""
reach AS (
  SELECT node AS a, node AS b FROM {nodes}
  UNION
  SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a
),
component AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a)"""


OP1 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {LOWER}) AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, h.key IS NOT NULL AND h.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP2 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) >= 0.93),
nodes AS (SELECT vec_id AS node FROM embeddings),
{_components("nodes", "links")},
degree AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, root AS component_id, root = vec_id AS kept
FROM embeddings JOIN component ON node = vec_id LEFT JOIN degree ON a = vec_id
"""

OP6 = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
split AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^?#]*') AS rest FROM parts),
addressed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), {LOWER}) AS host, regexp_replace(rest, '^[^/]*', '') AS path FROM split
),
rules(rule, h, p, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fit AS (
  SELECT a.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM addressed a LEFT JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM fit WHERE k = 1
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '{BLANK}') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
overlap AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM overlap JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * c >= 90 * (s.n + t.n - c)),
nodes AS (SELECT doc_id AS node FROM documents),
{_components("nodes", "links")}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id
FROM documents d JOIN component ON node = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id
"""

_DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = " || ".join(
    f"substr({_DIGITS}, (((('0x' || substr(h, {1 + 10 * part}, 10))::BIGINT >> {35 - 5 * k}) & 31) + 1)::INT, 1)" for part in range(4) for k in range(8)
)
OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, sha256(html) AS key FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY key) AS first FROM d)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

OP9 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{BLANK}'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM s),
o AS (
  SELECT *, row_number() OVER by_limit AS rank, sum(source_size::DOUBLE) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(most) OVER before, 0) AS full_before, coalesce(sum(weight) OVER before, 0) AS weight_before
  FROM w WINDOW by_limit AS (ORDER BY most / weight, source NULLS LAST), before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
l AS (SELECT *, (total - full_before) / (weights - weight_before) AS level_here FROM o),
plan AS (
  SELECT source, source_size, least(most, weight * coalesce((SELECT arg_min(level_here, rank) FROM l WHERE most / weight > level_here), 'infinity'::DOUBLE)) AS target FROM l
),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM plan),
tied AS (SELECT source, hash, sum(size) AS size FROM sized GROUP BY source, hash),
run AS (
  SELECT t.*, b.target - b.repeats * b.source_size AS amount, sum(t.size) OVER (PARTITION BY t.source ORDER BY hash) AS upto
  FROM tied t JOIN budget b ON t.source IS NOT DISTINCT FROM b.source
),
edge AS (SELECT *, row_number() OVER (PARTITION BY source, upto > amount ORDER BY hash) AS k FROM run),
more AS (SELECT source, hash FROM edge WHERE upto <= amount OR (k = 1 AND size < 2 * (amount - (upto - size))))
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.repeats + CASE WHEN m.hash IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM sized d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN more m ON m.source IS NOT DISTINCT FROM d.source AND m.hash = d.hash
"""

OP11 = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
),
positive AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT * FROM ranked WHERE rank <= 10
"""

# Every row's edit is up to two insertions and then one of K, R, D; the cheapest and ASCII-least way to each state is kept.
OP13 = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS codes
  FROM conversations
),
plain AS (
  SELECT *, xor(list_reduce(codes, lambda crc, code: list_reduce(range(8), lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc, code)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS how
  FROM keyed
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN how = 3 THEN [1, 2] ELSE [1] END) AS time
  FROM plain WHERE how <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS sign
  FROM damaged
),
judged AS (
  SELECT *, CASE WHEN sign = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN sign NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed
),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
),
inserted(state, after, audit, cost, lines) AS (VALUES
  ('-', '-', '', 0, ''), ('-', 'u', 'I', 3, chr(10) || 'user:'), ('-', 'a', 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 's', '', 0, ''), ('s', 'u', 'I', 3, chr(10) || 'user:'), ('s', 'a', 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', 'u', '', 0, ''), ('u', 'a', 'I', 3, chr(10) || 'assistant:'), ('a', 'a', '', 0, ''), ('a', 'u', 'I', 3, chr(10) || 'user:')),
legal(state, next) AS (VALUES ('-', 's'), ('-', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
moves AS (
  SELECT i.state, i.audit, i.cost, i.lines, l.next, l.state AS at FROM inserted i JOIN legal l ON i.after = l.state
),
edits AS (
  SELECT state, audit || 'K' AS audit, cost, lines, next, 'K' AS edit FROM moves
  UNION ALL SELECT state, audit || 'R', cost + 3, lines, next, 'R' FROM moves WHERE next <> 's'
  UNION ALL SELECT state, audit || 'D', cost + 4, lines, after, 'D' FROM inserted
),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '-' AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS best FROM conversations
  UNION ALL
  SELECT w.conv_id, j.i, e.next, min({
           'cost': w.best.cost + e.cost + CASE WHEN j.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END, 'audit': w.best.audit || e.audit,
           'lines': w.best.lines || e.lines || CASE e.edit WHEN 'K' THEN chr(10) || j.role || ':' || j.text WHEN 'R' THEN chr(10) || CASE e.next WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text ELSE '' END})
  FROM ways w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1 JOIN edits e ON e.state = w.state
  WHERE e.edit = 'D' OR (j.fault IS DISTINCT FROM 'blank' AND j.fault IS DISTINCT FROM 'duplicate' AND (e.edit = 'R' OR e.next = j.initial))
  GROUP BY w.conv_id, j.i, e.next
),
closed AS (
  SELECT w.conv_id, min({'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.audit, 'lines': w.best.lines || i.lines}) AS best
  FROM ways w LEFT JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id JOIN inserted i ON i.state = w.state AND (i.after = 'a' OR (i.after = '-' AND i.audit = ''))
  WHERE w.i = coalesce(c.n, 0) GROUP BY w.conv_id
)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, d.best.cost::BIGINT AS cost, d.best.audit AS audit, sha256(substr(d.best.lines, 2)) AS repaired_sha256
FROM closed d LEFT JOIN counts c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""

SQL: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op2_embedding_near_dedup": OP2,
    "op6_url_filter": OP6,
    "op7_ngram_jaccard_join": OP7,
    "op8_warc": OP8,
    "op9_mix_sources": OP9,
    "op11_hard_negatives": OP11,
    "op13_conversation_repair": OP13,
}
