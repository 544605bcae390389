"""DuckDB SQL for the queries that SQL can express, written from the contracts alone.

The tables are registered as views under their own names.
"""

from __future__ import annotations

OP1 = r"""
WITH words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), windows AS (
  SELECT doc_id, s AS start, array_to_string(w[s:s + 19], ' ') AS words FROM words, unnest(range(1, len(w) - 18)) AS t(s)
), later AS (
  SELECT doc_id, start FROM windows
  QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, start) > 1
), gone AS (
  SELECT DISTINCT doc_id, start + k AS place FROM later, unnest(range(0, 20)) AS t(k)
), single AS (
  SELECT doc_id, p AS place, w[p] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(p)
), marked AS (
  SELECT s.doc_id, s.place, s.word, g.place IS NOT NULL AS removed
  FROM single s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.place = s.place
), edges AS (
  SELECT *, removed AND NOT lag(removed, 1, false) OVER (PARTITION BY doc_id ORDER BY place) AS begins FROM marked
), summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, count(*) FILTER (begins) AS n_repeats,
         coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT removed), '') AS kept
  FROM edges GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_repeats, 0)::BIGINT AS n_repeats, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed USING (doc_id)
"""

OP5 = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), equal AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM texts JOIN equal USING (norm)
"""

OP7 = r"""
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, s AS start, md5_number(substring(h, (2 * s + 1)::BIGINT, 400)) AS name
  FROM raw, unnest(range(0, length(h) // 2 - 199)) AS t(s)
), twice AS (
  SELECT doc_id, start FROM windows QUALIFY count(*) OVER (PARTITION BY name) > 1
), runs AS (
  SELECT doc_id, start, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 200 THEN 0 ELSE 1 END AS begins FROM twice
), numbered AS (
  SELECT doc_id, start, sum(begins) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM runs
), spans AS (
  SELECT doc_id, run, min(start) AS first, max(start) + 200 AS last FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, run, first, last, lag(last, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS before FROM spans
), kept AS (
  SELECT g.doc_id, string_agg(substring(h, (2 * before + 1)::BIGINT, (2 * (first - before))::BIGINT), '' ORDER BY run) AS front,
         max(last) AS tail, sum(last - first) AS n_removed, count(*) AS n_spans
  FROM gaps g JOIN raw USING (doc_id) GROUP BY g.doc_id
)
SELECT r.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE front || substring(h, (2 * tail + 1)::BIGINT) END)) AS kept_sha256
FROM raw r LEFT JOIN kept k USING (doc_id)
"""

OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[s] || ' ' || w[s + 1] AS shingle FROM words, unnest(range(1, len(w))) AS t(s)
  UNION ALL SELECT doc_id, w[1] FROM words WHERE len(w) = 1
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
), found AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM found LEFT JOIN sizes USING (doc_id)
"""

OP10 = r"""
WITH valid AS (
  SELECT vec_id, row_number() OVER () AS row_no, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.row_no AS query_row, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM valid q JOIN valid c ON q.row_no <> c.row_no WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""

#: Same DP as a table: states 0 nothing yet, 1 after system, 2 after user, 3 after assistant; insertions come before an edit.
OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([n] || range(8), LAMBDA c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) AS r(n)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
), hit AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(key, '')],
             LAMBDA c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM keyed, crc
), rows AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(CASE WHEN h = 0 THEN [] WHEN h = 3 THEN [1, 2] ELSE [1] END) AS c(copy)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM rows
), judged AS (
  SELECT *, left(role, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), faults AS (
  SELECT conv_id, i, turn, role, text, initial, before,
         CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM judged
), moves(p, kind, q) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3), (0, 'R', 2), (1, 'R', 2), (2, 'R', 3), (3, 'R', 2),
         (0, 'D', 0), (1, 'D', 1), (2, 'D', 2), (3, 'D', 3)
), ins(p, q, cost, audit, lines) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'),
         (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), edits AS (
  SELECT conv_id, i, p, q, CASE kind WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN fault = 'truncated' AND kind <> 'D' THEN 5 ELSE 0 END AS cost,
         CASE kind WHEN 'D' THEN 'D' WHEN 'R' THEN 'R' ELSE 'K' END AS audit,
         CASE WHEN kind = 'D' THEN '' ELSE chr(10) || CASE WHEN kind <> 'R' THEN role WHEN q = 2 THEN 'user' ELSE 'assistant' END || ':' || text END AS lines
  FROM faults JOIN moves ON kind IN ('D', 'R') OR kind = initial WHERE kind = 'D' OR fault NOT IN ('blank', 'duplicate')
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'lines': ''} AS w FROM conversations
  UNION ALL
  SELECT b.conv_id, e.i, e.q, min({'cost': b.w.cost + n.cost + e.cost, 'audit': b.w.audit || n.audit || e.audit, 'lines': b.w.lines || n.lines || e.lines}) AS w
  FROM best b JOIN ins n ON n.p = b.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.p = n.q
  GROUP BY b.conv_id, e.i, e.q
), sizes AS (
  SELECT c.conv_id, count(f.i) AS n, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0) AS gaps,
         count(*) FILTER (f.fault = 'blank') AS blank, count(*) FILTER (f.fault = 'duplicate') AS duplicate,
         count(*) FILTER (f.fault = 'truncated') AS truncated, count(*) FILTER (f.before || f.initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
), goals AS (
  SELECT b.conv_id, min({'cost': b.w.cost + n.cost, 'audit': b.w.audit || n.audit, 'lines': b.w.lines || n.lines}) AS w
  FROM best b JOIN ins n ON n.p = b.q JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.n = b.i WHERE n.q IN (0, 3) GROUP BY b.conv_id
)
SELECT s.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, w.cost::BIGINT AS cost, w.audit AS audit, sha256(substr(w.lines, 2)) AS repaired_sha256
FROM sizes s JOIN goals g ON g.conv_id IS NOT DISTINCT FROM s.conv_id
"""

OP12 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), marked AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM words
), given AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), docs AS (
  SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM marked LEFT JOIN given USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY part, fails
), orders(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || x FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS l(x) WHERE NOT contains(filter_order, x)
), steps AS (
  SELECT filter_order, step::INTEGER AS step, substr(filter_order, step::BIGINT, 1) AS letter,
         [ascii(x) - 64 FOR x IN string_split(substr(filter_order, 1, step::BIGINT - 1), '') IF x <> ''] AS earlier, ascii(substr(filter_order, step::BIGINT, 1)) - 64 AS own
  FROM orders, unnest(range(1, 6)) AS s(step) WHERE length(filter_order) = 5
), judged AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails[own] AS fails_own,
         len([k FOR k IN earlier IF fails[k]]) > 0 AS gone, len([x FOR x IN fails IF x]) = 1 AS alone
  FROM steps, cells
), metrics AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT fails_own), 0) AS kept,
         coalesce(sum(n) FILTER (NOT gone AND fails_own), 0) AS removed, coalesce(sum(n) FILTER (gone AND fails_own), 0) AS redundant,
         coalesce(sum(n) FILTER (fails_own AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails_own), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND fails_own), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM metrics
"""

OP13 = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row_no
  FROM rests
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT p.*, rule_host || rule_path AS rule, verdict
  FROM parts p LEFT JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY length(rule) DESC NULLS LAST) = 1
"""

SQL: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op5_exact_dedup": OP5,
    "op7_suffix_array_dedup": OP7,
    "op9_hyperminhash": OP9,
    "op10_vector_search": OP10,
    "op11_conversation_repair": OP11,
    "op12_filter_audit": OP12,
    "op13_url_filters": OP13,
}
