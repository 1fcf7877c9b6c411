"""DuckDB SQL for the queries that SQL can express, over whole tables.

Without one, tested against brute force instead: op3 (trained), op4 (positions of leftmost matches), op7 (a scheduler),
op10 (an automaton).
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

_OP2 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (
  SELECT doc_id, i, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) AS h, i + 7 <= n AS whole
  FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
twice AS (SELECT doc_id, h FROM win WHERE whole GROUP BY doc_id, h HAVING count(*) > 1),
flagged AS (SELECT w.doc_id, w.i, w.whole AND t.h IS NOT NULL AS f FROM win w LEFT JOIN twice t ON w.doc_id = t.doc_id AND w.h = t.h AND w.whole),
covered AS (SELECT doc_id, max(f::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM flagged),
rep AS (SELECT doc_id, sum(c) AS n_repeat_words FROM covered GROUP BY doc_id),
line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT d.doc_id, CASE WHEN regexp_matches(d.source, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]') THEN regexp_replace(lower(regexp_extract(d.source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '^www\.', '') ELSE d.source END AS host, len(d.w) AS n_words, length(array_to_string(d.w, '')) AS word_chars,
    length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(line.n_dup, 0) AS n_dup_lines, coalesce(line.n_lines, 0) AS n_lines, coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)
),
ruled AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS failed
  FROM f
),
host AS (SELECT host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS nf FROM ruled WHERE host IS NOT NULL GROUP BY host),
pool AS (SELECT sum(n) AS n, sum(nf) / sum(n) AS m, count(*) AS k, sum(n * n) AS n2 FROM host),
q AS (SELECT sum(host.n * (host.nf / host.n - pool.m) ** 2) AS q FROM host, pool),
rho AS (SELECT CASE WHEN k > 1 AND m > 0 AND m < 1 AND n - n2 / n - (k - 1) > 0 THEN least(1.0, greatest(0.0, (q / (m * (1 - m)) - (k - 1)) / (n - n2 / n - (k - 1)))) ELSE 0 END AS rho, m, k FROM pool, q),
prior AS (SELECT m, CASE WHEN rho > 0 THEN least(200.0, greatest(20.0, 1 / rho - 1)) ELSE 200.0 END AS s FROM rho),
verdict AS (SELECT host, (nf + m * s) / (n + s) > greatest(0.2, m + 3.0 * sqrt(m * (1 - m) / (s + 1))) AS rejected FROM host, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM ruled LEFT JOIN verdict USING (host)
"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, w, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, i, word, i + 49 <= n AS whole, CASE WHEN i + 49 <= n THEN sha256(array_to_string(list_slice(w, i, i + 49), ' ')) END AS h FROM pos),
least_doc AS (SELECT h, min(doc_id) AS m FROM win WHERE whole GROUP BY h),
flagged AS (SELECT win.doc_id, win.i, win.word, coalesce(m < doc_id, false) AS f FROM win LEFT JOIN least_doc ON win.h = least_doc.h),
cut AS (SELECT doc_id, i, word, max(f::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM flagged),
out AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM cut GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN out USING (doc_id)
"""

_OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = d.doc_id
"""

_OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(deg.n, 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN deg ON deg.x = e.vec_id LEFT JOIN low ON low.x = e.vec_id
"""

_OP9 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": _OP1,
    "op2_quality_rules": _OP2,
    "op5_substring_dedup": _OP5,
    "op6_minhash_near_dedup": _OP6,
    "op8_embedding_near_dedup": _OP8,
    "op9_warc": _OP9,
}
