"""DuckDB SQL for the queries of this subpackage that SQL can express."""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, CASE WHEN regexp_matches(text, '<\\*/turn>|#\\*## ') THEN 1 ELSE 0 END AS hit,
    length(regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\1\\/turn>', 'g'), '#(\\*)## ', '#\1\\## ', 'g'))
    + length(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'tool' THEN 'Tool' ELSE 'role=' || hex(role) END) + 14 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(sum(hit) AS BIGINT) AS n_escaped, true AS round_trip
FROM e GROUP BY conv_id
"""

EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM q
"""

SUBSTRINGS = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w
), h AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + 12], ' ')) AS first_id FROM p
), g AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS k FROM h WHERE first_id < doc_id
), r AS (
  SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""

SIMHASH = None
