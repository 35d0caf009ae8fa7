"""op4 and op6 as DuckDB SQL: every word window written out."""

from __future__ import annotations

from . import fmindex, substring

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
spots AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws, len(ws) AS n FROM docs),
words AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i + {substring.WIDTH} - 1 <= n THEN array_to_string(ws[i:i + {substring.WIDTH} - 1], ' ') END AS win FROM spots),
firsts AS (SELECT win, min(doc_id) AS first FROM words WHERE win IS NOT NULL GROUP BY win HAVING min(doc_id) < max(doc_id)),
marked AS (
  SELECT doc_id, i, w, max(CASE WHEN first < doc_id THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN {substring.WIDTH - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN firsts USING (win)
), kept AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (gone = 0) AS body FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""

LEAKS = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS ws FROM benchmark),
sized AS (SELECT item, ws, least(len(ws), {fmindex.WIDTH}) AS n FROM items WHERE len(ws) > 0),
starts AS (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM sized),
wanted AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM starts),
lengths AS (SELECT DISTINCT n FROM wanted),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS ws FROM documents),
spots AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, lengths WHERE len(ws) >= n),
hits AS (SELECT doc_id, i, wanted.n, item FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM spots) s JOIN wanted USING (n, win)),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits),
counts AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
named AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN named USING (doc_id)
"""
