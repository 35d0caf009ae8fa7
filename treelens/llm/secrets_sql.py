"""op9 as DuckDB SQL: positions from the text between matches, as in the query."""

from __future__ import annotations

from . import secrets


def _kind(k: int, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return (
        f"SELECT doc_id, source, {k} AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS whole, "
        f"regexp_extract_all(t, '{p}', {group}) AS vals FROM docs WHERE regexp_matches(t, '{p}')"
    )


_PATTERNS = [(p, g) for _, p, g in secrets.KINDS] + [(secrets.TOKEN, 0)]
_NAMES = "[" + ", ".join(f"'{n}'" for n in secrets.NAMES) + "]"
_SPAN = f"({_NAMES})[kind + 1] || ':' || s || ':' || e"

ORACLE = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_kind(k, p, g) for k, (p, g) in enumerate(_PATTERNS))}),
numbered AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found),
located AS (
  SELECT doc_id, source, kind, vals[i] AS v,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(whole[1:i], lambda x: length(x))) AS BIGINT) AS e,
    length(whole[i]) AS n
  FROM numbered
), spans AS (SELECT doc_id, source, kind, v, e - n AS s, e FROM located WHERE kind > 0 OR length(v) >= {secrets.MIN_VALUE}),
live AS (
  SELECT * FROM spans WHERE kind = {secrets.OWNED} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
    AND len(list_distinct(string_split(v, ''))) >= {secrets.MIN_DISTINCT_CHARS}
), few AS (
  SELECT v FROM (SELECT doc_id, source, v FROM live UNION ALL SELECT doc_id, source, v FROM spans WHERE kind < {secrets.OWNED})
  GROUP BY v HAVING count(DISTINCT coalesce(source, chr(0))) <= {secrets.MAX_OWNERS} AND count(DISTINCT {{'s': coalesce(source, chr(0)), 'd': coalesce(doc_id, -1)}}) <= {secrets.MAX_REPOS}
),
every AS (SELECT doc_id, kind, s, e FROM spans WHERE kind < {secrets.OWNED} UNION ALL SELECT doc_id, kind, s, e FROM live WHERE v IN (SELECT v FROM few))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg({_SPAN}, ',' ORDER BY s, kind) FILTER (kind < {secrets.OWNED}), '')) AS base_sha256,
  coalesce(string_agg({_SPAN}, ',' ORDER BY s, kind) FILTER (kind IS NOT NULL), '') AS spans, count(*) FILTER (kind = {secrets.OWNED}) AS n_owned
FROM docs d LEFT JOIN every USING (doc_id) GROUP BY d.doc_id
"""
