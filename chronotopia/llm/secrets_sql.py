"""DuckDB SQL for the secrets query, by regular expressions instead of the automaton."""

from __future__ import annotations

#: kind, expression, condition on a match m; in the rules' order.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, {p}, 2)) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", r"[0-9a-f]+", "length(m) >= 24"),
    ("temporary_access", r"ASIA[A-Z0-9]+", "length(m) >= 20"),
    ("forge_token", r"gh(p|o|u|s|r)_[A-Za-z0-9]+", "length(m) >= 40"),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(m) >= 40"),
    ("private_key", r"-----BEGIN( [A-Z]+)* PRIVATE KEY-----", "true"),
)


def _one(n: int, kind: str, pattern: str, cond: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, {n} AS k, '{kind}' AS kind, n_before AS a, n_before + length(m) AS z FROM (
  SELECT rid, m, sum(length(piece)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before
  FROM (SELECT rid, unnest(regexp_split_to_array(text, {p})) AS piece, unnest(regexp_extract_all(text, {p})) AS m, generate_subscripts(regexp_split_to_array(text, {p}), 1) AS i FROM docs)
  WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE m IS NOT NULL AND {cond.format(p=p)}"""


ORACLE = (
    "WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), spans AS ("
    + "\nUNION ALL ".join(_one(n, *k) for n, k in enumerate(KINDS))
    + """), packed AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(kind || ':' || a::BIGINT || ':' || z::BIGINT, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base,
  string_agg(kind || ':' || a::BIGINT || ':' || z::BIGINT, ',' ORDER BY a, k) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN packed USING (rid)"""
)
