"""DuckDB SQL for the resampling query: checksums bit by bit from the polynomial, as sums of what each byte adds."""

from __future__ import annotations

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(name: str) -> str:
    return f"""SELECT '{name}' AS side, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM {name}"""


# eight: what a byte adds to the checksum; adds: the same with k bytes after it; opens: what the start value becomes.
ORACLE = f"""WITH RECURSIVE eight AS (SELECT list(x ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x FROM range(256) r(b))),
  docs AS (SELECT row_number() OVER () AS rid, doc_id FROM documents),
  words AS ({_words('documents')} UNION ALL {_words('benchmark')}),
  runs AS (SELECT side, rid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM words),
  counted AS (SELECT side, rid, f, count(*) AS n FROM runs GROUP BY ALL),
  features AS (SELECT DISTINCT f, strlen(f) AS size FROM counted),
  adds AS (SELECT 0 AS k, b, t[b + 1] AS x FROM eight, range(256) r(b) UNION ALL SELECT k + 1, b, xor(x >> 8, t[(x & 255) + 1]) FROM adds, eight WHERE k < (SELECT max(size) FROM features)),
  opens AS (SELECT 0 AS k, 4294967295 AS x UNION ALL SELECT k + 1, xor(x >> 8, t[(x & 255) + 1]) FROM opens, eight WHERE k < (SELECT max(size) FROM features)),
  bytes AS (SELECT f, size, unnest(range(1, size + 1)) AS i FROM features),
  sums AS (SELECT f, size, bit_xor(x) AS x FROM (SELECT f, size, size - i AS k, ('0x' || substr(hex(f), 2 * i - 1, 2))::BIGINT AS b FROM bytes) JOIN adds USING (k, b) GROUP BY ALL),
  bucket_of AS (SELECT f, xor(xor(sums.x, opens.x), 4294967295) % 10000 AS bucket FROM sums JOIN opens ON k = size),
  placed AS (SELECT side, rid, bucket, sum(n) AS n FROM counted JOIN bucket_of USING (f) GROUP BY ALL),
  per AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'documents'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'benchmark'), 0) AS t FROM placed GROUP BY bucket),
  totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM per),
  gains AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM per, totals),
  weighed AS (SELECT rid, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'documents' GROUP BY rid),
  scored AS (SELECT doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM docs JOIN words USING (rid) LEFT JOIN weighed USING (rid) WHERE side = 'documents'),
  drawn AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS k, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN k <= 5 * n // 100 THEN k END AS rank FROM drawn"""
