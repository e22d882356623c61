"""Queries of the operators in DuckDB's SQL, where it can express them, and the parts of results that it can."""

from __future__ import annotations

from .exact_dedup import LOWER, UPPER

_WORD = r"[^\x20\x09-\x0D]"
#: CRC-32 of a text's ASCII characters, bit by bit.
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
)

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) x(i) WHERE len(w) >= 13),
leads AS (SELECT k, min(doc_id) AS lead FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN leads USING (k), range(13) t(j) WHERE lead < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
spans AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before <> p - 1) AS m FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(m, 0)::BIGINT AS n_spans
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

LINES = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
windows AS (SELECT doc_id, i, 1 AS more, ls[i] || chr(10) || ls[i + 1] AS c FROM l, unnest(range(1, len(ls))) x(i) UNION ALL SELECT doc_id, 1, 0, ls[1] FROM l WHERE len(ls) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id, i) AS r, coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY i) = c AND lag(i) OVER (PARTITION BY doc_id ORDER BY i) = i - 1, false) AS again
  FROM windows WHERE regexp_matches(c, '{_WORD}')),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM ranked, range(2) t(j) WHERE r > 1 AND j <= more AND NOT (again AND j = 0)),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM l),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t FROM lines ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

BASE_MODEL = f"""
WITH d AS (SELECT doc_id, {_CRC32.format("doc_id::VARCHAR")} % 10 = 0 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}+'), ' ') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id
"""
