"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

_OP10 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), grams AS (
  SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
    len(regexp_extract_all(text, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(text, '[0-9]')) AS n_digits
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND 10 * n_symbols <= n_words AND 10 * n_upper <= 3 * n_letters
    AND 2 * n_words <= word_chars AND word_chars <= 40 * n_words
    AND 100 * n_dup_lines <= 50 * n_lines AND 2 * n_digits <= word_chars AS kept
FROM m
"""

_OP7 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS pos FROM later, (SELECT unnest(range(20)) AS k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(pos), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN pos IS NULL THEN w
    ELSE [w[i] for i in range(1, len(w) + 1) if NOT list_contains(pos, i)] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

_OP9 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2)
  UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1
), n AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
FROM (SELECT a AS doc_id, b FROM reach) LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

def _op8() -> str:
    from .licenses import PHRASES, TEMPLATES, THRESHOLD

    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = lambda x: ", ".join(f"('{a}', '{b}')" for a, b in x.items())
    return rf"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all({lower.format("text")}, '{word}') AS w FROM documents
), phrases AS (
  SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {rows(PHRASES)}) AS v(phrase, label)
), places AS (
  SELECT doc_id, i - 1 AS place, label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), phrases WHERE w[i : i + len(p) - 1] = p
), base AS (
  SELECT doc_id, count(*) AS n, min(place) AS first, max(place) AS last, list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), templates AS (
  SELECT name, list_distinct(regexp_extract_all({lower.format("notice")}, '{word}')) AS t FROM (VALUES {rows(TEMPLATES)}) AS v(name, notice)
), blocks AS (
  SELECT doc_id, regexp_extract_all(line, '{word}') AS b
  FROM (SELECT doc_id, unnest(string_split({lower.format("text")}, chr(10))) AS line FROM d)
), own AS (
  SELECT doc_id, max(len(list_intersect(t, b)) / len(t)) AS score, list(DISTINCT name) AS labels
  FROM blocks, templates WHERE len(list_intersect(t, b)) >= {THRESHOLD} * len(t) - 1e-9 GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
  CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(own.score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""


ORACLE: dict[str, str] = {"op7_substring": _OP7, "op8_licenses": _op8(), "op9_neardup": _OP9, "op10_quality": _OP10}
