"""DuckDB SQL of the joins on words, by plain joins over all shingles or windows; doc_id is unique in documents."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard(k: int = 3, num: int = 90, den: int = 100) -> str:
    """Rows of op5: set sizes and the least doc_id that links reach."""
    last = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: {last}) END) AS s FROM word
), sized AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n FROM shingle
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b
  ON a.s = b.s AND a.doc_id < b.doc_id AND a.n * {den} >= b.n * {num} AND b.n * {den} >= a.n * {num}
  GROUP BY a.doc_id, b.doc_id HAVING {den} * count(*) >= {num} * (any_value(a.n) + any_value(b.n) - count(*))
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(x, y) AS (
  SELECT a, b FROM edge UNION SELECT r.x, e.b FROM reach r JOIN edge e ON r.y = e.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id) n ON n.doc_id = d.doc_id
LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id"""


def decontaminate(window: int = 10) -> str:
    """Rows of op6: words hit by windows, and the items whose windows occur."""
    word = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH doc AS (
  SELECT doc_id, {word} AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {word} AS w FROM benchmark WHERE item_id IS NOT NULL
), test AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item, w, least({window}, len(w)) AS n, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), placed AS (
  SELECT doc_id, len(w) AS size, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc
), run AS (
  SELECT doc_id, i, n, size, string_agg(word, ' ') OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND (n - 1) FOLLOWING) AS s
  FROM placed, (SELECT DISTINCT n FROM test)
), found AS (
  SELECT r.doc_id, r.i, r.n, t.item FROM run r JOIN test t ON r.n = t.n AND r.s = t.s WHERE r.i <= r.size - r.n + 1
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(k.n_items, 0) AS n_items,
  sha256(coalesce(k.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN held k ON k.doc_id = d.doc_id"""
