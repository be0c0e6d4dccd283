"""Comparison SQL for the layout queries."""

from __future__ import annotations

_WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

WORDS = f"""
clean AS (SELECT doc_id AS doc, string_split(trim(regexp_replace(text, '{_WS}+', ' ', 'g')), ' ') AS w FROM documents
  WHERE trim(regexp_replace(text, '{_WS}+', ' ', 'g')) <> ''),
words AS (SELECT doc, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS pos FROM clean)"""

CELLS = f"""{WORDS},
placed AS (SELECT doc, pos // 240 AS page, (pos % 240) // 8 AS row, (pos % 8) // 2 AS cell, pos % 2 AS line, text, pos FROM words),
kept AS (SELECT *, cell * 100.0::DOUBLE + 50 AS x, row * 40.0::DOUBLE + line * 11.2::DOUBLE + 40 AS y FROM placed WHERE row % 10 <> 0 OR cell = 0),
cells AS (
  SELECT doc, page, row, cell,
    max(CASE WHEN line = 0 THEN text END) || coalesce(CASE WHEN
      regexp_matches(max(CASE WHEN line = 0 THEN text END), '\\S[-‑–]$') AND regexp_matches(max(CASE WHEN line = 1 THEN text END), '^[a-zа-яё]')
      THEN '' ELSE ' ' END || max(CASE WHEN line = 1 THEN text END), '') AS text
  FROM kept GROUP BY 1, 2, 3, 4
),
rows AS (SELECT doc, page, row, count(*) AS n, string_agg(text, '|' ORDER BY cell) AS line FROM cells GROUP BY 1, 2, 3),
blocked AS (SELECT doc, page, row // 10 AS b, row, n FROM rows WHERE n >= 2),
numbered AS (
  SELECT doc, page, b, dense_rank() OVER (PARTITION BY doc, page ORDER BY b) - 1 AS block, count(*) AS n_rows, max(n) AS n_columns
  FROM blocked GROUP BY 1, 2, 3
)"""

SCAN = f"""{WORDS},
placed AS (SELECT doc, pos // 200 AS page, (pos % 200) // 4 AS row, pos % 4 AS cell, text, count(*) OVER (PARTITION BY doc, pos // 200) AS n FROM words),
scan AS (SELECT * FROM placed WHERE n >= 20)"""

SQL = {
    "scanned_documents": f"""WITH lines AS (SELECT doc_id AS doc, regexp_replace(unnest(string_split(text, chr(10))), '^{_WS}+|{_WS}+$', '', 'g') AS text FROM documents)
SELECT doc, count(*) AS n_fragments, count(*) FILTER (WHERE regexp_matches(text, '{_WS}')) AS n_multi_word,
  count(*) FILTER (WHERE regexp_matches(text, '{_WS}')) < count(*) * 0.2 AS scanned
FROM lines WHERE text <> '' GROUP BY doc""",
    "page_measures": f"""WITH {CELLS},
steps AS (SELECT doc, page, x, y - lag(y) OVER w AS gap, abs(x - lag(x) OVER w) AS aside FROM kept WINDOW w AS (PARTITION BY doc, page ORDER BY pos))
SELECT doc, page, 9.0::DOUBLE AS text_height,
  round(coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY gap DESC) FILTER (WHERE aside < 0.5 AND gap > 1.8 AND gap < 27), 11.25), 6) AS pitch,
  array_to_string(list_sort(list(DISTINCT x)), '|') AS columns
FROM steps GROUP BY 1, 2""",
    "page_rows": f"""WITH {CELLS}
SELECT doc, page, count(*) AS n_rows, sum(n)::BIGINT AS n_cells, md5(string_agg(line, '/' ORDER BY row)) AS digest FROM rows GROUP BY 1, 2""",
    "page_blocks": f"""WITH {CELLS}
SELECT doc, page, block, n_rows, 1 AS n_caption,
  array_to_string(list_transform(range(0, n_columns), lambda c: c * 100.0::DOUBLE + 50), '|') AS edges FROM numbered""",
    "document_tables": f"""WITH {CELLS},
opened AS (
  SELECT *, sum(CASE WHEN page > 0 AND b = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, block) AS t FROM numbered
),
tails AS (
  SELECT o.doc, lag(o.page) OVER w AS page, lag(o.b) OVER w AS b, c.text AS tail, o.page > 0 AND o.b = 0 AS carried
  FROM opened o LEFT JOIN cells c ON c.doc = o.doc AND c.page = o.page AND c.row = 0 AND c.cell = 0
  WINDOW w AS (PARTITION BY o.doc ORDER BY o.page, o.block)
),
ends AS (SELECT doc, page, row // 10 AS b, max(row) AS row FROM blocked GROUP BY 1, 2, 3),
carried AS (SELECT e.doc, e.page, e.row, t.tail FROM tails t JOIN ends e ON e.doc = t.doc AND e.page = t.page AND e.b = t.b WHERE t.carried),
width AS (SELECT doc, t, max(n_columns) AS n_columns FROM opened GROUP BY 1, 2),
laid AS (
  SELECT r.doc, o.t, r.page, r.row, w.n_columns,
    CASE WHEN c.tail IS NULL THEN r.line ELSE
      CASE WHEN r.n > 1 THEN regexp_replace(r.line, '^([^|]*)', '') END END AS rest,
    r.line, c.tail, r.n
  FROM rows r JOIN blocked k ON k.doc = r.doc AND k.page = r.page AND k.row = r.row
  JOIN opened o ON o.doc = r.doc AND o.page = r.page AND o.b = r.row // 10
  JOIN width w ON w.doc = o.doc AND w.t = o.t
  LEFT JOIN carried c ON c.doc = r.doc AND c.page = r.page AND c.row = r.row
),
filled AS (
  SELECT l.doc, l.t, l.page, l.row, l.n_columns,
    CASE WHEN l.tail IS NULL THEN l.line ELSE f.text || ' ' || l.tail || substr(l.line, len(f.text) + 1) END
      || repeat('|', (l.n_columns - l.n)::INTEGER) AS line
  FROM laid l JOIN cells f ON f.doc = l.doc AND f.page = l.page AND f.row = l.row AND f.cell = 0
),
heads AS (SELECT doc, t, min(page * 1048576 + block) AS table_place, arg_min(page, (page, block)) AS page, arg_min(b, (page, block)) AS b FROM opened GROUP BY 1, 2)
SELECT h.doc, h.table_place, c.text AS title, count(*) AS n_rows, max(f.n_columns) AS n_columns,
  md5(string_agg(f.line, '/' ORDER BY f.page, f.row)) AS digest
FROM heads h JOIN filled f ON f.doc = h.doc AND f.t = h.t
JOIN cells c ON c.doc = h.doc AND c.page = h.page AND c.row = h.b * 10 AND c.cell = 0
GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    "single_page_tables": f"""WITH {CELLS}
SELECT n.doc, n.page, block, n_rows, n_columns, c.text AS title FROM numbered n
JOIN cells c ON c.doc = n.doc AND c.page = n.page AND c.row = n.b * 10 AND c.cell = 0 WHERE n_rows >= 2""",
    "scan_slopes": f"""WITH {SCAN}
SELECT doc, page, 10.0::DOUBLE AS text_height, max(row) + 1 AS n_lines, true AS found FROM scan GROUP BY 1, 2""",
    "scan_runs": f"""WITH {SCAN}
SELECT doc, page, count(*) AS n_runs, count(*) AS n_words, round(sum(least(len(text) * 5.2::DOUBLE, 60.0)), 4) AS length FROM scan GROUP BY 1, 2""",
    "scan_bands": f"WITH {SCAN} SELECT doc, page, '100|200|300|400' AS starts FROM scan GROUP BY 1, 2",
    "scan_forced_bands": f"WITH {SCAN} SELECT doc, page, 2 AS n FROM scan GROUP BY 1, 2",
    "scan_tables": f"""WITH {SCAN},
full_rows AS (SELECT doc, page, n // 4 AS k FROM scan GROUP BY 1, 2, 3),
texts AS (
  SELECT s.doc, s.page, least(row, k - 1) AS r, cell, string_agg(text, ' ' ORDER BY row) AS text
  FROM scan s JOIN full_rows f ON f.doc = s.doc AND f.page = s.page GROUP BY 1, 2, 3, 4
),
lines AS (SELECT doc, page, r, string_agg(text, '|' ORDER BY cell) AS line FROM texts GROUP BY 1, 2, 3)
SELECT doc, page, count(*) AS n_rows, md5(string_agg(line, '/' ORDER BY r)) AS digest FROM lines GROUP BY 1, 2""",
    "value_clusters": """WITH v AS (SELECT DISTINCT user_id, value FROM events),
g AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS gap FROM v)
SELECT user_id, count(*) AS n_clusters, round(sum(value), 6) AS starts FROM g WHERE gap IS NULL OR gap > 1 GROUP BY 1""",
    "nearest_edges": """WITH e AS (
  SELECT p_type, p_size * 30.0::DOUBLE AS edge, dense_rank() OVER (PARTITION BY p_type ORDER BY p_size) - 1 AS i FROM part GROUP BY 1, 2, p_size
)
SELECT p_partkey, arg_min(i, (abs(edge - p_retailprice), i)) AS edge,
  coalesce(min(i) FILTER (WHERE p_retailprice < edge), max(i)) AS row
FROM part JOIN e USING (p_type) GROUP BY 1""",
    "nearest_bands": """WITH e AS (
  SELECT p_type, p_size * 30.0::DOUBLE AS edge, dense_rank() OVER (PARTITION BY p_type ORDER BY p_size) - 1 AS i FROM part GROUP BY 1, 2, p_size
)
SELECT p_partkey, arg_min(i, (CASE WHEN p_retailprice < edge THEN edge - p_retailprice ELSE greatest(0.0, p_retailprice - edge - 40) END, i)) AS band
FROM part JOIN e USING (p_type) GROUP BY 1""",
}
