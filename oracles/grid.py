"""Comparison SQL for the grid queries."""

from __future__ import annotations

from oracles.sql import NORMS

_ALLOWED = """
sizes AS (
  SELECT len(bin(event_id + 1)) - 1 AS table_idx, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1
  ORDER BY 1 LIMIT 12
),
ranked AS (SELECT *, row_number() OVER (ORDER BY n, table_idx) AS i, count(*) OVER () AS k FROM sizes),
given AS (
  SELECT i, table_idx, least(n, 1250 // k, 400) AS allowance, 1250 - least(n, 1250 // k, 400) AS budget FROM ranked WHERE i = 1
  UNION ALL
  SELECT r.i, r.table_idx, least(r.n, g.budget // (r.k - r.i + 1), 400), g.budget - least(r.n, g.budget // (r.k - r.i + 1), 400)
  FROM given g JOIN ranked r ON r.i = g.i + 1
)"""

SQL = {
    "dense_rows": """WITH counted AS (
  SELECT o_orderpriority AS file, o_custkey AS row_idx, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL
),
rows AS (SELECT file, row_idx FROM counted GROUP BY 1, 2 HAVING count(*) FILTER (WHERE n <> 2) > 0)
SELECT r.file, 0 AS table_idx, r.row_idx,
  string_agg(CASE WHEN n <> 2 THEN CAST(n AS VARCHAR) ELSE '' END, '|' ORDER BY k.m) AS cells
FROM rows r CROSS JOIN range(1, 14) k(m) LEFT JOIN counted c ON c.file = r.file AND c.row_idx = r.row_idx AND c.m = k.m
GROUP BY 1, 2, 3""",
    "expanded_spans": """WITH cells AS (
  SELECT l_orderkey AS row_idx, l_linenumber AS c, count(*) % 3 + 1 AS span, min(l_returnflag) AS value FROM lineitem GROUP BY 1, 2
),
placed AS (
  SELECT *, coalesce(sum(span) OVER (PARTITION BY row_idx ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM cells
)
SELECT 'order.docx' AS file, 0 AS table_idx, row_idx, CAST(unnest(range(start::BIGINT, (start + span)::BIGINT)) AS INTEGER) AS col_idx, value FROM placed""",
    "filled_down": """WITH cells AS (
  SELECT l_suppkey AS t, l_linenumber - 1 AS r, CAST(l_quantity AS INTEGER) % 4 AS c, count(*) AS n,
    CASE WHEN count(*) % 2 = 0 THEN '' ELSE min(l_returnflag) || count(*) END AS v
  FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) % 5 > 0
),
second AS (
  SELECT a.t, a.c, CASE WHEN a.v = '' THEN coalesce(b.v, '') ELSE a.v END AS v
  FROM cells a LEFT JOIN cells b ON a.t = b.t AND a.c = b.c AND b.r = 0 WHERE a.r = 1
)
SELECT 'order.docx' AS file, t AS table_idx, r AS row_idx, c AS col_idx, v AS value FROM cells WHERE r = 0 OR r > 2
UNION ALL SELECT 'order.docx', t, 1, c, v FROM second
UNION ALL SELECT 'order.docx', a.t, 2, a.c, CASE WHEN a.v = '' THEN coalesce(b.v, '') ELSE a.v END
FROM cells a LEFT JOIN second b ON a.t = b.t AND a.c = b.c WHERE a.r = 2""",
    "table_captions": """WITH body AS (
  SELECT o_orderpriority AS file, o_orderkey AS seq, o_orderstatus = 'F' AS is_table,
    CASE WHEN o_custkey % 5 = 0 THEN '' ELSE o_orderstatus || o_custkey END AS text,
    count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)
      - CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS island
  FROM orders
),
said AS (
  SELECT file, island, text, seq FROM body WHERE NOT is_table AND text <> ''
  QUALIFY row_number() OVER (PARTITION BY file, island ORDER BY seq DESC) <= 4
)
SELECT b.file, b.island AS table_idx, coalesce(string_agg(s.text, ' ' ORDER BY s.seq), '') AS caption
FROM body b LEFT JOIN said s ON s.file = b.file AND s.island = b.island WHERE b.is_table GROUP BY 1, 2""",
    "service_rows": """SELECT p_partkey, p_size % 6 <> 2 AS significant, p_size % 6 = 0 AS spanning, p_size % 6 = 3 AS numbering,
  p_size % 6 IN (0, 1, 3) AS service FROM part""",
    "split_tables": """WITH rows AS (
  SELECT p_brand || '.pdf' AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_idx,
    p_partkey % 10 IN (0, 9) AS soft, p_partkey % 10 = 0 AS units FROM part
),
islands AS (SELECT *, sum(CASE WHEN soft THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY row_idx) AS hard FROM rows),
cuts AS (
  SELECT file, min(row_idx) AS cut FROM islands WHERE soft GROUP BY file, hard HAVING bool_or(units) AND min(row_idx) > 0
),
placed AS (SELECT r.file, r.row_idx, count(c.cut) AS part FROM rows r LEFT JOIN cuts c ON c.file = r.file AND c.cut <= r.row_idx GROUP BY 1, 2)
SELECT file, part, count(*) AS n_rows, min(row_idx) AS first_row, count(*) - 1 AS last_part_row FROM placed
GROUP BY 1, 2 HAVING count(*) > 1""",
    "header_samples": """SELECT DISTINCT 'extract_' || l_linenumber || '.xlsx' AS file, 0 AS table_idx, s.i AS sample_row,
  CASE WHEN s.i = 0 THEN 'Выгрузка реестра'
    WHEN l_linenumber = 3 THEN 'Зона деятельности|Количество расчетных единиц|Категория потребителя'
    WHEN l_linenumber = 7 THEN 'Муниципальное образование|Категория потребителя|Зона деятельности'
    ELSE 'Категория потребителя|Количество расчетных единиц|Зона деятельности|Муниципальное образование' END AS cells
FROM lineitem, (VALUES (0), (1)) s(i)""",
    "sample_allowances": f"WITH RECURSIVE {_ALLOWED} SELECT 'order.docx' AS file, table_idx, 16 AS width, allowance FROM given",
    "norms_sample": f"""WITH RECURSIVE {_ALLOWED}
SELECT 'order.docx' AS file, table_idx, allowance AS n_rows, allowance - 1 AS last, 16 AS width FROM given""",
    "file_kinds": """WITH s AS (SELECT replace(s_name, '#', '_') AS name, s_suppkey % 9 AS t FROM supplier)
SELECT name || CASE t WHEN 0 THEN '.docx' WHEN 5 THEN '_Нормативы.xlsx' WHEN 6 THEN '_Общие сведения.xlsx' WHEN 7 THEN '_реестр.xlsx' ELSE '.xlsx' END AS file,
  CASE t WHEN 0 THEN 'norms' WHEN 1 THEN 'template' WHEN 2 THEN 'norms' WHEN 3 THEN 'registry' WHEN 5 THEN 'norms' WHEN 6 THEN 'template'
    WHEN 7 THEN 'registry' ELSE 'unknown' END AS kind FROM s""",
    "norm_skipped_tables": """SELECT 'order.docx' AS file, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) + 10 AS table_idx, count(*) AS n_rows
FROM part GROUP BY 2 HAVING count(*) > 1""",
    "explicit_norm_layouts": f"""WITH {NORMS}
SELECT table_idx, row_number() OVER (ORDER BY -table_idx, pos) - 1 AS pos, name, 'place' AS basis,
  CASE WHEN table_idx = 1 THEN raw_mass ELSE raw_volume END AS mass, CASE WHEN table_idx = 4 THEN raw_mass END AS volume
FROM norms WHERE table_idx IN (1, 4)""",
    "explicit_norm_layout_errors": """SELECT 'order.docx' AS file, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) + 10 AS table_idx, 'no-table' AS reason
FROM part GROUP BY p_brand
UNION ALL SELECT DISTINCT 'order.docx', t, 'nothing-read' FROM part,
  (VALUES (1), (2), (3)) x(t) WHERE p_type = ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][t + 1]""",
}
