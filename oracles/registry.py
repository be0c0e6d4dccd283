"""Comparison SQL for the registry queries."""

from __future__ import annotations

from oracles.sql import KEYED, LINES

SQL = {
    "registry_scan": f"""WITH {LINES}
SELECT file, excel_row, category, units, units_missing, unreadable, zone, municipality, has_units FROM reg""",
    "registry_header_columns": """
SELECT DISTINCT 'extract_' || l_linenumber || '.xlsx' AS file, 0 AS table_idx, 1 AS header_row,
  CASE l_linenumber WHEN 3 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS category,
  CASE WHEN l_linenumber <> 7 THEN 1 END AS units,
  CASE l_linenumber WHEN 3 THEN 0 ELSE 2 END AS zone,
  CAST(NULL AS INTEGER) AS unit_name,
  CASE l_linenumber WHEN 3 THEN NULL WHEN 7 THEN 0 ELSE 3 END AS municipality,
  CAST(NULL AS INTEGER) AS source,
  CASE l_linenumber WHEN 3 THEN 5 WHEN 7 THEN 4 ELSE 6 END AS score
FROM lineitem""",
    "registry_best_sheet": f"""WITH {LINES},
lengths AS (
  SELECT file, 0 AS table_idx, max(excel_row) AS length FROM reg GROUP BY file
  UNION ALL SELECT file, 1, max(CASE WHEN (excel_row - 1) % 3 = 0 THEN excel_row END) FROM reg GROUP BY file
)
SELECT file, CAST(arg_min(table_idx, (-length, table_idx)) AS INTEGER) AS table_idx, 1 AS header_row
FROM lengths GROUP BY file""",
    "registry_explicit_layout": f"""WITH {LINES},
read AS (
  SELECT file, category, units, CASE WHEN k = 3 THEN '' ELSE zone END AS zone,
         CASE WHEN k = 3 THEN zone ELSE municipality END AS municipality FROM reg
),
cells AS (SELECT file, zone, municipality, category, count(*) AS n, sum(units) AS u FROM read GROUP BY ALL)
SELECT file, sum(n)::BIGINT AS n_rows, count(*) FILTER (WHERE zone = '') AS without_zone,
  count(DISTINCT municipality) AS n_municipalities, coalesce(sum(u), 0.0) AS units
FROM cells GROUP BY file""",
    "registry_groups": f"WITH {KEYED} SELECT * FROM groups",
    "registry_group_files": f"""WITH {KEYED}
SELECT DISTINCT zone_key, municipality_key, category_key, file FROM keyed""",
    "registry_categories": f"""WITH {KEYED}
SELECT category_key, arg_min(category, (file, excel_row)) AS name, count(*) AS n_rows,
  coalesce(sum(units), 0.0) AS units, count(*) = count(units) AS units_known,
  count(*) FILTER (WHERE units IS NULL OR units <> 0) AS sources, count(DISTINCT zone) AS n_zones,
  arg_min(file, (file, excel_row)) AS first_file, arg_min(excel_row, (file, excel_row)) AS first_row
FROM keyed GROUP BY category_key ORDER BY n_rows DESC, first_file, first_row""",
    "registry_zones": f"""WITH {KEYED}
SELECT zone_key, arg_min(zone, (file, excel_row)) AS name, count(*) AS n_rows,
  arg_min(file, (file, excel_row)) AS first_file, arg_min(excel_row, (file, excel_row)) AS first_row
FROM keyed GROUP BY zone_key ORDER BY n_rows DESC, first_file, first_row""",
    "registry_municipalities": f"""WITH {KEYED}
SELECT municipality_key, arg_min(municipality, (file, excel_row)) AS name, count(*) AS n_rows,
  arg_min(file, (file, excel_row)) AS first_file, arg_min(excel_row, (file, excel_row)) AS first_row
FROM keyed WHERE municipality_key <> '' GROUP BY municipality_key ORDER BY n_rows DESC, first_file, first_row""",
    "registry_totals": f"""WITH {LINES}
SELECT count(*) AS total_rows, count(*) FILTER (WHERE units = 0) AS zero_rows,
  count(*) FILTER (WHERE units IS NULL) AS rows_without_units, bool_and(has_units) AS has_units FROM reg""",
    "registry_file_stats": f"""WITH {LINES}
SELECT file, count(*) AS n_rows, bool_and(has_units) AS has_units,
  count(*) FILTER (WHERE unreadable) AS warnings_total FROM reg GROUP BY file
UNION ALL SELECT 'extract_0.xlsx', 0, true, 0""",
    "unread_files": """
SELECT 'extract_9.xlsx' AS file, 'no-header' AS reason, count(*) AS n_rows FROM lineitem WHERE l_linenumber = 2 HAVING count(*) > 0""",
    "registry_distinct_names": f"""WITH {LINES}
SELECT file, count(DISTINCT nullif(category, '')) AS n_category, count(DISTINCT nullif(zone, '')) AS n_zone,
  count(DISTINCT nullif(municipality, '')) AS n_municipality FROM reg GROUP BY file""",
    "registry_warnings": f"""WITH {LINES},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY excel_row, raw_units, category) AS place
  FROM reg WHERE unreadable
)
SELECT file, place, excel_row, raw_units FROM ranked WHERE place <= 50""",
    "csv_extracts": f"""WITH {LINES}
SELECT k AS extract, count(DISTINCT (excel_row - 1) % 4) AS n_files, count(*) AS n_rows, count(*) FILTER (WHERE units IS NULL) AS n_unknown,
  count(*) FILTER (WHERE unreadable) AS n_unreadable, count(DISTINCT category) AS n_category, coalesce(sum(units), 0.0) AS units
FROM reg GROUP BY k""",
}
