"""Comparison SQL for proposals, rules, streaming and SQL functions."""

from __future__ import annotations

from oracles.reconcile import SQL as RECONCILE
from oracles.sql import LINES, norm, tokens

_BRANDS = """
brands AS (SELECT p_brand || '.docx' AS file, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS k,
  CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 9 AS t, count(*) AS n FROM part GROUP BY p_brand),
problems AS (SELECT *, CASE t WHEN 1 THEN 'no-table' WHEN 2 THEN 'header-too-deep' WHEN 3 THEN 'no-mass-column' WHEN 4 THEN 'mass-is-name'
  WHEN 5 THEN 'mass-is-volume' WHEN 6 THEN 'mass-unit-differs' ELSE '' END AS problem FROM brands)"""

SQL = {
    "norm_proposal_checks": f"""WITH {_BRANDS}
SELECT file, item, 1.0::DOUBLE AS mass_factor,
  1.0::DOUBLE AS volume_factor, CASE WHEN t <> 0 THEN 'sqm' END AS basis, problem AS problems
FROM problems, (VALUES (0), (1)) i(item) WHERE item = 0 OR t = 8""",
    "norm_proposal_verdicts": f"""WITH {_BRANDS},
told AS (SELECT *, CASE WHEN t = 8 THEN 'table-twice' WHEN problem = '' AND n < 2 THEN 'too-few-entries' ELSE problem END AS p FROM problems)
SELECT file, p = '' AS ok, p AS problems, CASE WHEN p = '' THEN n END AS n, CASE WHEN p = '' THEN n END AS with_mass,
  CASE WHEN p = '' THEN n END AS with_volume FROM told""",
    "norm_proposal_acceptance": f"""WITH {_BRANDS},
told AS (SELECT *, t <> 8 AND problem = '' AND n >= 2 AS ok FROM problems)
SELECT file, ok, CASE WHEN ok AND k % 2 = 1 THEN 1 ELSE 0 END AS n_lost, ok AND k % 2 = 0 AS apply FROM told""",
    "saved_layout_reapplied": """WITH b AS (
  SELECT p_brand || '.docx' AS file, count(*) AS n, count(*) FILTER (WHERE p_size = 7 AND p_retailprice < 1000) AS saved FROM part GROUP BY 1
)
SELECT file, CASE WHEN saved >= 2 THEN 'saved' ELSE 'detected' END AS source, CASE WHEN saved >= 2 THEN saved ELSE n END AS n FROM b""",
    "registry_proposal_verdicts": f"""WITH {LINES},
told AS (SELECT file, k, CASE k WHEN 2 THEN 'no-positive-units,numeric-categories' WHEN 4 THEN 'column-twice,no-header-row'
  WHEN 5 THEN 'no-sheet-proposed' WHEN 6 THEN 'no-sheet' ELSE '' END AS p, count(*) AS n,
  count(DISTINCT category) AS c, count(DISTINCT nullif(zone, '')) AS z, count(DISTINCT nullif(municipality, '')) AS m FROM reg GROUP BY 1, 2)
SELECT file, p = '' AS ok, p AS problems, CASE WHEN p = '' THEN n END AS n_rows, CASE WHEN p = '' THEN k <> 7 END AS has_units,
  CASE WHEN p = '' THEN c END AS n_category, CASE WHEN p = '' THEN z END AS n_zone, CASE WHEN p = '' THEN m END AS n_municipality FROM told""",
    "registry_layout_for_all": """SELECT DISTINCT 'extract_' || l_linenumber || '.xlsx' AS file, 1 AS header_row,
  CASE l_linenumber WHEN 3 THEN 2 WHEN 7 THEN 1 ELSE 3 END AS category, CASE l_linenumber WHEN 7 THEN NULL ELSE 1 END AS units,
  CASE l_linenumber WHEN 3 THEN 0 WHEN 7 THEN 2 ELSE 0 END AS zone,
  CASE WHEN l_linenumber IN (3, 7) THEN 'detected' ELSE 'proposed' END AS layout_source FROM lineitem""",
    "rules_in_force": """SELECT CAST(user_id AS VARCHAR) AS key, 'target ' || arg_max(event_type, event_id) AS template_key
FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'""",
    "rules_round_trip": """WITH last AS (
  SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS e FROM events GROUP BY user_id
),
names AS (SELECT DISTINCT p_name AS k FROM part)
SELECT 'registry' AS kind, key, 'target ' || e AS value FROM last WHERE e <> 'error'
UNION ALL SELECT 'zone', lower(r_name), 'america' FROM region WHERE r_name = 'ASIA'
UNION ALL SELECT 'norm', k, CASE WHEN k LIKE 'red%' THEN 'manual//' || len(k) || '.0' WHEN k LIKE 'old%' THEN 'none/'
  WHEN k LIKE 'cold%' THEN 'single/hot ' || split_part(k, ' ', 2) || '/'
  WHEN k LIKE 'blue%' THEN 'formula/0,5*[@' || upper(k) || '] + (2 - 1)' WHEN k = 'small bolt' THEN 'formula/[@small bolt] / 0'
  WHEN k = 'small gear' THEN 'formula/[nowhere] + 1' ELSE 'formula/-[@' || k || ']*2 +' END
FROM names WHERE regexp_matches(k, '^(red|blue|small|old|cold)')""",
    "parsed_event_rules": """SELECT CAST(props->>'$.k' AS VARCHAR) AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1
UNION ALL SELECT 'user ' || user_id, count(*), NULL FROM events GROUP BY 1""",
    "streamed_groups": f"""WITH e AS (
  SELECT event_type AS zone_key, 'user ' || user_id AS category_key, strftime(ts, '%d') AS day,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS units FROM events
)
SELECT {norm('zone_key')} AS zone_key, category_key, count(*) AS n_rows, count(*) FILTER (WHERE units IS NULL OR units <> 0) AS sources,
  count(*) FILTER (WHERE units = 0) AS zero_sources, round(coalesce(sum(units), 0.0), 4) AS units, count(*) = count(units) AS units_known,
  count(DISTINCT day) AS n_files FROM e GROUP BY 1, 2""",
    "functions_in_sql": f"""SELECT doc_id, md5({norm('text')}) AS key_md5, len({tokens(norm('text'))}) AS n_tokens,
  round(1 - levenshtein(lang, source) / greatest(len(lang), len(source))::DOUBLE, 6) AS ratio, n_chars + 0.5::DOUBLE AS number FROM documents""",
    "stored_layout_norms": """WITH b AS (
  SELECT p_brand || '.docx' AS file, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 5 = 4 OR count(*) < 2 AS other,
    count(*) AS n, sum(p_retailprice) AS mass, sum(p_size)::DOUBLE AS volume FROM part GROUP BY p_brand
)
SELECT file, CASE WHEN other THEN 'detected' ELSE 'saved' END AS source, CASE WHEN other THEN 'other' ELSE 'plot' END AS basis, n,
  round(CASE WHEN other THEN mass ELSE mass * 1000 END, 2) AS mass, round(volume, 2) AS volume FROM b""",
    "stored_markup_rows": f"""WITH {LINES}
SELECT file, count(*) AS n_rows, count(DISTINCT CASE WHEN k = 7 THEN zone WHEN k = 3 THEN category ELSE zone END) AS n_category,
  count(DISTINCT CASE WHEN k = 3 THEN zone WHEN k = 7 THEN municipality ELSE category END) AS n_zone, coalesce(sum(CASE WHEN k = 7 THEN 0.0 ELSE units END), 0.0) AS units
FROM reg WHERE k = 3 OR zone <> '' GROUP BY file""",
}
SQL["stored_layouts_round_trip"] = f"""WITH tables AS (SELECT *, row_number() OVER (ORDER BY table_idx DESC) - 1 AS place FROM ({RECONCILE['norm_layouts']})),
beside AS (SELECT kind, count(*) AS n FROM ({SQL['rules_round_trip']}) GROUP BY kind)
SELECT 'norms' AS kind, table_idx, concat_ws('/', place, 3, name_column, unit_column, mass_column, volume_column, '1000.0', '-', 'plot', 'помощник') AS value FROM tables
UNION ALL SELECT 'registry', 0, '1/2/1/0/-/-/помощник' FROM lineitem WHERE l_linenumber = 3 HAVING count(*) > 0
UNION ALL SELECT k.name, NULL, coalesce(n, 0)::VARCHAR FROM (VALUES ('norm', 'norms rules'), ('registry', 'registry rules'), ('zone', 'zones rules')) k(kind, name)
  LEFT JOIN beside USING (kind)"""

SQL["streamed_form"] = RECONCILE["filled_form"]
SQL["form_rows_after_edits"] = RECONCILE["reconciled_rows_with_rules"]
