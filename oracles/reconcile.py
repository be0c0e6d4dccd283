"""Comparison SQL for the form, norm, mapping and result queries."""

from __future__ import annotations

from oracles.sql import CANDIDATES, FORM, KEYED, LAST_NORMS, NORMS, REGISTRY_CANDIDATES, norm, r, recon

_NORM_CHAIN = f"{FORM}, {NORMS}, {CANDIDATES}"
_CATEGORY_CHAIN = f"{KEYED}, {FORM}, {REGISTRY_CANDIDATES}"

_RESULT = """excel_row, idx, zone_key, municipality_key, category_key, duplicate, sources, units, units_known,
  registry_rows, zero_sources, round(norm_mass, 6) AS norm_mass, round(norm_volume, 6) AS norm_volume,
  round(mass, 6) AS mass, round(volume, 6) AS volume, round(density, 6) AS density"""

_SIDES = """
sides AS (
  SELECT (SELECT coalesce(sum(units), 0.0) FROM groups) AS registry_units,
    (SELECT coalesce(sum(sources), 0)::BIGINT FROM groups) AS registry_sources,
    (SELECT coalesce(sum(units), 0.0) FROM results) AS form_units,
    (SELECT coalesce(sum(sources), 0)::BIGINT FROM results) AS form_sources,
    (SELECT coalesce(sum(units), 0.0) FROM unassigned) AS outside_units,
    (SELECT coalesce(sum(sources), 0)::BIGINT FROM unassigned) AS outside_sources
)"""


def _row_issues(basis: str) -> str:
    """Checks of single rows; ``basis`` is a relation key, mode, status, auto, entry, name, basis."""
    mass, volume = f"coalesce({r('mass', 2)}, 0.0)", f"coalesce({r('volume', 2)}, 0.0)"
    return f"""
  SELECT 'warning' AS level, 'duplicate' AS code, excel_row, zone, category, NULL AS note, NULL::DOUBLE AS units FROM results WHERE duplicate
  UNION ALL SELECT 'error', 'formula', excel_row, zone, category, norm_error, NULL FROM results WHERE norm_error IS NOT NULL
  UNION ALL SELECT 'error', 'no-norm', excel_row, zone, category, NULL, units FROM results
    WHERE norm_mass IS NULL AND norm_volume IS NULL AND (units > 0 OR sources > 0)
  UNION ALL SELECT 'warning', 'half-norm', excel_row, zone, category, CASE WHEN norm_mass IS NULL THEN 'volume' ELSE 'mass' END, NULL
    FROM results WHERE (norm_mass IS NULL) <> (norm_volume IS NULL)
  UNION ALL SELECT 'warning', 'unconfirmed', excel_row, zone, category, b.name, NULL FROM results JOIN {basis} b ON b.key = category_key
    WHERE b.auto AND b.status = 'weak' AND b.entry IS NOT NULL
  UNION ALL SELECT 'warning', 'basis', excel_row, zone, category, b.basis, NULL FROM results f JOIN {basis} b ON b.key = category_key
    WHERE b.mode = 'single' AND b.basis <> 'other' AND f.unit <> ''
      AND b.basis <> CASE f.unit WHEN 'Человек' THEN 'person' ELSE 'sqm' END
  UNION ALL SELECT 'warning', 'density', excel_row, zone, category, NULL, NULL FROM results
    WHERE NOT (norm_mass IS NULL AND norm_volume IS NULL) AND units > 0 AND {volume} > 0
      AND abs(coalesce({r('density', 2)}, 0.0) - {r(f'{mass} / nullif({volume}, 0)', 2)}) > 0.02"""


_PLAIN = """(SELECT m.key, 'single' AS mode, m.status, true AS auto, m.entry_id AS entry, n.name, n.basis
    FROM norm_map m LEFT JOIN norms n ON n.id = m.entry_id)"""
_RULED = """(SELECT m.key, m.mode, m.status, m.auto, m.entry_id AS entry, n.name, n.basis
    FROM ruled_norms m LEFT JOIN norms n ON n.id = m.entry_id)"""

_ISSUES = f"""{recon()}, {_SIDES}, row_issues AS ({_row_issues(_PLAIN)}),
all_issues AS (
  SELECT level, code, excel_row, zone, category, note, NULL::BIGINT AS n_rows, units, NULL::BIGINT AS sources FROM row_issues
  UNION ALL SELECT 'error', 'balance', NULL, NULL, NULL, NULL, NULL, NULL, registry_sources FROM sides
    WHERE abs(round(registry_units - form_units - outside_units, 6)) >= 1e-6 OR registry_sources <> form_sources + outside_sources
  UNION ALL SELECT 'error', 'unassigned', NULL, zone, category, reason, n_rows, units, sources FROM unassigned
  UNION ALL SELECT 'error', 'no-units', NULL, NULL, NULL, NULL, count(*), NULL, NULL FROM reg HAVING NOT bool_and(has_units)
  UNION ALL SELECT 'info', 'zero-sources', NULL, NULL, NULL, NULL, count(*) FILTER (WHERE units = 0), NULL, NULL FROM reg
    HAVING count(*) FILTER (WHERE units = 0) > 0
)"""

_SUMMARY = f"""
  SELECT count(*) AS template_rows, count(*) FILTER (WHERE units > 0 OR sources > 0) AS rows_with_data,
    count(*) FILTER (WHERE NOT (units > 0 OR sources > 0)) AS rows_empty,
    count(*) FILTER (WHERE norm_mass IS NULL AND norm_volume IS NULL) AS rows_without_norm,
    (SELECT count(*) FROM reg) AS registry_rows, (SELECT count(*) FILTER (WHERE units = 0) FROM reg) AS registry_zero_rows,
    (SELECT count(*) FROM reg_cats) AS registry_categories, sum(sources)::BIGINT AS total_sources,
    {r('sum(units)', 2)} AS total_units, {r(f"sum({r('mass', 2)})", 2)} AS total_mass, {r(f"sum({r('volume', 2)})", 2)} AS total_volume,
    {r(f"sum({r('mass', 2)}) / nullif(sum({r('volume', 2)}), 0)", 3)} AS average_density,
    (SELECT coalesce(sum(n_groups), 0)::BIGINT FROM unassigned) AS unassigned_groups,
    (SELECT count(*) FILTER (WHERE level = 'error') FROM all_issues) AS errors,
    (SELECT count(*) FILTER (WHERE level = 'warning') FROM all_issues) AS warnings
  FROM results"""

_STATUS = """CASE {} WHEN 'exact' THEN 'Точное совпадение' WHEN 'auto' THEN 'Сопоставлено автоматически'
  WHEN 'weak' THEN 'Похоже, требует проверки' WHEN 'none' THEN 'Не найдено' WHEN 'manual' THEN 'Задано вручную'
  WHEN 'formula' THEN 'Формула' WHEN 'ignored' THEN 'Исключено вручную' END"""
_BASIS = """CASE {} WHEN 'person' THEN 'на 1 человека' WHEN 'place' THEN 'на 1 место' WHEN 'sqm' THEN 'на 1 м²'
  WHEN 'other' THEN 'иная' ELSE '' END"""
_PERCENT = "CAST(floor({} * 100 + 0.5)::BIGINT AS VARCHAR) || ' %'"

_SUMMARY_PAIRS = ", ".join(
    f"('{label}', CAST(s.{column} AS VARCHAR))"
    for column, label in {
        "template_rows": "Строк в файле общих сведений",
        "rows_with_data": "Из них с данными реестра",
        "rows_empty": "Из них без данных (нули)",
        "rows_without_norm": "Категорий без норматива",
        "registry_rows": "Строк в реестре ИОО",
        "registry_zero_rows": "Из них с нулевым количеством единиц",
        "registry_categories": "Уникальных категорий в реестре",
        "total_sources": "Итого источников (столбец F)",
        "unassigned_groups": "Групп реестра вне файла",
        "errors": "Ошибок",
        "warnings": "Предупреждений",
    }.items()
)

_DECIMAL = r"regexp_replace(CAST(CAST({} AS DECIMAL(38, 6)) AS VARCHAR), '\.?0+$', '')"
_SUMMARY_FIGURES = ", ".join(
    f"('{label}', coalesce({_DECIMAL.format('s.' + column)}, ''))"
    for column, label in {
        "total_units": "Итого расчётных единиц (столбец G)",
        "total_mass": "Итого расчётная масса, т",
        "total_volume": "Итого расчётный объем, м³",
        "average_density": "Средний коэффициент плотности, т/м³",
    }.items()
)
_TITLES = """CASE code WHEN 'balance' THEN 'Расхождение с реестром' WHEN 'unassigned' THEN 'Данные реестра не попали в файл'
  WHEN 'duplicate' THEN 'Повторяющаяся строка шаблона' WHEN 'formula' THEN 'Ошибка в формуле норматива'
  WHEN 'no-norm' THEN 'Нет норматива при наличии данных' WHEN 'half-norm' THEN 'Норматив задан частично'
  WHEN 'unconfirmed' THEN 'Сопоставление не подтверждено' WHEN 'basis' THEN 'Разные расчётные единицы'
  WHEN 'density' THEN 'Плотность не сходится с массой и объёмом' WHEN 'no-units' THEN 'В реестре нет количества расчётных единиц'
  WHEN 'zero-sources' THEN 'Источники с нулевым количеством единиц' END"""

SQL = {
    "form_header_roles": """
SELECT 'form.xlsx' AS file, 0 AS table_idx, 0 AS header_row, 11 AS last_header_column, 1 AS subject, 2 AS zone,
  3 AS municipality, 4 AS category, 5 AS unit, 6 AS sources, 11 AS registry_units, 7 AS units, 8 AS mass, 9 AS volume,
  10 AS density, CAST(NULL AS INTEGER) AS norm_mass, CAST(NULL AS INTEGER) AS norm_volume""",
    "form_meta_rows": "SELECT 'form.xlsx' AS file, unnest([2, 3]) AS excel_row",
    "form_rows": f"""WITH {FORM}
SELECT excel_row, idx, 'Country' AS subject, zone, '' AS municipality, category, unit FROM form""",
    "form_categories": f"WITH {FORM} SELECT category_key, name, unit, basis, first_idx, n_rows, n_zones FROM cats",
    "form_zones": f"WITH {FORM} SELECT * FROM form_zones",
    "form_duplicates": f"""WITH {FORM}
SELECT excel_row, zone, category FROM form
QUALIFY row_number() OVER (PARTITION BY {norm('zone')}, {norm('category')} ORDER BY idx) > 1""",
    "norm_first_data_rows": f"""WITH {NORMS}
SELECT DISTINCT 'order.docx' AS file, table_idx, 3 AS header_row_count FROM norms""",
    "norm_column_profile": f"""WITH {NORMS},
counts AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE regexp_matches(p_name, '[a-z]{{4}}')) AS named FROM part_norms GROUP BY 1),
cols AS (
  SELECT t, c, n, named, CASE
      WHEN t = 5 THEN ['ordinal', 'text', 'plain', 'plain'][c + 1]
      WHEN t = 3 THEN ['text', 'volume', 'mass'][c + 1]
      WHEN t = 2 THEN ['text', 'unit', 'plain', 'plain'][c + 1]
      ELSE ['text', 'plain', 'plain'][c + 1] END AS kind,
    CASE
      WHEN t = 0 THEN ['Наименование категории 1', 'Норматив накопления куб.м в год 2', 'Норматив накопления кг в год 3'][c + 1]
      WHEN t = 1 THEN ['Наименование категории 1', 'Норматив накопления куб.м в год 2', 'Норматив накопления т в год 3'][c + 1]
      WHEN t = 2 THEN ['Наименование категории 1', 'Расчетная единица 2', 'Норматив накопления куб.м в год 3', 'Норматив накопления кг в год 4'][c + 1]
      WHEN t = 3 THEN ['Наименование категории 1', 'показатели по первому 2', 'показатели по второму 3'][c + 1]
      WHEN t = 4 THEN ['Наименование категории 1', 'объем 2', 'масса 3'][c + 1]
      ELSE ['№ п/п 1', 'Наименование категории 2', 'масса, кг в год 3', 'показатель 4'][c + 1] END AS header
  FROM counts, unnest(range(0, 4)) u(c) WHERE c < 3 OR t IN (2, 5)
)
SELECT 'order.docx' AS file, t AS table_idx, c AS col_idx, header,
  CASE WHEN kind = 'mass' THEN n ELSE 0 END AS mass, CASE WHEN kind = 'volume' THEN n ELSE 0 END AS volume,
  CASE WHEN kind IN ('plain', 'ordinal') THEN n ELSE 0 END AS plain,
  CASE kind WHEN 'text' THEN named WHEN 'unit' THEN n ELSE 0 END AS text, n AS filled,
  CASE WHEN kind = 'ordinal' THEN n ELSE 0 END AS ordinals
FROM cols""",
    "norm_layouts": f"""WITH {NORMS}
SELECT DISTINCT 'order.docx' AS file, t AS table_idx, CASE WHEN t = 5 THEN 1 ELSE 0 END AS name_column,
  CASE WHEN t = 2 THEN 1 ELSE -1 END AS unit_column, CASE t WHEN 2 THEN 3 ELSE 2 END AS mass_column,
  CASE t WHEN 2 THEN 2 WHEN 5 THEN 3 ELSE 1 END AS volume_column,
  ['Норматив накопления кг в год 3', 'Норматив накопления т в год 3', 'Норматив накопления кг в год 4',
   'показатели по второму 3', 'масса 3', 'масса, кг в год 3'][t + 1] AS mass_header,
  ['Норматив накопления куб.м в год 2', 'Норматив накопления куб.м в год 2', 'Норматив накопления куб.м в год 3',
   'показатели по первому 2', 'объем 2', 'показатель 4'][t + 1] AS volume_header
FROM part_norms""",
    "norm_entries": f"""WITH {NORMS}
SELECT file, table_idx, pos, id, name, basis, unit_text, round(mass, 6) AS mass, volume, raw_mass, raw_volume FROM norms""",
    "norm_table_counts": f"""WITH {NORMS}
SELECT file, table_idx, count(*) AS n, count(mass) AS with_mass, count(volume) AS with_volume FROM norms GROUP BY 1, 2""",
    "norm_names_changed": f"""WITH {NORMS}
SELECT 'added' AS change, name || '/' || table_idx AS name FROM norms WHERE table_idx >= 3
UNION ALL SELECT 'removed', name || '/' || table_idx FROM norms WHERE table_idx = 0""",
    "norm_candidates": f"""WITH {_NORM_CHAIN}
SELECT key, rank, id, name, basis, round(score, 6) AS score, round(raw_score, 6) AS raw_score, basis_mismatch FROM norm_candidates""",
    "category_candidates": f"""WITH {_CATEGORY_CHAIN}
SELECT key, row_number() OVER (PARTITION BY key ORDER BY score DESC, name, pos) AS rank, id, name, basis, round(score, 6) AS score
FROM category_candidates""",
    "zone_candidates": f"""WITH {_CATEGORY_CHAIN}
SELECT key, row_number() OVER (PARTITION BY key ORDER BY score DESC, name, pos) AS rank, id, name, round(score, 6) AS score
FROM zone_candidates""",
    "norm_mapping": f"""WITH {_NORM_CHAIN}
SELECT key, 'single' AS mode, entry_id, round(score, 6) AS score, status, true AS auto FROM norm_map""",
    "category_mapping": f"""WITH {_CATEGORY_CHAIN}
SELECT key, template_key, round(score, 6) AS score, status, true AS auto FROM category_map""",
    "zone_mapping": f"""WITH {_CATEGORY_CHAIN}
SELECT key, template_key, round(score, 6) AS score, status, true AS auto FROM zone_map""",
    "mapping_status_histogram": f"""WITH {_NORM_CHAIN}, {LAST_NORMS.split('ruled_categories')[0].rstrip().rstrip(',')}
SELECT CASE WHEN auto THEN status ELSE 'manual' END AS status, count(*) AS n FROM ruled_norms GROUP BY 1""",
    "mapping_review": f"""WITH {recon(ruled=True)},
seen AS (SELECT * FROM ruled_norms WHERE contains(lower(name), 'r')),
reg_seen AS (SELECT c.* FROM ruled_categories c JOIN reg_cats USING (key) WHERE contains(lower(name), 'ring')),
shown AS (
  SELECT 'all' AS shown FROM seen
  UNION ALL SELECT 'attention' FROM seen WHERE status IN ('weak', 'none') OR mode = 'none'
  UNION ALL SELECT 'none' FROM seen WHERE mode = 'none' OR (mode = 'single' AND entry_id IS NULL)
  UNION ALL SELECT 'manual' FROM seen WHERE NOT auto
  UNION ALL SELECT 'registry all' FROM reg_seen
  UNION ALL SELECT 'registry attention' FROM reg_seen WHERE NOT (status IN ('exact', 'auto') AND auto)
  UNION ALL SELECT 'registry none' FROM reg_seen WHERE template_key IS NULL
  UNION ALL SELECT 'registry manual' FROM reg_seen WHERE NOT auto
)
SELECT shown, count(*) AS n FROM shown GROUP BY 1""",
    "reconciled_rows": f"WITH {recon()} SELECT {_RESULT} FROM results",
    "reconciled_rows_by_municipality": f"WITH {recon(by_municipality=True)} SELECT {_RESULT} FROM results",
    "reconciled_rows_with_rules": f"""WITH {recon(ruled=True)}
SELECT excel_row, category_key, norm_mode, sources, units, round(norm_mass, 6) AS norm_mass,
  round(norm_volume, 6) AS norm_volume, norm_error, round(mass, 6) AS mass, round(volume, 6) AS volume FROM results""",
    "filled_form": f"""WITH {recon()}
SELECT idx, excel_row, zone, category, unit, sources, coalesce({r('units', 0)}, 0.0) AS units,
  coalesce({r('mass', 2)}, 0.0) AS mass, coalesce({r('volume', 2)}, 0.0) AS volume, coalesce({r('density', 2)}, 0.0) AS density,
  {r('norm_mass', 6)} AS norm_mass, {r('norm_volume', 6)} AS norm_volume FROM results ORDER BY idx""",
    "result_parts": f"""WITH {recon()}
SELECT tz AS zone_key, tm AS municipality_key, tc AS category_key, zone, municipality, category, sources, units
FROM assigned WHERE reason IS NULL""",
    "rows_with_data": f"WITH {recon()} SELECT excel_row, units, sources FROM results WHERE units > 0 OR sources > 0",
    "unassigned": f"""WITH {recon()}
SELECT zone, category, reason, n_rows, units, sources, n_groups, n_municipalities FROM unassigned ORDER BY units DESC, n_rows DESC""",
    "unassigned_by_municipality": f"""WITH {recon(by_municipality=True)}
SELECT zone, shown AS municipality, category, reason, n_rows, units, sources, n_groups FROM unassigned""",
    "balance_totals": f"WITH {recon()}, {_SIDES} SELECT * FROM sides",
    "balance_checks": f"""WITH {recon()}, {_SIDES}
SELECT 'Баланс расчётных единиц' AS name, {r('registry_units', 2)} AS expected, {r('form_units + outside_units', 2)} AS actual,
  abs(round(registry_units - form_units - outside_units, 6)) < 1e-6 AS ok FROM sides
UNION ALL SELECT 'Баланс количества источников', registry_sources::DOUBLE, (form_sources + outside_sources)::DOUBLE,
  registry_sources = form_sources + outside_sources FROM sides""",
    "issues": f"WITH {_ISSUES} SELECT * FROM all_issues",
    "issues_with_rules": f"""WITH {recon(ruled=True)}, {_SIDES}
SELECT level, code, excel_row, category, note FROM ({_row_issues(_RULED)})
UNION ALL SELECT 'error', 'balance', NULL, NULL, NULL FROM sides
  WHERE abs(round(registry_units - form_units - outside_units, 6)) >= 1e-6 OR registry_sources <> form_sources + outside_sources
UNION ALL SELECT 'error', 'no-units', NULL, NULL, NULL FROM reg HAVING NOT bool_and(has_units)
UNION ALL SELECT 'info', 'zero-sources', NULL, NULL, NULL FROM reg HAVING count(*) FILTER (WHERE units = 0) > 0""",
    "run_summary": f"WITH {_ISSUES} {_SUMMARY}",
    "report_norm_mapping": f"""WITH {_NORM_CHAIN}, {LAST_NORMS.split('ruled_categories')[0].rstrip().rstrip(',')}
SELECT first_idx AS position, name AS category, unit,
  CASE mode WHEN 'single' THEN 'Прямое соответствие' WHEN 'formula' THEN 'Формула' WHEN 'manual' THEN 'Значения вручную'
    ELSE 'Не сопоставлено' END AS mode,
  coalesce(shown, '') AS norm, {_BASIS.format('basis')} AS norm_unit, round(norm_mass, 6) AS norm_mass, round(norm_volume, 6) AS norm_volume,
  {_STATUS.format('status')} AS status, CASE WHEN auto THEN {_PERCENT.format('score')} ELSE '' END AS similarity,
  CASE WHEN auto THEN '' ELSE 'да' END AS checked FROM ruled_norms""",
    "report_registry_mapping": f"""WITH {_CATEGORY_CHAIN}
SELECT c.name AS category, c.n_rows, {r('c.units', 2)} AS units, coalesce(f.name, '') AS form_category,
  {_STATUS.format('m.status')} AS status, {_PERCENT.format('m.score')} AS similarity, '' AS checked
FROM reg_cats c JOIN category_map m USING (key) LEFT JOIN cats f ON f.category_key = m.template_key""",
    "report_rows": f"""WITH {recon()}
SELECT excel_row, zone, category, unit, sources, coalesce({r('units', 0)}, 0.0) AS units, coalesce({r('mass', 2)}, 0.0) AS mass,
  coalesce({r('volume', 2)}, 0.0) AS volume, coalesce({r('density', 2)}, 0.0) AS density, norm_mass, norm_volume,
  registry_rows, zero_sources, coalesce({r('units', 4)}, 0.0) AS exact_units FROM results""",
    "report_norms": f"""WITH {NORMS}
SELECT name, {_BASIS.format('basis')} AS basis, round(mass, 6) AS mass, volume, raw_mass, raw_volume, file FROM norms""",
}
SQL["report_verification"] = f"""WITH {_ISSUES}, summed AS ({_SUMMARY}), checked AS (SELECT * FROM ({SQL['balance_checks']}))
SELECT DISTINCT 'files' AS section, 'Реестр ИОО' AS label, 'extract_' || l_linenumber || '.xlsx' AS value, '' AS actual, '' AS outcome FROM lineitem
UNION ALL SELECT 'summary', p.l, p.v, '', '' FROM summed s, LATERAL (VALUES {_SUMMARY_PAIRS}, {_SUMMARY_FIGURES}) p(l, v)
UNION ALL SELECT 'checks', name, {_DECIMAL.format('expected')}, {_DECIMAL.format('actual')}, CASE WHEN ok THEN 'сходится' ELSE 'РАСХОЖДЕНИЕ' END FROM checked
UNION ALL SELECT 'issues', CASE level WHEN 'error' THEN 'Ошибка' WHEN 'warning' THEN 'Предупреждение' ELSE 'Информация' END, {_TITLES},
  coalesce(note, ''), coalesce(CAST(excel_row AS VARCHAR), '') || ' / ' || coalesce(zone, '') || ' / ' || coalesce(category, '') FROM all_issues
UNION ALL SELECT 'issues', '', 'Замечаний нет: файл не противоречит исходным данным.', '', '' FROM all_issues HAVING count(*) = 0"""


def _counted(name: str, table: str, full: int, *sparse: str) -> str:
    """Rows, columns and filled cells; ``full`` columns have no nulls, ``sparse`` ones may."""
    cells = " + ".join([f"{full} * count(*)", *[f"count({c})" for c in sparse]])
    return f"SELECT '{name}' AS report_table, count(*) AS n_rows, {full + len(sparse)} AS n_columns, {cells} AS n_cells FROM ({table})"


_CHOSEN = f"WITH {_NORM_CHAIN} SELECT n.mass, n.volume FROM norm_map m LEFT JOIN norms n ON n.id = m.entry_id"
SQL["report_round_trip"] = "\nUNION ALL ".join(
    [
        _counted("verification", SQL["report_verification"], 5),
        _counted("norm_mapping", _CHOSEN, 9, "mass", "volume"),
        _counted("registry_mapping", SQL["report_registry_mapping"], 7),
        _counted("rows", SQL["report_rows"], 12, "norm_mass", "norm_volume"),
        _counted("norms", SQL["report_norms"], 3, "mass", "volume", "raw_mass", "raw_volume"),
    ]
)
