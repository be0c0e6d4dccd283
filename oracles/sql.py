"""SQL text shared by the comparison queries.

They read the star schema directly and know nothing of grids or layouts, so they
check the Spark side from the other end.
"""

from __future__ import annotations


def norm(x: str) -> str:
    return (
        f"trim(regexp_replace(replace(lower(coalesce({x}, '')), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))"
    )


LINES = """
facts AS (
  SELECT l.*, p_name, p_brand, p_type, p_size, n_name, n_nationkey, r_name,
         CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN 'unlisted goods ' || p_brand
              WHEN p_brand = 'Brand#3' THEN p_name || 's' ELSE p_name END AS base
  FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
lines AS (
  SELECT 'extract_' || l_linenumber || '.xlsx' AS file, l_linenumber AS k,
    l_orderkey * 1000000 + l_partkey + 3 AS excel_row,
    CASE p_size % 4 WHEN 0 THEN upper(base) WHEN 2 THEN base || '.' ELSE base END AS category,
    CASE WHEN l_returnflag = 'R' THEN 0.0 WHEN l_tax > 0.07 THEN NULL WHEN l_discount > 0.09 THEN NULL
         ELSE l_quantity END AS n,
    CASE WHEN l_returnflag = 'R' THEN '0' WHEN l_tax > 0.07 THEN 'n/a' WHEN l_discount > 0.09 THEN ''
         ELSE replace(CAST(l_quantity AS VARCHAR), '.', ',') END AS raw_units,
    CASE WHEN l_suppkey % 50 = 0 THEN '' WHEN n_nationkey % 3 = 0 THEN upper(r_name)
         WHEN n_nationkey % 3 = 1 THEN lower(r_name) ELSE r_name END AS zone,
    CASE WHEN l_linenumber = 3 THEN '' ELSE n_name END AS municipality
  FROM facts
),
reg AS (
  SELECT file, k, excel_row, category, zone, municipality, raw_units,
    CASE WHEN k = 7 THEN NULL ELSE coalesce(n, 0.0) END AS units,
    k <> 7 AND n IS NULL AS units_missing,
    k <> 7 AND n IS NULL AND raw_units <> '' AS unreadable,
    k <> 7 AS has_units
  FROM lines
)"""

KEYED = f"""{LINES},
keyed AS (
  SELECT *, {norm('zone')} AS zone_key, {norm('municipality')} AS municipality_key,
         {norm('category')} AS category_key
  FROM reg
),
groups AS (
  SELECT zone_key, municipality_key, category_key,
    arg_min(zone, (file, excel_row)) AS zone, arg_min(municipality, (file, excel_row)) AS municipality,
    arg_min(category, (file, excel_row)) AS category,
    count(*) AS n_rows, count(*) FILTER (WHERE units IS NULL OR units <> 0) AS sources,
    count(*) FILTER (WHERE units = 0) AS zero_sources, coalesce(sum(units), 0.0) AS units,
    count(*) = count(units) AS units_known, count(DISTINCT file) AS n_files
  FROM keyed GROUP BY 1, 2, 3
)"""


def tokens(key: str) -> str:
    """Words of more than one character; the ASCII names here have no endings to cut."""
    return f"list_filter(string_split({key}, ' '), lambda t: len(t) > 1)"


def _ratio(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}, {b}) / greatest(len({a}), len({b}))::DOUBLE)"


def _token_sim(a: str, b: str) -> str:
    prefix = f"len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: left({a}, i) = left({b}, i)))"
    return (
        f"CASE WHEN {a} = {b} THEN 1.0 ELSE greatest(CASE WHEN least(len({a}), len({b})) >= 3 AND left({a}, 3) = left({b}, 3) "
        f"THEN {prefix} / greatest(len({a}), len({b}))::DOUBLE ELSE 0.0 END, {_ratio(a, b)}) END"
    )


def _best(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform({a}, lambda x: list_max(list_transform({b}, lambda y: {_token_sim('x', 'y')})))) / len({a})"
    )


def soft(ta: str, tb: str) -> str:
    return f"CASE WHEN len({ta}) = 0 OR len({tb}) = 0 THEN 0.0 ELSE ({_best(ta, tb)} + {_best(tb, ta)}) / 2 END"


def similarity(a: str, ta: str, b: str, tb: str) -> str:
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 "
        f"ELSE greatest(({soft(ta, tb)}) * 0.85 + {_ratio(a, b)} * 0.15, {_ratio(a, b)}) END"
    )


STATUS = "CASE WHEN score >= 0.999 THEN 'exact' WHEN score >= 0.85 THEN 'auto' WHEN score >= 0.45 THEN 'weak' ELSE 'none' END"


def r(value: str, digits: int) -> str:
    """Half away from zero on the decimal value."""
    return f"round(CAST(CAST(({value})::DOUBLE AS VARCHAR) AS DECIMAL(38, 18)), {digits})::DOUBLE"


FORM = f"""
placed AS (
  SELECT p_partkey, p_name, p_partkey % 5 AS rk FROM part WHERE NOT (p_name LIKE 'hot%' AND p_partkey % 5 = 4)
),
firsts AS (SELECT rk, p_name, min(p_partkey) AS fk FROM placed GROUP BY 1, 2),
form AS (
  SELECT p_partkey + 4 AS excel_row, row_number() OVER (ORDER BY p_partkey) - 1 AS idx,
    CASE WHEN rk % 2 = 0 THEN r_name || ' zone' ELSE r_name END AS zone, p_name AS category,
    CASE p_partkey % 3 WHEN 0 THEN 'Квадратный метр' WHEN 1 THEN 'Человек' ELSE '' END AS unit,
    'NATION_' || (p_partkey % 25) AS nation
  FROM placed JOIN firsts USING (rk, p_name) JOIN region ON rk = r_regionkey WHERE p_partkey = fk OR p_partkey % 97 = 0
),
cats AS (
  SELECT {norm('category')} AS category_key, arg_min(category, idx) AS name,
    coalesce(arg_min(unit, idx) FILTER (WHERE unit <> ''), '') AS unit, min(idx) AS first_idx,
    count(*) AS n_rows, count(DISTINCT zone) AS n_zones,
    CASE coalesce(arg_min(unit, idx) FILTER (WHERE unit <> ''), '') WHEN 'Квадратный метр' THEN 'sqm'
      WHEN 'Человек' THEN 'person' END AS basis
  FROM form GROUP BY 1
),
form_zones AS (
  SELECT {norm('zone')} AS zone_key, arg_min(zone, idx) AS name, min(idx) AS first_idx FROM form GROUP BY 1
)"""

NORMS = """
part_norms AS (
  SELECT p_type, p_name, min(p_retailprice) AS m, min(p_size)::DOUBLE AS v, min(p_partkey) AS fk,
    list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type) - 1 AS t
  FROM part GROUP BY 1, 2
),
norms AS (
  SELECT t AS table_idx, p_name AS name, row_number() OVER (ORDER BY t, fk) - 1 AS pos,
    'n' || (row_number() OVER (ORDER BY t, fk) - 1) AS id, 'order.docx' AS file,
    CASE WHEN t = 1 THEN m * 1000 ELSE m END AS mass, v AS volume, m AS raw_mass, v AS raw_volume,
    CASE WHEN t = 2 THEN CASE WHEN fk % 2 = 0 THEN 'person' ELSE 'sqm' END WHEN t = 3 THEN 'person' ELSE 'other' END AS basis,
    CASE t WHEN 0 THEN 'Норматив накопления кг в год 3' WHEN 1 THEN 'Норматив накопления т в год 3'
      WHEN 2 THEN CASE WHEN fk % 2 = 0 THEN 'на 1 человека' ELSE 'на 1 кв. метр' END
      WHEN 3 THEN 'м3/1 человека в год' WHEN 4 THEN 'масса 3' ELSE 'масса, кг в год 3' END AS unit_text
  FROM part_norms
)"""

CANDIDATES = f"""
norm_scored AS (
  SELECT c.category_key AS key, n.id, n.name, n.basis, n.pos,
    {similarity('c.k', 'c.t', 'n.k', 'n.t')} AS raw_score,
    NOT (c.basis IS NULL OR n.basis = 'other' OR n.basis = c.basis) AS basis_mismatch
  FROM (SELECT *, category_key AS k, {tokens('category_key')} AS t FROM cats) c,
       (SELECT *, {norm('name')} AS k, {tokens(norm('name'))} AS t FROM norms) n
),
norm_candidates AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, name, pos) AS rank
  FROM (SELECT *, CASE WHEN basis_mismatch THEN raw_score * 0.6 ELSE raw_score END AS score FROM norm_scored)
  QUALIFY rank <= 5
),
norm_map AS (
  SELECT key, CASE WHEN score >= 0.45 THEN id END AS entry_id, score, {STATUS} AS status FROM norm_candidates WHERE rank = 1
)"""

REGISTRY_CANDIDATES = f"""
reg_cats AS (
  SELECT category_key AS key, arg_min(category, (file, excel_row)) AS name, count(*) AS n_rows,
    coalesce(sum(units), 0.0) AS units FROM keyed GROUP BY 1
),
category_candidates AS (
  SELECT c.key, f.category_key AS id, f.name, f.basis, f.first_idx AS pos,
    {similarity('c.key', 'c.t', 'f.category_key', 'f.t')} AS score
  FROM (SELECT *, {tokens('key')} AS t FROM reg_cats) c, (SELECT *, {tokens('category_key')} AS t FROM cats) f
  QUALIFY row_number() OVER (PARTITION BY c.key ORDER BY score DESC, f.name, f.first_idx) <= 5
),
category_map AS (
  SELECT key, CASE WHEN score >= 0.45 THEN id END AS template_key, score, {STATUS} AS status FROM category_candidates
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, name, pos) = 1
),
zone_candidates AS (
  SELECT z.zone_key AS key, f.zone_key AS id, f.name, f.first_idx AS pos,
    {similarity('z.zone_key', 'z.t', 'f.zone_key', 'f.t')} AS score
  FROM (SELECT zone_key, {tokens('zone_key')} AS t FROM keyed GROUP BY 1) z,
       (SELECT *, {tokens('zone_key')} AS t FROM form_zones) f
  QUALIFY row_number() OVER (PARTITION BY z.zone_key ORDER BY score DESC, f.name, f.first_idx) <= 5
),
zone_map AS (
  SELECT key, CASE WHEN score >= 0.45 THEN id END AS template_key, score, {STATUS} AS status FROM zone_candidates
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, name, pos) = 1
)"""


LAST_NORMS = f"""
last_norms AS (
  SELECT {norm('name')} AS key, arg_max(id, pos) AS id, arg_max(name, pos) AS name, arg_max(mass, pos) AS mass,
    arg_max(volume, pos) AS volume, arg_max(basis, pos) AS basis FROM norms GROUP BY 1
),
ruled_norms AS (
  SELECT c.category_key AS key, c.name, c.first_idx, c.unit,
    CASE WHEN k LIKE 'red%' THEN 'manual' WHEN k LIKE 'blue%' OR k LIKE 'small%' THEN 'formula'
         WHEN k LIKE 'old%' THEN 'none' ELSE 'single' END AS mode,
    NOT (k LIKE 'red%' OR k LIKE 'blue%' OR k LIKE 'small%' OR k LIKE 'old%' OR k LIKE 'cold%') AS auto,
    CASE WHEN k LIKE 'cold%' THEN h.id WHEN k LIKE 'red%' OR k LIKE 'blue%' OR k LIKE 'small%' OR k LIKE 'old%' THEN NULL
         ELSE m.entry_id END AS entry_id,
    CASE WHEN k LIKE 'red%' THEN len(k)::DOUBLE WHEN k LIKE 'blue%' THEN 0.5 * o.mass + 1 WHEN k LIKE 'small%' OR k LIKE 'old%' THEN NULL
         WHEN k LIKE 'cold%' THEN h.mass ELSE n.mass END AS norm_mass,
    CASE WHEN k LIKE 'blue%' THEN 0.5 * o.volume + 1
         WHEN k LIKE 'red%' OR k LIKE 'small%' OR k LIKE 'old%' THEN NULL WHEN k LIKE 'cold%' THEN h.volume ELSE n.volume END AS norm_volume,
    CASE WHEN k = 'small bolt' THEN 'Деление на ноль' WHEN k = 'small gear' THEN NULL
         WHEN k LIKE 'small%' THEN 'Формула обрывается — не хватает значения' END AS norm_error,
    CASE WHEN k LIKE 'cold%' THEN h.name WHEN k LIKE 'red%' THEN 'значения заданы вручную'
         WHEN k LIKE 'blue%' THEN '0,5*«' || o.name || '» + (2 - 1)' WHEN k = 'small bolt' THEN '«' || o.name || '» / 0'
         WHEN k = 'small gear' THEN '[nowhere] + 1' WHEN k LIKE 'small%' THEN '-«' || o.name || '»*2 +'
         WHEN k LIKE 'old%' THEN '' ELSE coalesce(n.name, '') END AS shown,
    CASE WHEN k LIKE 'cold%' THEN h.basis WHEN k LIKE 'red%' OR k LIKE 'blue%' OR k LIKE 'small%' OR k LIKE 'old%' THEN NULL
         ELSE n.basis END AS basis,
    CASE WHEN k LIKE 'red%' THEN 'manual' WHEN k LIKE 'blue%' OR k LIKE 'small%' THEN 'formula' WHEN k LIKE 'old%' THEN 'ignored'
         WHEN k LIKE 'cold%' THEN CASE WHEN h.id IS NULL THEN 'none' ELSE 'manual' END ELSE m.status END AS status, m.score
  FROM (SELECT *, category_key AS k FROM cats) c JOIN norm_map m ON m.key = c.category_key
  LEFT JOIN norms n ON n.id = m.entry_id LEFT JOIN last_norms o ON o.key = k
  LEFT JOIN last_norms h ON h.key = replace(k, 'cold ', 'hot ')
),
ruled_categories AS (
  SELECT key, CASE WHEN key IN (SELECT p_name || 's' FROM part) THEN NULL WHEN key = 'unlisted goods brand 12' THEN 'blue ring'
                   ELSE template_key END AS template_key,
    CASE WHEN key IN (SELECT p_name || 's' FROM part) THEN 'ignored' WHEN key = 'unlisted goods brand 12' THEN 'manual'
         ELSE status END AS status,
    NOT (key IN (SELECT p_name || 's' FROM part) OR key = 'unlisted goods brand 12') AS auto
  FROM category_map
)"""


def recon(by_municipality: bool = False, ruled: bool = False) -> str:
    """The whole reconciliation as a chain of common table expressions."""
    place = norm("nation") if by_municipality else "''"
    target_place = "municipality_key" if by_municipality else "''"
    unplaced = (
        "WHEN municipality_key = '' THEN 'в реестре не указано муниципальное образование'" if by_municipality else ""
    )
    shown = "municipality" if by_municipality else "''"
    zone_map = "(SELECT key, CASE WHEN key = 'asia' THEN 'america' ELSE template_key END AS template_key FROM zone_map)" if ruled else "zone_map"
    category_map = "ruled_categories" if ruled else "category_map"
    norm_of = (
        "ruled_norms" if ruled
        else "(SELECT m.key, 'single' AS mode, n.mass AS norm_mass, n.volume AS norm_volume, NULL AS norm_error "
             "FROM norm_map m LEFT JOIN norms n ON n.id = m.entry_id)"
    )
    return f"""{KEYED}, {FORM}, {NORMS}, {CANDIDATES}, {REGISTRY_CANDIDATES}, {LAST_NORMS},
assigned AS (
  SELECT g.*, z.template_key AS tz, {target_place} AS tm, c.template_key AS tc,
    CASE WHEN z.template_key IS NULL THEN 'зона не сопоставлена'
         WHEN c.template_key IS NULL THEN 'категория не сопоставлена' {unplaced} END AS reason
  FROM groups g LEFT JOIN {zone_map} z ON g.zone_key = z.key LEFT JOIN {category_map} c ON g.category_key = c.key
),
targets AS (
  SELECT tz, tm, tc, sum(sources)::BIGINT AS sources, sum(units) AS units, bool_and(units_known) AS units_known,
    sum(n_rows)::BIGINT AS registry_rows, sum(zero_sources)::BIGINT AS zero_sources, count(*) AS n_parts
  FROM assigned WHERE reason IS NULL GROUP BY 1, 2, 3
),
form_keyed AS (
  SELECT *, {norm('zone')} AS zone_key, {place} AS municipality_key, {norm('category')} AS category_key,
    row_number() OVER (PARTITION BY {norm('zone')}, {place}, {norm('category')} ORDER BY idx) > 1 AS duplicate
  FROM form
),
results AS (
  SELECT f.*, coalesce(t.sources, 0) AS sources, coalesce(t.units, 0.0) AS units, coalesce(t.units_known, true) AS units_known,
    coalesce(t.registry_rows, 0) AS registry_rows, coalesce(t.zero_sources, 0) AS zero_sources,
    n.mode AS norm_mode, n.norm_mass, n.norm_volume, n.norm_error, n.norm_mass * coalesce(t.units, 0.0) / 1000 AS mass,
    n.norm_volume * coalesce(t.units, 0.0) AS volume,
    CASE WHEN n.norm_volume * coalesce(t.units, 0.0) <> 0
      THEN (n.norm_mass * coalesce(t.units, 0.0) / 1000) / (n.norm_volume * coalesce(t.units, 0.0)) END AS density
  FROM form_keyed f
  LEFT JOIN targets t ON NOT duplicate AND t.tz = zone_key AND t.tm = municipality_key AND t.tc = category_key
  LEFT JOIN {norm_of} n ON n.key = category_key
),
items AS (
  SELECT zone, municipality, category, sources, CASE WHEN units_known THEN units ELSE 0.0 END AS units, n_rows, reason
  FROM assigned WHERE reason IS NOT NULL
  UNION ALL
  SELECT a.zone, a.municipality, a.category, a.sources, a.units, t.registry_rows, 'нет такой строки в шаблоне'
  FROM assigned a JOIN targets t ON a.tz = t.tz AND a.tm = t.tm AND a.tc = t.tc
  WHERE a.reason IS NULL
    AND NOT EXISTS (SELECT 1 FROM form_keyed f WHERE f.zone_key = a.tz AND f.municipality_key = a.tm AND f.category_key = a.tc)
),
unassigned AS (
  SELECT zone, {shown} AS shown, category, reason, sum(n_rows)::BIGINT AS n_rows, sum(units) AS units,
    sum(sources)::BIGINT AS sources, count(*) AS n_groups, count(DISTINCT nullif(municipality, '')) AS n_municipalities
  FROM items GROUP BY 1, 2, 3, 4
)"""
