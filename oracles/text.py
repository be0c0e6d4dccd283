"""Comparison SQL for the scalar function queries."""

from __future__ import annotations

from oracles.sql import norm, r, similarity, soft, tokens

_WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _cell(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


_V = "replace(CAST(value AS VARCHAR), '.', ',')"
_TOKEN = r"(\[[^\]]+\]|\d+(?:[.,]\d+)?|[()+\-*/])"

_FORMULAS = """
sizes AS (
  SELECT 'n' || p_size AS id, 'size ' || p_size AS name, p_size * 2.0 AS mass,
         CASE WHEN p_size % 7 <> 0 THEN p_size::DOUBLE END AS volume
  FROM part WHERE p_size < 50 GROUP BY p_size
),
rules AS (
  SELECT p_partkey AS key, p_partkey % 10 AS t, p_size, '[n' || p_size || ']' AS ref, s.id IS NOT NULL AS known, s.name,
    s.mass AS m, s.volume AS v,
    CASE p_partkey % 10 WHEN 0 THEN ref || ' + [n1]*0,5' WHEN 1 THEN '(' || ref || ' - 3) / 4 - -2'
      WHEN 2 THEN ref || ' / ([n2] - [n2])' WHEN 3 THEN ref || ' +' WHEN 4 THEN '(' || ref WHEN 5 THEN ref || ' 7'
      WHEN 6 THEN '2 * ' || ref || ' % 3' WHEN 7 THEN '  ' WHEN 8 THEN '*' || ref ELSE '2*3-' || ref || '/[ n4 ]' END AS expression,
    len('2 * ' || ref) + 1 AS bad_at
  FROM part LEFT JOIN sizes s ON s.id = 'n' || p_size
)"""
_ERROR = """CASE t WHEN 2 THEN 'Деление на ноль' WHEN 3 THEN 'Формула обрывается — не хватает значения'
    WHEN 4 THEN 'Не хватает закрывающей скобки' WHEN 5 THEN 'Лишний фрагмент: «7»'
    WHEN 6 THEN 'Непонятный символ в позиции ' || bad_at || ': « »' WHEN 7 THEN 'Формула пуста' WHEN 8 THEN 'Не число: «*»' END"""
_VALUE = "CASE t WHEN 0 THEN {0} + 0.5 * {1} WHEN 1 THEN ({0} - 3) / 4 + 2 WHEN 9 THEN 6 - {0} / {2} END"

SQL = {
    "text_keys": f"SELECT doc_id, md5({norm('text')}) AS key_md5, len({norm('text')}) AS key_length FROM documents",
    "text_tokens": f"""SELECT doc_id, len({tokens(norm('text'))}) AS n_tokens,
  md5(array_to_string({tokens(norm('text'))}, ' ')) AS tokens_md5 FROM documents""",
    "text_cells": f"SELECT doc_id, md5({_cell('text')}) AS cell_md5 FROM documents",
    "text_joined_lines": f"""WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
),
spaced AS (
  SELECT doc_id, i, part, lag(part, 1, '') OVER (PARTITION BY doc_id ORDER BY i) AS before FROM lines
)
SELECT doc_id, md5({_cell("string_agg(CASE WHEN regexp_matches(before, '[^ \\t\\n\\x0B\\f\\r][-‑–]$') AND regexp_matches(part, '^[a-zа-яё]') THEN part ELSE ' ' || part END, '' ORDER BY i)")}) AS joined_md5
FROM spaced GROUP BY doc_id""",
    "text_joined_words": f"""WITH spaced AS (
  SELECT doc_id, regexp_replace(text, '([,.;:!?()])', ' \\1 ', 'g') AS t FROM documents
)
SELECT doc_id, md5({_cell(f"regexp_replace(regexp_replace(t, '{_WS}+([,.;:!?)»%])', chr(92) || '1', 'g'), '([(«]){_WS}+', chr(92) || '1', 'g')")}) AS joined_md5
FROM spaced""",
    "name_similarity": f"""WITH pairs AS (
  SELECT DISTINCT p_name AS a, lower(p_type) || '-' || split_part(p_name, ' ', -1) || 's' AS b FROM part
),
keyed AS (SELECT a, b, {norm('a')} AS ka, {norm('b')} AS kb FROM pairs),
tokened AS (SELECT *, {tokens('ka')} AS ta, {tokens('kb')} AS tb FROM keyed),
scored AS (
  SELECT *, {similarity('ka', 'ta', 'kb', 'tb')} AS s, levenshtein(ka, kb) AS d,
    1 - levenshtein(ka, kb) / greatest(len(ka), len(kb))::DOUBLE AS ratio,
    {soft('ta', 'tb')} AS soft
  FROM tokened
)
SELECT a, b, d AS distance, round(ratio, 6) AS ratio, round(soft, 6) AS soft, round(s, 6) AS similarity FROM scored""",
    "parsed_numbers": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN value
  WHEN 1 THEN CAST('12' || CAST(value AS VARCHAR) AS DOUBLE) WHEN 2 THEN floor(value) WHEN 3 THEN 0.5 WHEN 5 THEN 1000.0 END AS number
FROM events""",
    "parsed_measures": """SELECT event_id, CASE WHEN event_id % 9 < 8 THEN value END AS value,
  CASE event_id % 9 WHEN 0 THEN 'volume' WHEN 1 THEN 'mass' WHEN 2 THEN 'mass' WHEN 3 THEN 'volume' WHEN 5 THEN 'mass'
    WHEN 6 THEN 'volume' END AS kind,
  CASE event_id % 9 WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.001 WHEN 5 THEN 0.001 WHEN 6 THEN 1.0 END::DOUBLE AS factor,
  CASE event_id % 9 WHEN 0 THEN 'person' WHEN 1 THEN 'place' WHEN 2 THEN 'person' WHEN 3 THEN 'sqm' WHEN 5 THEN 'plot'
    WHEN 6 THEN 'linear' WHEN 7 THEN 'place' END AS basis,
  CASE event_id % 9 WHEN 0 THEN 'м3/1 проживающего человека в год' WHEN 1 THEN 'тонн/1 место в год' WHEN 2 THEN 'кг на 1 человека'
    WHEN 3 THEN 'л/1 м2 общей площади' WHEN 4 THEN '' WHEN 5 THEN 'г/1 участок' WHEN 6 THEN 'м³/1 пог. м (погонный)'
    WHEN 7 THEN 'шт./1 койку/сутки' END AS unit_text
FROM events""",
    "unit_headers": """WITH h AS (SELECT p_partkey, p_partkey % 10 AS t FROM part)
SELECT p_partkey,
  CASE t WHEN 2 THEN 'sqm' WHEN 3 THEN 'person' WHEN 4 THEN 'place' WHEN 5 THEN 'plot' WHEN 6 THEN 'linear' WHEN 7 THEN 'place'
    WHEN 8 THEN 'sqm' WHEN 9 THEN NULL ELSE 'other' END AS basis,
  CASE t WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0 WHEN 5 THEN 0.001 WHEN 6 THEN 1000.0 END::DOUBLE AS mass_factor,
  CASE t WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.001 END::DOUBLE AS volume_factor,
  t IN (0, 1, 5, 6) AS is_mass, t IN (2, 3, 4) AS is_volume
FROM h""",
    "rounded_values": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {r('l_extendedprice * l_tax / 8', 2)} AS two, -{r('l_extendedprice * l_tax / 8', 0)} AS none, {r('l_quantity / 8', 2)} AS eighth
FROM lineitem""",
    "cell_references": """WITH RECURSIVE letters AS (
  SELECT p_partkey, p_partkey + 1 AS n, p_size, p_partkey + 1 AS left_over, '' AS text FROM part
  UNION ALL
  SELECT p_partkey, n, p_size, (left_over - 1) // 26, chr((65 + (left_over - 1) % 26)::INTEGER) || text FROM letters WHERE left_over > 0
)
SELECT p_partkey, text || p_size AS ref, n AS col_number, p_size AS row_number FROM letters WHERE left_over = 0""",
    "formula_values": f"""WITH {_FORMULAS},
two AS (SELECT (SELECT mass FROM sizes WHERE id = 'n1') AS m1, (SELECT volume FROM sizes WHERE id = 'n1') AS v1,
  (SELECT mass FROM sizes WHERE id = 'n4') AS m4, (SELECT volume FROM sizes WHERE id = 'n4') AS v4)
SELECT key, round({_VALUE.format('m', '(SELECT m1 FROM two)', '(SELECT m4 FROM two)')}, 6) AS mass,
  round({_VALUE.format('v', '(SELECT v1 FROM two)', '(SELECT v4 FROM two)')}, 6) AS volume, {_ERROR} AS error FROM rules""",
    "formula_problems": f"""WITH {_FORMULAS}
SELECT key, CASE WHEN t = 6 THEN {_ERROR} WHEN NOT known AND t <> 7 THEN 'Неизвестные нормативы: n' || p_size ELSE {_ERROR} END AS problem FROM rules""",
    "formula_unknown_references": f"""WITH {_FORMULAS}
SELECT key, 0 AS at, 'n' || p_size AS id FROM rules WHERE NOT known AND t <> 7""",
    "formula_tokens": f"""WITH {_FORMULAS}
SELECT key, array_to_string(regexp_extract_all(expression, '{_TOKEN}', 1), ' ') AS tokens, t = 6 AS unknown_sign,
  CASE t WHEN 0 THEN 'n' || p_size || ',n1' WHEN 2 THEN 'n' || p_size || ',n2,n2' WHEN 7 THEN '' WHEN 9 THEN 'n' || p_size || ',n4'
    ELSE 'n' || p_size END AS refs FROM rules""",
    "formula_texts": f"""WITH {_FORMULAS},
shown AS (SELECT key, CASE WHEN known THEN replace(expression, ref, '«' || name || '»') ELSE expression END AS s,
  CASE WHEN known THEN replace(expression, ref, '[@' || name || ']') ELSE expression END AS p FROM rules)
SELECT key, replace(replace(replace(s, '[n1]', '«size 1»'), '[n2]', '«size 2»'), '[ n4 ]', '«size 4»') AS shown,
  replace(replace(replace(p, '[n1]', '[@size 1]'), '[n2]', '[@size 2]'), '[ n4 ]', '[@size 4]') AS stored FROM shown""",
}
