"""Comparison SQL of this folder's queries, where SQL can express them.

Written against the given tables only.  Operators that learn, iterate or write
files have no entry; their tests compare them with brute force.
"""

from __future__ import annotations

from ledgerfold.llm.licences import TEMPLATES

_VALUES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)

_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_BIGRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"

LICENCES = f"""
WITH template AS (
  SELECT row_number() OVER () AS template, licence, {_BIGRAMS.format("w")} AS b
  FROM (SELECT licence, {_WORDS.format("t")} AS w FROM (VALUES {_VALUES}) v(licence, t))
), line AS (
  SELECT doc_id, unnest(range(0, len(l))) AS line_no, 1 AS n_lines, unnest(l) AS piece
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), whole AS (
  SELECT doc_id, 0 AS line_no, len(string_split(text, chr(10))) AS n_lines, text AS piece FROM documents WHERE contains(text, chr(10))
), cut_up AS (
  SELECT doc_id, line_no, n_lines, {_BIGRAMS.format("w")} AS b
  FROM (SELECT doc_id, line_no, n_lines, {_WORDS.format("piece")} AS w FROM (SELECT * FROM line UNION ALL SELECT * FROM whole))
), near AS (
  SELECT doc_id, line_no, n_lines, licence, 2.0 * len(list_intersect(c.b, t.b)) / (len(c.b) + len(t.b)) AS dice
  FROM (SELECT * FROM cut_up WHERE len(b) > 0) c JOIN template t
    ON len(c.b) <= len(t.b) * 1.5 AND len(t.b) <= len(c.b) * 1.5 AND len(list_intersect(c.b, t.b)) > 0
), best AS (
  SELECT doc_id, line_no, n_lines, arg_min(licence, (-dice, licence)) AS licence, max(dice) AS dice
  FROM near WHERE dice >= 0.8 GROUP BY ALL
), told AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences,
         string_agg(line_no || ':' || n_lines || ':' || licence, ',' ORDER BY line_no, n_lines) AS found, round(max(dice), 6) AS best_dice
  FROM best GROUP BY doc_id
)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(found, '') AS found, best_dice
FROM documents LEFT JOIN told USING (doc_id)
"""

INFILL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS h FROM documents
), cut_up AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM drawn
), placed AS (
  SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS i, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS j,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut_up
), parted AS (
  SELECT *, array_to_string(list_slice(t, 1, i), '') AS p, array_to_string(list_slice(t, i + 1, j), '') AS m, array_to_string(list_slice(t, j + 1, n), '') AS s
  FROM placed
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""

PHRASES = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), found AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3), (4)) sizes(k) WHERE len(w) >= k)
  GROUP BY ALL
), total AS (
  SELECT lang, sum(f) AS n FROM found WHERE k = 1 GROUP BY lang
), candidate AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM found WHERE k >= 2 AND f >= 30
), inner_phrase AS (
  SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, w, a, size, unnest(range(1, k - size + 2)) AS i FROM candidate, (VALUES (2), (3)) sizes(size) WHERE size < k)
  GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidate c LEFT JOIN inner_phrase i USING (lang, phrase) WHERE i.around IS NULL OR 100 * i.around < 80 * c.a
), cut_up AS (
  SELECT lang, phrase, a, cut_at, array_to_string(list_slice(w, 1, cut_at), ' ') AS first_part, array_to_string(list_slice(w, cut_at + 1, k), ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut_at FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut_at, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cut_up c JOIN found x ON x.lang = c.lang AND x.phrase = c.first_part JOIN found y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN total USING (lang)
WHERE rank <= 2000
"""

SQL: dict[str, str] = {
    "op11_fill_in_middle": INFILL,
    "op12_phrase_collocations": PHRASES,
    "op3_license_scans": LICENCES,
}
