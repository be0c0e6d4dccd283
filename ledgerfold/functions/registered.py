"""Library functions registered for use in SQL text by name.

They are SQL functions whose body is the same expression the DataFrame side
builds, so Catalyst inlines them; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerfold.functions import units
from ledgerfold.functions.text import ENDINGS, NUMBER_SHAPE, SHARED_PREFIX, SHORTEST_STEM, STOP_WORDS, STRING_WEIGHT, TOKEN_WEIGHT, WS


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _words_alike(a: str, b: str) -> str:
    """Best of shared-prefix share and edit ratio of two words, as SQL."""
    longest = f"greatest(length({a}), length({b}))"
    alike = " AND ".join([f"length({w}) >= {SHARED_PREFIX}" for w in (a, b)] + [f"left({a}, {SHARED_PREFIX}) = left({b}, {SHARED_PREFIX})"])
    shared = f"size(filter(sequence(1, least(length({a}), length({b}))), i -> left({a}, i) = left({b}, i)))"
    return (
        f"CASE WHEN {a} = {b} THEN 1D ELSE greatest(CASE WHEN {alike} THEN {shared} / {longest} ELSE 0D END, "
        f"1D - levenshtein({a}, {b}) / {longest}) END"
    )


def _mean_best(source: str, target: str) -> str:
    best = f"transform({source}, x -> array_max(transform({target}, y -> {_words_alike('x', 'y')})))"
    return f"aggregate({best}, 0D, (acc, v) -> acc + v) / size({source})"


def _unit_kind(key: str) -> str:
    word = lambda *groups: f"{key} RLIKE '(?:^| )(?:{'|'.join(w for g in groups for w in g)})(?: |$)'"
    begins = lambda *groups: f"{key} RLIKE '(?:^| )(?:{'|'.join(w for g in groups for w in g)})'"
    place = f"({begins(units.BED)} OR ({begins(units.PLACE)} AND NOT {begins(units.HUMAN)}))"
    return (
        f"CASE WHEN {key} = '' THEN NULL WHEN {begins(units.PERSON_OR_PLACE)} THEN CASE WHEN {place} THEN 'place' ELSE 'person' END "
        f"WHEN {word(units.SQUARE_WORDS)} OR {begins(units.SQUARE)} OR ({begins(units.AREA)} AND {begins(units.METRE)}) THEN 'sqm' "
        f"WHEN {begins(units.RUNNING)} THEN 'linear' WHEN {word(units.PLOT_WORDS)} OR {begins(units.PLOT)} THEN 'plot' ELSE 'other' END"
    )


def register(spark: SparkSession) -> list[str]:
    """Register the text functions; returns their names."""
    stem = "^(.{%d,}?)(?:%s)$" % (SHORTEST_STEM, "|".join(ENDINGS))
    dotted = f"regexp_replace(regexp_replace(coalesce(x, ''), r'<[^>]*>|\\*|{WS}', ''), '^([^,]*),', '$1.')"
    bodies = {
        "name_key(x STRING) RETURNS STRING": (
            "trim(regexp_replace(replace(lower(coalesce(x, '')), 'ё', 'е'), '[^0-9a-zа-я]+', ' '))"
        ),
        "name_tokens(x STRING) RETURNS ARRAY<STRING>": (
            f"transform(filter(split(name_key(x), ' '), w -> length(w) > 1 AND w NOT IN ({_quoted(STOP_WORDS)})), "
            f"w -> regexp_replace(w, '{stem}', '$1'))"
        ),
        "edit_ratio(a STRING, b STRING) RETURNS DOUBLE": (
            "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1D "
            "ELSE 1D - levenshtein(a, b) / greatest(length(a), length(b)) END"
        ),
        "read_number(x STRING) RETURNS DOUBLE": (
            f"CASE WHEN {dotted} RLIKE r'{NUMBER_SHAPE}' AND abs(try_cast({dotted} AS DOUBLE)) < double('Infinity') THEN try_cast({dotted} AS DOUBLE) END"
        ),
        "stem(x STRING) RETURNS STRING": f"regexp_replace(x, '{stem}', '$1')",
        "unit_kind_of_key(k STRING) RETURNS STRING": _unit_kind("k"),
        "unit_basis(x STRING) RETURNS STRING": "unit_kind_of_key(name_key(x))",
        "soft_similarity(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": (
            f"CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE ({_mean_best('a', 'b')} + {_mean_best('b', 'a')}) / 2 END"
        ),
        "similarity_of_keys(a STRING, b STRING, soft DOUBLE) RETURNS DOUBLE": (
            "CASE WHEN a = '' OR b = '' THEN 0D WHEN a = b THEN 1D "
            f"ELSE greatest(soft * {TOKEN_WEIGHT}D + edit_ratio(a, b) * {STRING_WEIGHT}D, edit_ratio(a, b)) END"
        ),
        "similarity(a STRING, b STRING) RETURNS DOUBLE": (
            "similarity_of_keys(name_key(a), name_key(b), soft_similarity(name_tokens(a), name_tokens(b)))"
        ),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in bodies]
