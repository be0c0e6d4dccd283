"""Queries of the scalar functions over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.functions import cellrefs, text, units
from ledgerfold.operators import formula
from ledgerfold.operators.relational import dealt_out
from ledgerfold.plans.extracts import table


def _documents(spark, sf_dir):
    return dealt_out(table(spark, sf_dir, "documents").select("doc_id", "text"))


def text_keys(spark, sf_dir):
    key = text.normalize(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(key).alias("key_md5"), F.length(key).alias("key_length"))


def text_tokens(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def text_cells(spark, sf_dir):
    cell = text.cell_text(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(cell).alias("cell_md5"))


def text_joined_lines(spark, sf_dir):
    joined = text.join_lines(F.split("text", "\n"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(joined).alias("joined_md5"))


def text_joined_words(spark, sf_dir):
    spaced = F.regexp_replace("text", r"([,.;:!?()])", " $1 ")
    joined = text.join_words(F.split(spaced, " "))
    return _documents(spark, sf_dir).select("doc_id", F.md5(joined).alias("joined_md5"))


def name_similarity(spark, sf_dir):
    """Part names against names made of their type and last word."""
    pairs = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("a"),
        F.concat(F.lower("p_type"), F.lit("-"), F.substring_index("p_name", " ", -1), F.lit("s")).alias("b"),
    ).distinct()
    a, b = F.col("a"), F.col("b")
    key_a, key_b = text.normalize(a), text.normalize(b)
    return pairs.select(
        "a",
        "b",
        F.levenshtein(key_a, key_b).alias("distance"),
        F.round(text.levenshtein_ratio(key_a, key_b), 6).alias("ratio"),
        F.round(text.soft_token_similarity(text.tokens(a), text.tokens(b)), 6).alias("soft"),
        F.round(text.similarity(a, b), 6).alias("similarity"),
    )


def _commas(value):
    return F.replace(value.cast("string"), F.lit("."), F.lit(","))


def parsed_numbers(spark, sf_dir):
    value, turn = _commas(F.col("value")), F.col("event_id") % 8
    cell = (
        F.when(turn == 0, value)
        .when(turn == 1, F.concat(F.lit("1 2"), value, F.lit(" <*>")))
        .when(turn == 2, F.concat(F.floor("value").cast("string"), F.lit(".")))
        .when(turn == 3, F.lit(".5"))
        .when(turn == 4, F.concat(value, F.lit(" кг")))
        .when(turn == 5, F.lit("1e3"))
        .when(turn == 6, F.concat(value, F.lit("d")))
        .otherwise(F.lit("—"))
    )
    return table(spark, sf_dir, "events").select("event_id", text.parse_number(cell).alias("number"))


def parsed_measures(spark, sf_dir):
    value, turn = _commas(F.col("value")), F.col("event_id") % 9
    tails = (
        " м3/1 проживающего человека в год", " тонн/1 место в год", " кг на 1 человека", " л/1 м2 общей площади",
        "", " г/1 участок", " м³/1 пог. м (погонный)", " шт./1 койку/сутки",
    )
    cell = F.coalesce(*[F.when(turn == k, F.concat(value, F.lit(t))) for k, t in enumerate(tails)], F.concat(F.lit("куб.м на 1 кв. метр "), value))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", units.parse_measure(cell).alias("m"))
        .select("event_id", *[F.col(f"m.{c}").alias(c) for c in ("value", "kind", "factor", "basis", "unit_text")])
    )


def unit_headers(spark, sf_dir):
    """Headers with every kind of unit, worded around the part names."""
    heads = (
        "кг в год", "т в год", "куб.м на 1 кв. метр", "м³ на 1 человека", "литров на 1 место", "грамм на 1 участок",
        "тонн на погонный метр", "объем на 1 койку", "квадратный метр", "",
    )
    turn = F.col("p_partkey") % len(heads)
    tail = F.coalesce(*[F.when(turn == k, h) for k, h in enumerate(heads)])
    header = F.when(tail == "", "").otherwise(F.concat(F.lit("Норматив «"), "p_name", F.lit("», "), tail))
    heads_of = table(spark, sf_dir, "part").select("p_partkey", header.alias("h"))
    return heads_of.select(
        "p_partkey",
        units.unit_basis(F.col("h")).alias("basis"),
        units.mass_factor(F.col("h")).alias("mass_factor"),
        units.volume_factor(F.col("h")).alias("volume_factor"),
        units.is_mass_header(F.col("h")).alias("is_mass"),
        units.is_volume_header(F.col("h")).alias("is_volume"),
    )


def rounded_values(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    value = F.col("l_extendedprice") * F.col("l_tax") / 8
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        text.round_half_up(value, 2).alias("two"),
        text.round_half_up(-value, 0).alias("none"),
        text.round_half_up(F.col("l_quantity") / 8, 2).alias("eighth"),
    )


def cell_references(spark, sf_dir):
    keys = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") + 1).alias("n"), "p_size")
    made = keys.select("p_partkey", cellrefs.make_ref(F.col("n"), F.col("p_size")).alias("ref"))
    read = made.withColumn("r", cellrefs.parse_ref(F.lower("ref")))
    return read.select("p_partkey", "ref", F.col("r.col").alias("col_number"), F.col("r.row").alias("row_number"))


def _formulas(spark, sf_dir):
    """A formula per part over the norms n0 … n49 of the part sizes (size 50 is unknown)."""
    size, turn = F.col("p_size").cast("string"), F.col("p_partkey") % 10
    ref = F.concat(F.lit("[n"), size, F.lit("]"))
    expression = (
        F.when(turn == 0, F.concat(ref, F.lit(" + [n1]*0,5")))
        .when(turn == 1, F.concat(F.lit("("), ref, F.lit(" - 3) / 4 - -2")))
        .when(turn == 2, F.concat(ref, F.lit(" / ([n2] - [n2])")))
        .when(turn == 3, F.concat(ref, F.lit(" +")))
        .when(turn == 4, F.concat(F.lit("("), ref))
        .when(turn == 5, F.concat(ref, F.lit(" 7")))
        .when(turn == 6, F.concat(F.lit("2 * "), ref, F.lit(" % 3")))
        .when(turn == 7, F.lit("  "))
        .when(turn == 8, F.concat(F.lit("*"), ref))
        .otherwise(F.concat(F.lit("2*3-"), ref, F.lit("/[ n4 ]")))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), expression.alias("expression"))


def _size_norms(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").filter(F.col("p_size") < 50).select("p_size").distinct()
    return sizes.select(
        F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("id"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("name"),
        (F.col("p_size") * 2).cast("double").alias("mass"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double")).alias("volume"),
        F.col("p_size").cast("bigint").alias("pos"),
    )


def formula_values(spark, sf_dir):
    done = formula.evaluate_rules(_formulas(spark, sf_dir), _size_norms(spark, sf_dir))
    return done.select("key", F.round("formula_mass", 6).alias("mass"), F.round("formula_volume", 6).alias("volume"), F.col("formula_error").alias("error"))


def formula_problems(spark, sf_dir):
    return formula.validate(_formulas(spark, sf_dir), _size_norms(spark, sf_dir)).select("key", "problem")


def formula_unknown_references(spark, sf_dir):
    return formula.unknown_references(_formulas(spark, sf_dir), _size_norms(spark, sf_dir))


def formula_tokens(spark, sf_dir):
    rules = _formulas(spark, sf_dir)
    return rules.select(
        "key",
        F.array_join(formula.tokens(F.col("expression")), " ").alias("tokens"),
        formula.has_unknown_sign(F.col("expression")).alias("unknown_sign"),
        F.array_join(formula.references(F.col("expression")), ",").alias("refs"),
    )


def formula_texts(spark, sf_dir):
    rules, known = _formulas(spark, sf_dir), _size_norms(spark, sf_dir)
    shown = formula.humanize(rules, known).select("key", F.col("expression").alias("shown"))
    stored = formula.portable(rules, known).select("key", F.col("expression").alias("stored"))
    return shown.join(stored, "key")


QUERIES = {
    f.__name__: f
    for f in (
        text_keys, text_tokens, text_cells, text_joined_lines, text_joined_words, name_similarity, parsed_numbers,
        parsed_measures, unit_headers, rounded_values, cell_references, formula_values, formula_problems,
        formula_unknown_references, formula_tokens, formula_texts,
    )
}
