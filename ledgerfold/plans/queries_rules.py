"""Queries of proposals, rules, streaming and functions used from SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerfold.functions.registered import register
from ledgerfold.functions.text import cell_text
from ledgerfold.operators import grid, norms, proposals, registry, rules
from ledgerfold.plans import extracts, queries_reconcile
from ledgerfold.plans.edits import Edited, Edits
from ledgerfold.plans.extracts import table
from ledgerfold.sources import rules as rule_files
from ledgerfold.session import shared_folder
from ledgerfold.streaming.accumulate import accumulate, current_cube
from ledgerfold.streaming.reconciled import forms, reconcile_stream


def _brand_orders(spark, sf_dir):
    """A norms order per brand of part: one table in kilograms and cubic metres."""
    parts = table(spark, sf_dir, "part")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    body = parts.select(
        F.concat("p_brand", F.lit(".docx")).alias("file"),
        (F.col("p_partkey") + 1).alias("row_idx"),
        F.array("p_name", comma(F.col("p_size").cast("double")), comma(F.col("p_retailprice"))).alias("cells"),
    )
    heads = parts.select("p_brand").distinct().select(
        F.concat("p_brand", F.lit(".docx")).alias("file"),
        F.lit(0).cast("bigint").alias("row_idx"),
        F.array(F.lit("Наименование"), F.lit("куб.м в год"), F.lit("кг в год")).alias("cells"),
    )
    return heads.unionByName(body).select("file", F.lit(0).alias("table_idx"), F.lit("Приложение").alias("title"), "row_idx", "cells")


def _brand_proposals(spark, sf_dir):
    """A proposal per brand, right or wrong by the number of the brand."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    turn = number % 9
    one = brands.select(
        F.concat("p_brand", F.lit(".docx")).alias("file"),
        F.when(turn == 1, 7).otherwise(0).alias("table_idx"),
        F.lit(0).alias("item"),
        F.when(turn == 2, 9999999).otherwise(1).alias("header_row_count"),
        F.lit(0).alias("name_column"),
        F.lit(-1).alias("unit_column"),
        F.when(turn == 3, 9).when(turn == 4, 0).otherwise(2).alias("mass_column"),
        F.when(turn == 5, 2).otherwise(1).alias("volume_column"),
        F.when(turn == 6, "т").when(turn == 7, "пудов").otherwise("кг").alias("mass_unit"),
        F.lit("куб.м").alias("volume_unit"),
        F.when(turn == 0, "plot").otherwise("sqm").alias("basis"),
        turn.alias("turn"),
    )
    again = one.filter("turn = 8").withColumn("item", F.lit(1))
    return one.unionByName(again).drop("turn")


def norm_proposal_checks(spark, sf_dir):
    checked = proposals.check_norm_tables(_brand_orders(spark, sf_dir), _brand_proposals(spark, sf_dir))
    return checked.select("file", "item", "mass_factor", "volume_factor", "basis", F.array_join("problems", ",").alias("problems"))


def norm_proposal_verdicts(spark, sf_dir):
    verdict, _ = proposals.validate_norm_proposals(_brand_orders(spark, sf_dir), _brand_proposals(spark, sf_dir))
    return verdict.withColumn("problems", F.array_join("problems", ","))


def norm_proposal_acceptance(spark, sf_dir):
    """Against a current reading with one more name per odd brand, which would get lost."""
    orders = _brand_orders(spark, sf_dir)
    verdict, preview = proposals.validate_norm_proposals(orders, _brand_proposals(spark, sf_dir))
    current = norms.read_norms(orders).select("file", "name")
    extra = table(spark, sf_dir, "part").select("p_brand").distinct().filter("cast(substring(p_brand, 7) AS int) % 2 = 1")
    current = current.unionByName(extra.select(F.concat("p_brand", F.lit(".docx")).alias("file"), F.lit("вышедшее").alias("name")))
    return proposals.accept_norms(current, verdict, preview)


def saved_layout_reapplied(spark, sf_dir):
    """Detected entries kept where a saved reading has fewer than two."""
    parts = table(spark, sf_dir, "part")
    detected = parts.select("p_brand", "p_name").select(F.concat("p_brand", F.lit(".docx")).alias("file"), F.col("p_name").alias("name"))
    saved = parts.filter("p_size = 7 AND p_retailprice < 1000").select(
        F.concat("p_brand", F.lit(".docx")).alias("file"), F.col("p_name").alias("name")
    )
    return proposals.reapply_saved(detected, saved).groupBy("file", "source").agg(F.count("*").alias("n"))


def _registry_proposals(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    k = F.col("l_linenumber")
    return files.select(
        F.concat(F.lit("extract_"), k.cast("string"), F.lit(".xlsx")).alias("file"),
        F.when(k == 5, -1).when(k == 6, 4).otherwise(0).alias("sheet"),
        F.when(k == 4, 40).otherwise(1).alias("header_row"),
        F.when(k == 2, 1).when(k == 3, 2).when(k == 7, 1).otherwise(0).alias("category"),
        F.when(k == 2, 0).when(k == 7, -1).otherwise(1).alias("units"),
        F.when(k == 3, 0).otherwise(2).alias("zone"),
        F.when(k == 4, 2).when(k == 3, -1).when(k == 7, 0).otherwise(3).alias("municipality"),
        F.lit(-1).alias("unit_name"),
    )


def registry_proposal_verdicts(spark, sf_dir):
    verdict = proposals.validate_registry_proposals(extracts.registry_grids(spark, sf_dir), _registry_proposals(spark, sf_dir))
    return verdict.withColumn("problems", F.array_join("problems", ","))


def registry_layout_for_all(spark, sf_dir):
    """The layout of extract 3 laid on all: each file's rows read by what it then has."""
    grids, top = extracts.registry_body(spark, sf_dir), extracts.registry_heads(spark, sf_dir)
    detected = registry.layouts(grids, top=top)
    given = detected.filter("file = 'extract_3.xlsx'").withColumn("category", F.lit(3))
    chosen = proposals.apply_registry_layout(grids, given, detected)
    return chosen.select("file", "header_row", "category", "units", "zone", "layout_source")


def _edits(spark, sf_dir):
    """Edits of category rules by users: events in order, errors being resets."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"),
        F.col("event_id").alias("edit"),
        F.concat(F.lit("target "), F.col("event_type")).alias("template_key"),
        (F.col("event_type") == "error").alias("reset"),
    )


def rules_in_force(spark, sf_dir):
    return rules.latest(_edits(spark, sf_dir))


def rules_round_trip(spark, sf_dir):
    """Rules written as JSON lines and read back, all three kinds."""
    folder = f"{shared_folder(spark)}/ledgerfold/rules-{uuid.uuid4().hex}"
    rule_files.write_rules(
        extracts.norm_rules(spark, sf_dir), rules.latest(_edits(spark, sf_dir)), extracts.zone_rules(spark, sf_dir), folder
    )
    back = rule_files.read_rule_lines(spark, folder)
    norm = back["norms"].select(F.lit("norm").alias("kind"), "key", F.concat_ws("/", "mode", "entry_name", "expression", "manual_mass").alias("value"))
    target = lambda kind, part: back[part].select(F.lit(kind).alias("kind"), "key", F.col("template_key").alias("value"))
    return norm.unionByName(target("registry", "registry")).unionByName(target("zone", "zones"))


def _stored(spark, sf_dir):
    """Layouts found in the given tables, stored in a rule file and read back.

    The order's tables are stored with tonnes for a factor, the registry's layout
    is that of extract 3 with a category column of its own.
    """
    folder = f"{shared_folder(spark)}/ledgerfold/rules-{uuid.uuid4().hex}"
    order = extracts.norm_grids(spark, sf_dir)
    rows = order.filter(grid.is_significant(F.col("cells")))
    found = norms.detect_layouts(rows)
    counts = norms.header_row_counts(rows, found.select(*grid.TABLE, "data_from"))
    tables = found.join(counts, grid.TABLE).select(
        "table_idx", (-F.col("table_idx")).alias("list_pos"), "header_row_count", *norms.COLUMNS,
        F.lit(1000.0).alias("mass_factor"), F.lit(None).cast("double").alias("volume_factor"), F.lit("plot").alias("basis"), F.lit("помощник").alias("source"),
    )
    detected = registry.layouts(extracts.registry_body(spark, sf_dir), top=extracts.registry_heads(spark, sf_dir))
    markup = detected.filter("file = 'extract_3.xlsx'").select("table_idx", *registry.LAYOUT, F.lit("помощник").alias("source"))
    zones = extracts.zone_rules(spark, sf_dir)
    rule_files.write_rules(extracts.norm_rules(spark, sf_dir), rules.latest(_edits(spark, sf_dir)), zones, folder, tables, markup)
    return rule_files.read_rule_lines(spark, folder)


def stored_layouts_round_trip(spark, sf_dir):
    """Both stored layouts of a rule file, and how many rules stand beside them."""
    back = _stored(spark, sf_dir)
    text = lambda *columns: F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("value")
    layout = ("list_pos", "header_row_count", *norms.COLUMNS, "mass_factor", "volume_factor", "basis", "source")
    told = back["norms_layout"].select(F.lit("norms").alias("kind"), "table_idx", text(*layout))
    told = told.unionByName(back["registry_markup"].select(F.lit("registry").alias("kind"), "table_idx", text(*registry.LAYOUT, "source")))
    beside = [back[k].agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("norms", "registry", "zones")]
    for one in beside:
        told = told.unionByName(one.select(F.concat("kind", F.lit(" rules")).alias("kind"), F.lit(None).cast("int").alias("table_idx"), F.col("n").cast("string").alias("value")))
    return told


def stored_layout_norms(spark, sf_dir):
    """An order per brand, read by the stored layout of one of them.

    Every fifth brand's order has another number of its table, which the layout
    doesn't fit; those are read by detection.
    """
    orders = _brand_orders(spark, sf_dir)
    number = F.regexp_extract("file", r"(\d+)", 1).cast("int")
    orders = orders.withColumn("table_idx", F.when(number % 5 == 4, 1).otherwise(0))
    layout = orders.select(F.lit(0).alias("table_idx"), F.lit(0).alias("list_pos")).distinct().select(
        "*", F.lit(1).alias("header_row_count"), F.lit(0).alias("name_column"), F.lit(-1).alias("unit_column"), F.lit(2).alias("mass_column"),
        F.lit(1).alias("volume_column"), F.lit(1000.0).alias("mass_factor"), F.lit(None).cast("double").alias("volume_factor"),
        F.lit("plot").alias("basis"), F.lit("помощник").alias("source"),
    )
    folder = f"{shared_folder(spark)}/ledgerfold/rules-{uuid.uuid4().hex}"
    zones = extracts.zone_rules(spark, sf_dir)
    rule_files.write_rules(extracts.norm_rules(spark, sf_dir), zones.limit(0), zones, folder, layout)
    stored = rule_files.read_rule_lines(spark, folder)["norms_layout"]
    read = proposals.read_by_stored_layout(orders, rule_files.bind_norms_layout(stored, orders))
    return read.groupBy("file", "source", "basis").agg(
        F.count("*").alias("n"), F.round(F.sum("mass"), 2).alias("mass"), F.round(F.sum("volume"), 2).alias("volume")
    )


def stored_markup_rows(spark, sf_dir):
    """All extracts read by the stored markup of extract 3 where it reads anything."""
    markup = _stored(spark, sf_dir)["registry_markup"]
    body, top = extracts.registry_body(spark, sf_dir), extracts.registry_heads(spark, sf_dir)
    chosen = proposals.apply_registry_layout(body, markup, registry.layouts(body, top=top))
    return registry.cube_of(body, chosen.drop("layout_source")).groupBy("file").agg(
        F.sum("n_rows").alias("n_rows"), F.count_distinct("category").alias("n_category"),
        F.count_distinct(cell_text(F.col("zone"))).alias("n_zone"), F.sum("units").alias("units"),
    )


def parsed_event_rules(spark, sf_dir):
    """Rules standing bare in JSON, one document per event."""
    text = F.concat(
        F.lit('{"registry": {"user '), F.col("user_id").cast("string"), F.lit('": "'), F.col("event_type"), F.lit('"}, "norms": {"'),
        F.get_json_object("props", "$.k"), F.lit('": {"mode": "manual", "manualMass": '), F.col("value").cast("string"), F.lit("}}}"),
    )
    parsed = rule_files.parse_rules(table(spark, sf_dir, "events").select(text.alias("text")))
    norm = parsed["norms"].groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("manual_mass"), 4).alias("total"))
    target = parsed["registry"].groupBy("key").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
    return norm.unionByName(target)


def streamed_groups(spark, sf_dir):
    """Events arriving in several files, rolled up batch by batch."""
    folder = f"{shared_folder(spark)}/ledgerfold/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("day "), F.date_format("ts", "dd")).alias("file"),
        F.col("event_type").alias("zone"),
        F.lit("").alias("municipality"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("category"),
        F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value")).alias("units"),
        F.lit(False).alias("unreadable"),
        F.lit(True).alias("has_units"),
        F.col("event_id").alias("excel_row"),
    )
    rows.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    accumulate(stream, f"{folder}/cube", f"{folder}/checkpoint").awaitTermination()
    found = registry.groups(current_cube(spark, f"{folder}/cube"))
    return found.select("zone_key", "category_key", "n_rows", "sources", "zero_sources", F.round("units", 4).alias("units"), "units_known", "n_files")


def _in_thirds(rows, folder):
    """A stream of typed rows, a third of their files to a batch."""
    spark, count = rows.sparkSession, lambda path: len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    rows.write.parquet(folder)  # once: to ask for the number of partitions before would shuffle all rows a second time
    if count(folder) < 3:
        written, folder = folder, f"{folder}-dealt"
        spark.read.schema(rows.schema).parquet(written).repartition(3).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-count(folder) // 3))).parquet(folder)


def streamed_form(spark, sf_dir):
    """The form after registry rows came in three batches, compacted after the second."""
    folder = f"{shared_folder(spark)}/ledgerfold/stream-{uuid.uuid4().hex}"
    run = queries_reconcile.fresh_run(spark, sf_dir)
    rows = registry.typed_rows(run.inputs.registry, run.registry_layout)
    reconcile_stream(_in_thirds(rows, f"{folder}/in"), run, folder, every=2).awaitTermination()
    filled = forms(spark, folder)
    return filled[max(filled)].select(
        "idx", "excel_row", "zone", "category", "unit", "sources", "units", "mass", "volume", "density", "norm_mass", "norm_volume"
    ).orderBy("idx")


def _edit_log(ruled, first, undone):
    """Every key of ``ruled`` edited twice, the rule coming last; ``undone`` keys edited and reset."""
    fields = [c for c in ruled.columns if c != "key"]
    wrong = lambda keys: keys.select("key", *[F.lit(first.get(c)).cast(ruled.schema[c].dataType).alias(c) for c in fields])
    numbered = lambda rows, n, reset: rows.withColumns({"edit": F.lit(n), "reset": F.lit(reset)})
    return (
        numbered(wrong(ruled), 1, False)
        .unionByName(numbered(ruled, 2, False))
        .unionByName(numbered(wrong(undone), 1, False))
        .unionByName(numbered(wrong(undone), 2, True))
    )


def form_rows_after_edits(spark, sf_dir):
    """Rules laid by edits over a finished run without rules: what they reach is worked out again.

    Categories and norms that no rule names are edited, too, and reset.
    """
    before = queries_reconcile.fresh_run(spark, sf_dir)
    norm_rules, categories, zones = (f(spark, sf_dir) for f in (extracts.norm_rules, extracts.category_rules, extracts.zone_rules))
    others = lambda mapping, ruled: mapping.select("key").join(ruled, "key", "left_anti")
    edits = Edits(
        norms=_edit_log(norm_rules, {"mode": "none"}, others(before.norm_mapping, norm_rules).filter("key LIKE 'green%'")),
        categories=_edit_log(categories, {"template_key": "red bolt"}, others(before.category_mapping, categories).filter("key LIKE 'green%'")),
        zones=_edit_log(zones, {"template_key": ""}, others(before.zone_mapping, zones).filter("key LIKE 'africa%'")),
    )
    rows = Edited(before, edits).results
    doubles = [n for n, t in rows.dtypes if t == "double"]
    return rows.withColumns({c: F.round(c, 6) for c in doubles}).select(
        "excel_row", "category_key", "norm_mode", "sources", "units", "norm_mass", "norm_volume", "norm_error", "mass", "volume"
    )


def functions_in_sql(spark, sf_dir):
    register(spark)
    docs = table(spark, sf_dir, "documents")
    docs.createOrReplaceTempView("ledgerfold_documents")
    return spark.sql(
        "SELECT doc_id, md5(name_key(text)) AS key_md5, size(name_tokens(text)) AS n_tokens, "
        "round(edit_ratio(lang, source), 6) AS ratio, read_number(concat(n_chars, ',5 <*>')) AS number FROM ledgerfold_documents"
    )


QUERIES = {
    f.__name__: f
    for f in (
        norm_proposal_checks, norm_proposal_verdicts, norm_proposal_acceptance, saved_layout_reapplied,
        registry_proposal_verdicts, registry_layout_for_all, rules_in_force, rules_round_trip, parsed_event_rules,
        stored_layouts_round_trip, stored_layout_norms, stored_markup_rows, streamed_groups, streamed_form,
        form_rows_after_edits, functions_in_sql,
    )
}
