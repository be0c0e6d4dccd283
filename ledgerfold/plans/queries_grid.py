"""Queries of the grid operators over grids derived from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold.operators import grid, kinds, norms
from ledgerfold.operators.relational import running_position
from ledgerfold.plans import extracts
from ledgerfold.plans.extracts import table


def _joined(frame, separator="|"):
    return frame.withColumn("cells", F.array_join("cells", separator))


def dense_rows(spark, sf_dir):
    """Orders per customer and month: sparse cells into rows of twelve."""
    cells = (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", "o_custkey", F.month("o_orderdate").alias("col_idx"))
        .agg(F.count("*").cast("string").alias("value"))
        .select(
            F.col("o_orderpriority").alias("file"),
            F.lit(0).alias("table_idx"),
            F.col("o_custkey").alias("row_idx"),
            F.col("col_idx"),
            F.when(F.col("value") == "2", "").otherwise(F.col("value")).alias("value"),
        )
    )
    return _joined(grid.dense_rows(cells, 13))


def expanded_spans(spark, sf_dir):
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg((F.count("*") % 3 + 1).cast("int").alias("span"), F.min("l_returnflag").alias("value"))
        .select(
            F.lit("order.docx").alias("file"),
            F.lit(0).alias("table_idx"),
            F.col("l_orderkey").alias("row_idx"),
            F.col("l_linenumber").alias("col_idx"),
            "span",
            "value",
        )
    )
    return grid.expand_spans(cells)


def filled_down(spark, sf_dir):
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_linenumber", (F.col("l_quantity") % 4).cast("int").alias("col_idx"))
        .agg(F.min("l_returnflag").alias("flag"), F.count("*").alias("n"))
        .filter("n % 5 > 0")
        .select(
            F.lit("order.docx").alias("file"),
            F.col("l_suppkey").cast("int").alias("table_idx"),
            (F.col("l_linenumber") - 1).alias("row_idx"),
            "col_idx",
            F.when(F.col("n") % 2 == 0, "").otherwise(F.concat("flag", F.col("n").cast("string"))).alias("value"),
        )
    )
    return grid.fill_down(cells)


def table_captions(spark, sf_dir):
    """Orders of a priority as a document: finished ones are tables, others paragraphs."""
    number = F.col("o_custkey")
    body = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("file"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderstatus") == "F").alias("is_table"),
        F.when(number % 5 == 0, "").otherwise(F.concat("o_orderstatus", number.cast("string"))).alias("text"),
    )
    return grid.captions(body)


def service_rows(spark, sf_dir):
    size, name = F.col("p_size") % 6, F.col("p_name")
    cells = (
        F.when(size == 0, F.array_repeat(F.concat(F.lit("Раздел "), "p_brand"), 3))
        .when(size == 1, F.array(F.concat(F.lit("(в ред. "), "p_brand", F.lit(")")), F.lit("1,5")))
        .when(size == 2, F.array(F.lit(""), F.lit("  "), F.lit("")))
        .when(size == 3, F.array(F.lit("1"), F.lit("2."), F.lit(" 3 ")))
        .when(size == 4, F.array(F.lit("2"), F.lit("3")))
        .otherwise(F.array(name, F.lit("1,5")))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", cells.alias("cells"))
    c = F.col("cells")
    return rows.select(
        "p_partkey",
        grid.is_significant(c).alias("significant"),
        grid.is_spanning(c).alias("spanning"),
        grid.is_numbering(c).alias("numbering"),
        grid.is_service(c, F.lit(0)).alias("service"),
    )


def _brand_grids(spark, sf_dir):
    """One table per brand whose header comes back now and then."""
    turn, name = F.col("p_partkey") % 10, F.col("p_name")
    cells = (
        F.when(turn == 0, F.array(F.lit("Наименование"), F.lit("куб.м в год"), F.lit("кг в год")))
        .when(turn == 9, F.array(F.lit("Наименование"), F.lit(""), F.lit("")))
        .otherwise(F.array(name, F.lit("1,5"), F.lit("2,5")))
    )
    rows = table(spark, sf_dir, "part").select(
        F.concat("p_brand", F.lit(".pdf")).alias("file"),
        F.lit(0).alias("table_idx"),
        F.lit("").alias("title"),
        "p_partkey",
        cells.alias("cells"),
    )
    return running_position(rows, ["file"], "p_partkey", "row_idx").drop("p_partkey")


def split_tables(spark, sf_dir):
    parts = grid.split_on_repeated_header(_brand_grids(spark, sf_dir))
    return parts.groupBy("file", "part").agg(
        F.count("*").alias("n_rows"), F.min("row_idx").alias("first_row"), F.max("part_row").alias("last_part_row")
    )


def header_samples(spark, sf_dir):
    sample = grid.header_sample(extracts.registry_grids(spark, sf_dir))
    return _joined(sample.select("file", "table_idx", "sample_row", "cells"))


def _event_grids(spark, sf_dir):
    """Tables of 1, 2, 4, 8 … rows of sixteen cells."""
    events = table(spark, sf_dir, "events")
    number = F.col("event_id") + 1
    return events.select(
        F.lit("order.docx").alias("file"),
        (F.length(F.bin(number)) - 1).alias("table_idx"),
        F.col("event_type").alias("title"),
        F.col("event_id").alias("row_idx"),
        F.array_repeat(F.col("value").cast("string"), 16).alias("cells"),
    )


def sample_allowances(spark, sf_dir):
    return grid.sample_allowance(_event_grids(spark, sf_dir))


def norms_sample(spark, sf_dir):
    sample = grid.norms_sample(_event_grids(spark, sf_dir))
    return sample.groupBy("file", "table_idx").agg(
        F.count("*").alias("n_rows"), F.max("sig_idx").alias("last"), F.max(F.size("cells")).cast("bigint").alias("width")
    )


def file_kinds(spark, sf_dir):
    """Suppliers as files whose name and header tell what they are."""
    turn, name = F.col("s_suppkey") % 9, F.regexp_replace("s_name", "#", "_")
    file = (
        F.when(turn == 0, F.concat(name, F.lit(".docx")))
        .when(turn == 5, F.concat(name, F.lit("_Нормативы.xlsx")))
        .when(turn == 6, F.concat(name, F.lit("_Общие сведения.xlsx")))
        .when(turn == 7, F.concat(name, F.lit("_реестр.xlsx")))
        .otherwise(F.concat(name, F.lit(".xlsx")))
    )
    header = (
        F.when(turn == 1, F.array(F.lit("Категория"), F.lit("Расчетная масса, т")))
        .when(turn == 2, F.array(F.lit("Наименование категории"), F.lit("кг в год")))
        .when(turn == 3, F.array(F.lit("Категория потребителя"), F.lit("Зона деятельности")))
        .when(turn == 4, F.array(F.lit("Категория"), F.lit("прочее")))
        .otherwise(F.array(F.lit("таблица"), F.col("s_name")))
    )
    suppliers = table(spark, sf_dir, "supplier").select(file.alias("file"), header.alias("header"), "s_name")
    files = suppliers.select("file")
    grids = suppliers.select(
        "file",
        F.lit(0).alias("table_idx"),
        F.lit("Лист1").alias("title"),
        F.posexplode(F.array(F.array("s_name"), F.col("header"))).alias("row_idx", "cells"),
    )
    return kinds.detect_kinds(files, grids)


def norm_skipped_tables(spark, sf_dir):
    """The order with a table of remarks per part brand, which yields nothing."""
    order = extracts.norm_grids(spark, sf_dir)
    brands = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    remarks = brands.select(
        F.lit("order.docx").alias("file"),
        (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") + 10).alias("table_idx"),
        F.lit("Изменения").alias("title"),
        F.col("p_partkey").alias("row_idx"),
        F.array(F.lit("Список изменяющих документов"), F.lit("")).alias("cells"),
    )
    both = order.unionByName(remarks)
    return norms.skipped_tables(both, norms.read_norms(both)).select("file", "table_idx", "n_rows")


def explicit_norm_layouts(spark, sf_dir):
    """Tables 1 and 4 read by given layouts: tonnes taken for kilograms, columns swapped."""
    order = extracts.norm_grids(spark, sf_dir)
    tables = order.filter(F.col("table_idx").isin(1, 4)).select("file", "table_idx").distinct()
    given = tables.select(
        "file",
        "table_idx",
        F.lit(3).alias("header_row_count"),
        F.lit(0).alias("name_column"),
        F.lit(-1).alias("unit_column"),
        F.when(F.col("table_idx") == 1, 2).otherwise(1).alias("mass_column"),
        F.when(F.col("table_idx") == 1, -1).otherwise(2).alias("volume_column"),
        F.when(F.col("table_idx") == 1, 1.0).cast("double").alias("mass_factor"),
        F.lit("place").alias("basis"),
        (-F.col("table_idx")).alias("list_pos"),
    )
    return norms.apply_layouts(order, given).select("table_idx", "pos", "name", "basis", "mass", "volume")


def explicit_norm_layout_errors(spark, sf_dir):
    """Layouts that fit (table 0) and that don't: header below the last row (1), no name
    column (2), names taken for masses (3), and a table per part brand that isn't there."""
    order = extracts.norm_grids(spark, sf_dir)
    there = order.filter(F.col("table_idx") < 4).select("file", "table_idx").distinct()
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    absent = brands.select(F.lit("order.docx").alias("file"), (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") + 10).alias("table_idx"))
    number = F.col("table_idx")
    given = there.unionByName(absent).select(
        "file",
        "table_idx",
        F.when(number == 1, 2_000_000_000).otherwise(3).alias("header_row_count"),
        F.when(number == 2, -1).when(number == 3, 1).otherwise(0).alias("name_column"),
        F.lit(-1).alias("unit_column"),
        F.when(number == 3, 0).otherwise(2).alias("mass_column"),
        F.when(number == 3, -1).otherwise(1).alias("volume_column"),
    )
    return norms.layout_errors(order, given, norms.apply_layouts(order, given))


QUERIES = {
    f.__name__: f
    for f in (
        dense_rows, expanded_spans, filled_down, table_captions, service_rows, split_tables, header_samples,
        sample_allowances, norms_sample, file_kinds, norm_skipped_tables, explicit_norm_layouts,
        explicit_norm_layout_errors,
    )
}
