"""Reading landed grids and cells, and writing the results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerfold.functions.text import let
from ledgerfold.plans import report
from ledgerfold.plans.reconcile import Reconciliation

GRID_SCHEMA = "file string, table_idx int, title string, row_idx bigint, cells array<string>"
CELL_SCHEMA = "file string, table_idx int, row_idx bigint, col_idx int, value string"
REPORT_TABLES = ("verification", "norm_mapping", "registry_mapping", "rows", "norms")


def read_grids(spark: SparkSession, *paths: str) -> DataFrame:
    """Grids landed as parquet; several extracts are read as one."""
    return spark.read.schema(GRID_SCHEMA).parquet(*paths)


def read_csv_extracts(spark: SparkSession, *paths: str, width: int | None = None, separator: str = ",", by_path: bool = False) -> DataFrame:
    """CSV extracts as grids, with the name of its file on every row.

    ``by_path`` names a file by its whole path, for folders that hold files of
    equal names, which are told apart no other way.

    Lines are read whole and parted here, so rows may have any number of cells,
    blank lines count and ``row_idx`` is the number of the line, from 0.  Quoted
    cells may hold separators and doubled quotes; a quoted line break is not put
    together again, see ``broken_csv_lines``.  A large file is split over tasks,
    so lines are numbered within their block and the blocks are then set one
    after the other; a block has one row beside it, so lines stay in place.  ``width`` is accepted for older callers and limits nothing.
    """
    block = F.col("_metadata.file_block_start")
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path" if by_path else "_metadata.file_name").alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("order"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("line")
    )
    firsts = lines.groupBy("file", "block").agg(F.min("order").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = firsts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(F.broadcast(bases.select("file", "block", "first", "base")), ["file", "block"]).select(
        "file", F.lit(0).alias("table_idx"), F.lit("").alias("title"), (F.col("order") - F.col("first") + F.col("base")).alias("row_idx"), csv_cells(F.col("line"), separator).alias("cells")
    )


def csv_cells(line: Column, separator: str = ",") -> Column:
    """Cells of one CSV line; empty ones at the end are left out.

    A separator is put before the line, so that every match takes one: an empty
    match would let the search step over the separator after it.
    """
    sep = re.escape(separator)
    found = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(f'{sep}("(?:[^"]|"")*"|[^{sep}]*)'), F.lit(1))
    plain = F.transform(found, lambda c: F.when(c.rlike('^".*"$'), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return let(plain, lambda cells: F.slice(cells, F.lit(1), F.coalesce(F.array_max(F.transform(cells, lambda c, i: F.when(c != "", i + 1).otherwise(0))), F.lit(0))))


def broken_csv_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``(file, line)`` of lines with a quote that they don't close: a cell broken over lines."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return lines.filter(F.length(F.regexp_replace("line", '[^"]+', "")) % 2 == 1)


def read_cells(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(CELL_SCHEMA).parquet(*paths)


def write_form(run: Reconciliation, path: str) -> None:
    """The filled form; writing it again replaces it and adds no columns."""
    report.filled_form(run).orderBy("idx").write.mode("overwrite").parquet(path)


def report_tables(run: Reconciliation, files: DataFrame) -> dict[str, DataFrame]:
    return {
        "verification": report.verification_table(run, files),
        "norm_mapping": report.norm_mapping_table(run),
        "registry_mapping": report.registry_mapping_table(run),
        "rows": report.result_table(run),
        "norms": report.norms_table(run),
    }


def write_report(run: Reconciliation, files: DataFrame, folder: str) -> None:
    """The five report tables, one folder each."""
    for name, frame in report_tables(run, files).items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_report(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five tables of a written report."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in REPORT_TABLES}


def csv_line(cells: Column, separator: str = ",") -> Column:
    """One CSV line of cells, readable by ``csv_cells``; null cells are empty."""
    quoted = F.transform(cells, lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')))
    return F.array_join(quoted, separator)
