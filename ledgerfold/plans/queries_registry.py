"""Registry queries: scan, layout detection and roll-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import registry
from ledgerfold.plans import extracts
from ledgerfold.session import cut, shared_folder
from ledgerfold.sources.landing import csv_line, read_csv_extracts


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = extracts.registry_body(spark, sf_dir)
    return registry.typed_rows(body, registry.layouts(body, top=extracts.registry_heads(spark, sf_dir)))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.layouts(extracts.registry_body(spark, sf_dir), top=extracts.registry_heads(spark, sf_dir))


def _odd_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All extracts, one more that has a header alone, and one that has none."""
    heads, body = extracts.registry_heads(spark, sf_dir), extracts.registry_body(spark, sf_dir)
    named = lambda rows, file, new: rows.filter(F.col("file") == file).withColumn("file", F.lit(new))
    body = body.unionByName(named(body, "extract_2.xlsx", "extract_9.xlsx"))
    return body, registry.layouts(body, top=heads.unionByName(named(heads, "extract_1.xlsx", "extract_0.xlsx")))


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.cube_of(extracts.registry_body(spark, sf_dir), _layout(spark, sf_dir))


def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select(
        "file", "excel_row", "category", "units", "units_missing", "unreadable", "zone", "municipality", "has_units"
    )


def registry_header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.detect_columns(extracts.registry_grids(spark, sf_dir))
    return found.select("file", "table_idx", "header_row", *registry.COLUMN_PATTERNS, "score")


def registry_best_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each extract twice in one file: whole, and without its unit-less rows."""
    whole = extracts.registry_grids(spark, sf_dir)
    shorter = whole.filter((F.col("row_idx") < 2) | (F.col("row_idx") % 3 == 0)).withColumn("table_idx", F.lit(1))
    both = whole.unionByName(shorter)
    return registry.best_sheet(both, cut(registry.detect_columns(both))).select("file", "table_idx", "header_row")


def registry_explicit_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract 3 read by a layout that takes its zone for the municipality."""
    number = lambda n: F.lit(n).cast("int")
    heads = extracts.registry_heads(spark, sf_dir)
    given = (
        heads.filter((F.col("file") == "extract_3.xlsx") & (F.col("row_idx") == 1))
        .select(
            "file",
            "table_idx",
            F.col("row_idx").alias("header_row"),
            number(2).alias("category"),
            number(1).alias("units"),
            number(None).alias("zone"),
            number(0).alias("municipality"),
            number(None).alias("unit_name"),
        )
    )
    body = extracts.registry_body(spark, sf_dir)
    return registry.cube_of(body, registry.layouts(body, given, heads)).groupBy("file").agg(
        F.sum("n_rows").alias("n_rows"),
        F.count_if(F.col("zone") == "").alias("without_zone"),
        F.count_distinct("municipality").alias("n_municipalities"),
        F.sum("units").alias("units"),
    )


def csv_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extracts written as CSV, four files each, and read again with all their lines."""
    folder = f"{shared_folder(spark)}/ledgerfold/csv-{uuid.uuid4().hex}"
    heads = extracts.registry_heads(spark, sf_dir).withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    body = extracts.registry_body(spark, sf_dir).withColumn("part", (F.col("row_idx") % 4).cast("int"))
    lines = heads.unionByName(body).select(F.regexp_extract("file", r"(\d+)", 1).alias("extract"), "part", "row_idx", csv_line(F.col("cells")).alias("line"))
    ordered = lines.repartition("extract", "part").sortWithinPartitions("extract", "part", "row_idx")
    ordered.drop("row_idx").write.partitionBy("extract", "part").text(folder)
    grids = read_csv_extracts(spark, folder, by_path=True)
    return registry.cube_of(grids, registry.layouts(grids)).groupBy(F.regexp_extract("file", r"extract=(\d+)", 1).cast("int").alias("extract")).agg(
        F.count_distinct("file").alias("n_files"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_unknown").alias("n_unknown"),
        F.sum("n_unreadable").alias("n_unreadable"),
        F.count_distinct("category").alias("n_category"),
        F.sum("units").alias("units"),
    )


def registry_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.groups(_cube(spark, sf_dir))


def registry_group_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.group_files(_cube(spark, sf_dir))


def registry_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.by_size(registry.categories(_cube(spark, sf_dir)))


def registry_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.by_size(registry.zones(_cube(spark, sf_dir)))


def registry_municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.by_size(registry.municipalities(_cube(spark, sf_dir)))


def registry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.totals(_cube(spark, sf_dir), _layout(spark, sf_dir))


def registry_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    body, layout = _odd_files(spark, sf_dir)
    return registry.file_stats(registry.cube_of(body, layout), layout)


def unread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.unread_files(*_odd_files(spark, sf_dir))


def registry_distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.distinct_names(_cube(spark, sf_dir))


def registry_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.warnings(_rows(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        registry_scan,
        registry_header_columns,
        registry_best_sheet,
        registry_explicit_layout,
        csv_extracts,
        registry_groups,
        registry_group_files,
        registry_categories,
        registry_zones,
        registry_municipalities,
        registry_totals,
        registry_file_stats,
        unread_files,
        registry_distinct_names,
        registry_warnings,
    )
}
