"""Queries of table reconstruction over the words of all documents."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerfold.operators import page_layout, scan_layout
from ledgerfold.operators.geometry import beside_bands, cluster_starts, rows_below
from ledgerfold.plans.extracts import cell_fragments, scan_fragments, table
from ledgerfold.session import cut

# Rows of pages and straightened words would take more room than their texts, so pages are read
# anew where they are needed.
_rows = lru_cache(maxsize=4)(lambda spark, sf_dir: page_layout.read_rows(cell_fragments(spark, sf_dir)))
_scans = lru_cache(maxsize=4)(lambda spark, sf_dir: scan_layout.read_pages(scan_fragments(spark, sf_dir)))


def scanned_documents(spark, sf_dir):
    """Documents by lines: those whose lines are mostly single words look scanned."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("text"))
    return page_layout.scanned_documents(lines)


def page_measures(spark, sf_dir):
    found = page_layout.page_measures(cell_fragments(spark, sf_dir))
    return found.select("doc", "page", "text_height", F.round("pitch", 6).alias("pitch"), F.array_join("columns", "|").alias("columns"))


def page_rows(spark, sf_dir):
    """Reconstructed rows of every page, summed up by a digest of their cells."""
    line = F.array_join(F.transform("cells", lambda c: c["text"]), "|")
    rows = _rows(spark, sf_dir).select("doc", "page", "row_idx", F.size("cells").alias("n"), line.alias("line"))
    return rows.groupBy("doc", "page").agg(
        F.count("*").alias("n_rows"),
        F.sum("n").alias("n_cells"),
        F.md5(F.array_join(F.sort_array(F.collect_list(F.struct("row_idx", "line")))["line"], "/")).alias("digest"),
    )


def page_blocks(spark, sf_dir):
    found = page_layout.blocks(_rows(spark, sf_dir))
    return found.select(
        "doc", "page", "block", F.size("rows").alias("n_rows"), F.size("caption").alias("n_caption"), F.array_join("edges", "|").alias("edges")
    )


def document_tables(spark, sf_dir):
    rows = page_layout.document_tables(_rows(spark, sf_dir))
    line = F.array_join("cells", "|").alias("line")
    return (
        rows.select("doc", "table_place", "title", "page", "row_idx", F.size("cells").alias("width"), line)
        .groupBy("doc", "table_place")
        .agg(
            F.max("title").alias("title"),
            F.count("*").alias("n_rows"),
            F.max("width").alias("n_columns"),
            F.md5(F.array_join(F.sort_array(F.collect_list(F.struct("page", "row_idx", "line")))["line"], "/")).alias("digest"),
        )
    )


def single_page_tables(spark, sf_dir):
    rows = page_layout.page_tables(_rows(spark, sf_dir))
    return rows.groupBy("doc", "page", "block").agg(
        F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_columns"), F.max("title").alias("title")
    )


def scan_slopes(spark, sf_dir):
    slopes = scan_layout.skew_slopes(scan_fragments(spark, sf_dir))
    true = F.when(F.col("doc") % 2 == 1, 0.02).otherwise(0.0)
    return slopes.select("doc", "page", "text_height", "n_lines", (F.abs(F.col("slope") - true) <= 0.004).alias("found"))


def scan_runs(spark, sf_dir):
    found = scan_layout.runs(_scans(spark, sf_dir))
    return found.groupBy("doc", "page").agg(
        F.count("*").alias("n_runs"), F.sum("n_words").alias("n_words"), F.round(F.sum(F.col("x1") - F.col("x0")), 4).alias("length")
    )


def scan_bands(spark, sf_dir):
    profile = cut(scan_layout.cover(scan_layout.runs(_scans(spark, sf_dir))))
    return scan_layout.document_bands(profile).select(
        "doc", "page", F.array_join(F.transform("bands", lambda b: b["x0"].cast("int").cast("string")), "|").alias("starts")
    )


def scan_forced_bands(spark, sf_dir):
    """Every page split into two columns, whatever it has."""
    profile = cut(scan_layout.cover(scan_layout.runs(_scans(spark, sf_dir))))
    wanted = profile.select("doc", "page", F.lit(2).alias("wanted")).distinct()
    return scan_layout.bands_for_count(profile, wanted).select("doc", "page", F.size("bands").alias("n"))


def scan_tables(spark, sf_dir):
    bands = cut(scan_layout.document_bands(cut(scan_layout.cover(scan_layout.runs(_scans(spark, sf_dir))))))
    rows = scan_layout.page_tables(scan_fragments(spark, sf_dir), bands).select("doc", "page", "row_idx", F.array_join("cells", "|").alias("line"))
    return rows.groupBy("doc", "page").agg(
        F.count("*").alias("n_rows"),
        F.md5(F.array_join(F.sort_array(F.collect_list(F.struct("row_idx", "line")))["line"], "/")).alias("digest"),
    )


def value_clusters(spark, sf_dir):
    """Chains of event values per user, neighbours lying within one."""
    values = table(spark, sf_dir, "events").select("user_id", "value").distinct()
    starts = cluster_starts(values, ["user_id"], "value", F.lit(1.0))
    return starts.groupBy("user_id").agg(F.count("*").alias("n_clusters"), F.round(F.sum("value"), 6).alias("starts"))


def _edges(spark, sf_dir):
    """Per type of part: the distinct sizes of its parts as edges, numbered in ascending order."""
    sizes = table(spark, sf_dir, "part").select("p_type", (F.col("p_size") * 30.0).alias("edge")).distinct()
    order = Window.partitionBy("p_type").orderBy("edge")
    return sizes.withColumn("idx", F.row_number().over(order) - 1)


def nearest_edges(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_retailprice")
    edges = _edges(spark, sf_dir)
    bands = edges.select("p_type", "idx", F.col("edge").alias("x0"), F.col("edge").alias("x1"))
    found = beside_bands(parts, bands, ["p_type"], "p_retailprice", "edge")
    below = rows_below(found, edges.withColumnRenamed("edge", "y"), ["p_type"], "p_retailprice", "row")
    return below.select("p_partkey", "edge", "row")


def nearest_bands(spark, sf_dir):
    """Bands of 40 at every 30: a price can lie in two, and takes the first."""
    parts = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_retailprice")
    bands = _edges(spark, sf_dir).select("p_type", "idx", F.col("edge").alias("x0"), (F.col("edge") + 40).alias("x1"))
    return beside_bands(parts, bands, ["p_type"], "p_retailprice", "band").select("p_partkey", "band")


QUERIES = {
    f.__name__: f
    for f in (
        scanned_documents, page_measures, page_rows, page_blocks, document_tables, single_page_tables, scan_slopes,
        scan_runs, scan_bands, scan_forced_bands, scan_tables, value_clusters, nearest_edges, nearest_bands,
    )
}
