"""Queries over the form, the norms, the mappings and the reconciled result."""

from __future__ import annotations

import uuid
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import grid, match, measures, norms, rules, template
from ledgerfold.operators.checks import by_severity
from ledgerfold.plans import extracts, report
from ledgerfold.plans.reconcile import Inputs, Reconciliation, reconcile
from ledgerfold.session import shared_folder
from ledgerfold.sources import landing


def fresh_run(spark: SparkSession, sf_dir: str, by_municipality: bool = False, ruled: bool = False) -> Reconciliation:
    nation = F.concat(F.lit("NATION_"), ((F.col("row_idx") - 3) % 25).cast("string")) if by_municipality else None
    return reconcile(
        Inputs(
            registry=extracts.registry_body(spark, sf_dir),
            registry_top=extracts.registry_heads(spark, sf_dir),
            form=extracts.template_grid(spark, sf_dir, nation),
            order=extracts.norm_grids(spark, sf_dir),
            norm_rules=extracts.norm_rules(spark, sf_dir) if ruled else None,
            category_rules=extracts.category_rules(spark, sf_dir) if ruled else None,
            zone_rules=extracts.zone_rules(spark, sf_dir) if ruled else None,
        )
    )


# The queries below look at one run from different sides; its written tables
# (the cube, the form, the norms, the candidates) are made once per session.
_run = lru_cache(maxsize=8)(fresh_run)


def _rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [n for n, t in frame.dtypes if t == "double"]
    return frame.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else frame


# --- the form -------------------------------------------------------------------


def form_header_roles(spark, sf_dir):
    return template.template_layout(extracts.template_grid(spark, sf_dir))


def form_meta_rows(spark, sf_dir):
    grids = extracts.template_grid(spark, sf_dir)
    return grids.filter(template.is_meta_row(F.col("cells"))).select("file", (F.col("row_idx") + 1).alias("excel_row"))


def form_rows(spark, sf_dir):
    return _run(spark, sf_dir).form_rows.select("excel_row", "idx", "subject", "zone", "municipality", "category", "unit")


def form_categories(spark, sf_dir):
    return _run(spark, sf_dir).form_categories


def form_zones(spark, sf_dir):
    return _run(spark, sf_dir).form_zones


def form_duplicates(spark, sf_dir):
    rows = template.keyed_rows(_run(spark, sf_dir).form_rows)
    return rows.filter("duplicate").select("excel_row", "zone", "category")


# --- norms ----------------------------------------------------------------------


def _norm_rows(spark, sf_dir):
    return extracts.norm_grids(spark, sf_dir).filter(grid.is_significant(F.col("cells")))


def norm_first_data_rows(spark, sf_dir):
    rows = _norm_rows(spark, sf_dir)
    return norms.header_row_counts(rows, norms.first_data_rows(rows))


def norm_column_profile(spark, sf_dir):
    rows = _norm_rows(spark, sf_dir)
    return norms.profile_columns(rows, norms.first_data_rows(rows))


def norm_layouts(spark, sf_dir):
    return norms.detect_layouts(_norm_rows(spark, sf_dir)).select(
        "file", "table_idx", *norms.COLUMNS, "mass_header", "volume_header"
    )


def norm_entries(spark, sf_dir):
    entries = _run(spark, sf_dir).norms
    return _rounded(
        entries.select(
            "file", "table_idx", "pos", "id", "name", "basis", "unit_text", "mass", "volume", "raw_mass", "raw_volume"
        )
    )


def norm_table_counts(spark, sf_dir):
    return norms.table_counts(_run(spark, sf_dir).norms)


def norm_names_changed(spark, sf_dir):
    """What reading the norms without their first table would add and remove."""
    entries = _run(spark, sf_dir).norms
    return norms.compare_names(
        entries.filter(F.col("table_idx") < 3).withColumn("name", F.concat("name", F.lit("/"), "table_idx")),
        entries.filter(F.col("table_idx") > 0).withColumn("name", F.concat("name", F.lit("/"), "table_idx")),
    )


# --- matching -------------------------------------------------------------------


def norm_candidates(spark, sf_dir):
    return _rounded(_run(spark, sf_dir).norm_candidates)


def category_candidates(spark, sf_dir):
    return _rounded(_run(spark, sf_dir).category_candidates.select("key", "rank", "id", "name", "basis", "score"))


def zone_candidates(spark, sf_dir):
    return _rounded(_run(spark, sf_dir).zone_candidates.select("key", "rank", "id", "name", "score"))


def norm_mapping(spark, sf_dir):
    return _rounded(_run(spark, sf_dir).norm_mapping.select("key", "mode", "entry_id", "score", "status", "auto"))


def category_mapping(spark, sf_dir):
    return _rounded(_run(spark, sf_dir).category_mapping)


def zone_mapping(spark, sf_dir):
    return _rounded(_run(spark, sf_dir).zone_mapping)


def mapping_status_histogram(spark, sf_dir):
    return match.status_histogram(_run(spark, sf_dir, ruled=True).norm_mapping)


def mapping_review(spark, sf_dir):
    run = _run(spark, sf_dir, ruled=True)
    names = run.form_categories.select(F.col("category_key").alias("key"), "name")
    mapping = run.norm_mapping.join(names, "key")
    shown = [
        rules.review_norms(mapping, show, "R").select(F.lit(show).alias("shown"), "key")
        for show in ("all", "attention", "none", "manual")
    ]
    reg = run.category_mapping.join(run.registry_categories.select(F.col("category_key").alias("key"), "name"), "key")
    shown += [
        rules.review_registry(reg, show, "ring").select(F.lit(f"registry {show}").alias("shown"), "key")
        for show in ("all", "attention", "none", "manual")
    ]
    out = shown[0]
    for more in shown[1:]:
        out = out.unionByName(more)
    return out.groupBy("shown").agg(F.count("*").alias("n"))


# --- the result -----------------------------------------------------------------


def _result_columns(rows: DataFrame) -> DataFrame:
    return _rounded(
        rows.select(
            "excel_row", "idx", "zone_key", "municipality_key", "category_key", "duplicate", "sources", "units",
            "units_known", "registry_rows", "zero_sources", "norm_mass", "norm_volume", "mass", "volume", "density",
        )
    )


def reconciled_rows(spark, sf_dir):
    return _result_columns(_run(spark, sf_dir).results)


def reconciled_rows_by_municipality(spark, sf_dir):
    return _result_columns(_run(spark, sf_dir, by_municipality=True).results)


def reconciled_rows_with_rules(spark, sf_dir):
    rows = _run(spark, sf_dir, ruled=True).results
    return _rounded(
        rows.select(
            "excel_row", "category_key", "norm_mode", "sources", "units", "norm_mass", "norm_volume", "norm_error", "mass", "volume"
        )
    )


def filled_form(spark, sf_dir):
    return report.filled_form(_run(spark, sf_dir)).select(
        "idx", "excel_row", "zone", "category", "unit", "sources", "units", "mass", "volume", "density",
        "norm_mass", "norm_volume",
    ).orderBy("idx")


def result_parts(spark, sf_dir):
    parts = _run(spark, sf_dir).parts
    return parts.select(*measures.KEYS, "zone", "municipality", "category", "sources", "units")


def rows_with_data(spark, sf_dir):
    return measures.with_data(_run(spark, sf_dir).results).select("excel_row", "units", "sources")


def unassigned(spark, sf_dir):
    items = measures.by_weight(_run(spark, sf_dir).unassigned)
    return items.select("zone", "category", "reason", "n_rows", "units", "sources", "n_groups", "n_municipalities")


def unassigned_by_municipality(spark, sf_dir):
    items = _run(spark, sf_dir, by_municipality=True).unassigned
    return items.select("zone", "municipality", "category", "reason", "n_rows", "units", "sources", "n_groups")


def balance_totals(spark, sf_dir):
    return _run(spark, sf_dir).balance


def balance_checks(spark, sf_dir):
    return _run(spark, sf_dir).checks


def issues(spark, sf_dir):
    rows = by_severity(_run(spark, sf_dir).issues)
    return rows.select("level", "code", "excel_row", "zone", "category", "note", "n_rows", "units", "sources")


def issues_with_rules(spark, sf_dir):
    rows = _run(spark, sf_dir, ruled=True).issues.filter("code <> 'unassigned'")
    return rows.select("level", "code", "excel_row", "category", "note")


def run_summary(spark, sf_dir):
    return _run(spark, sf_dir).summary


# --- report tables ----------------------------------------------------------------


def report_norm_mapping(spark, sf_dir):
    return _rounded(report.norm_mapping_table(_run(spark, sf_dir, ruled=True)))


def report_registry_mapping(spark, sf_dir):
    return report.registry_mapping_table(_run(spark, sf_dir))


def report_rows(spark, sf_dir):
    return report.result_table(_run(spark, sf_dir))


def _files(spark, sf_dir):
    return extracts.registry_heads(spark, sf_dir).select(F.lit("Реестр ИОО").alias("label"), F.col("file").alias("name")).distinct()


def report_verification(spark, sf_dir):
    return report.verification_table(_run(spark, sf_dir), _files(spark, sf_dir))


def report_round_trip(spark, sf_dir):
    """The five report tables written and read back: rows, columns and filled cells of each."""
    folder = f"{shared_folder(spark)}/ledgerfold/report-{uuid.uuid4().hex}"
    landing.write_report(_run(spark, sf_dir), _files(spark, sf_dir), folder)
    counted = [
        frame.agg(
            F.lit(name).alias("report_table"),
            F.count("*").alias("n_rows"),
            F.lit(len(frame.columns)).alias("n_columns"),
            sum((F.count(c) for c in frame.columns), F.lit(0)).cast("bigint").alias("n_cells"),
        )
        for name, frame in landing.read_report(spark, folder).items()
    ]
    return reduce(DataFrame.unionByName, counted)


def report_norms(spark, sf_dir):
    return _rounded(report.norms_table(_run(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        form_header_roles, form_meta_rows, form_rows, form_categories, form_zones, form_duplicates,
        norm_first_data_rows, norm_column_profile, norm_layouts, norm_entries, norm_table_counts, norm_names_changed,
        norm_candidates, category_candidates, zone_candidates, norm_mapping, category_mapping, zone_mapping,
        mapping_status_histogram, mapping_review,
        reconciled_rows, reconciled_rows_by_municipality, reconciled_rows_with_rules, filled_form, result_parts,
        rows_with_data, unassigned, unassigned_by_municipality, balance_totals, balance_checks, issues,
        issues_with_rules, run_summary,
        report_norm_mapping, report_registry_mapping, report_rows, report_verification, report_norms,
        report_round_trip,
    )
}
