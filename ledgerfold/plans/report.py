"""The five report tables and the filled form, as DataFrames ready to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.labels import basis_label, level_label, mode_label, percent, status_label
from ledgerfold.functions.text import round_half_up
from ledgerfold.operators import formula
from ledgerfold.operators.measures import written
from ledgerfold.plans.reconcile import Reconciliation

# --- fixed values: labels of the summary, in its order ------------------------
SUMMARY_LABELS = {
    "template_rows": "Строк в файле общих сведений",
    "rows_with_data": "Из них с данными реестра",
    "rows_empty": "Из них без данных (нули)",
    "rows_without_norm": "Категорий без норматива",
    "registry_rows": "Строк в реестре ИОО",
    "registry_zero_rows": "Из них с нулевым количеством единиц",
    "registry_categories": "Уникальных категорий в реестре",
    "total_sources": "Итого источников (столбец F)",
    "total_units": "Итого расчётных единиц (столбец G)",
    "total_mass": "Итого расчётная масса, т",
    "total_volume": "Итого расчётный объем, м³",
    "average_density": "Средний коэффициент плотности, т/м³",
    "unassigned_groups": "Групп реестра вне файла",
    "errors": "Ошибок",
    "warnings": "Предупреждений",
}
CHECK_OK, CHECK_OFF = "сходится", "РАСХОЖДЕНИЕ"
BY_HAND, VALUES_BY_HAND = "да", "значения заданы вручную"
NO_ISSUES = "Замечаний нет: файл не противоречит исходным данным."


def _plain(column: str, kind: str) -> Column:
    """A value as readers expect it: no exponent, no zeros after the last digit, nothing for null."""
    value = F.col(column)
    if kind == "double":
        value = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    return F.coalesce(value.cast("string"), F.lit(""))


def _checked(auto: Column) -> Column:
    return F.when(~auto, F.lit(BY_HAND)).otherwise(F.lit(""))


def norm_mapping_table(run: Reconciliation) -> DataFrame:
    """Form categories and the norms chosen for them."""
    mapping, norms = run.norm_mapping, run.norms
    readable = formula.humanize(mapping.filter("mode = 'formula'").select("key", "expression"), norms)
    entries = norms.select("id", F.col("name").alias("entry_name"), F.col("basis").alias("entry_basis"))
    # The norm of a category is the same on all its rows, so any row stands for it.
    resolved = run.norms_of.select("key", "norm_mass", "norm_volume")
    joined = (
        run.form_categories.select(F.col("category_key").alias("key"), "name", "unit", "first_idx")
        .join(mapping, "key", "left")
        .join(entries, F.col("entry_id") == F.col("id"), "left")
        .join(readable.select("key", F.col("expression").alias("readable")), "key", "left")
        .join(resolved, "key", "left")
    )
    mode = F.col("mode")
    return joined.select(
        F.col("first_idx").alias("position"),
        F.col("name").alias("category"),
        "unit",
        mode_label(mode).alias("mode"),
        F.when(mode == "formula", F.coalesce("readable", "expression"))
        .when(mode == "manual", F.lit(VALUES_BY_HAND))
        .otherwise(F.coalesce("entry_name", F.lit("")))
        .alias("norm"),
        F.coalesce(basis_label(F.col("entry_basis")), F.lit("")).alias("norm_unit"),
        "norm_mass",
        "norm_volume",
        F.coalesce(status_label(F.col("status")), F.lit("")).alias("status"),
        F.when((mode == "single") & F.col("auto"), percent(F.col("score"))).otherwise("").alias("similarity"),
        _checked(F.col("auto")).alias("checked"),
    )


def registry_mapping_table(run: Reconciliation) -> DataFrame:
    """Registry categories and the form categories they go to."""
    targets = run.form_categories.select(F.col("category_key").alias("template_key"), F.col("name").alias("target"))
    mapping = run.category_mapping.withColumnRenamed("key", "category_key")
    joined = run.registry_categories.join(mapping, "category_key", "left").join(targets, "template_key", "left")
    return joined.select(
        F.col("name").alias("category"),
        "n_rows",
        round_half_up(F.col("units"), 2).alias("units"),
        F.coalesce("target", F.lit("")).alias("form_category"),
        F.coalesce(status_label(F.col("status")), F.lit("")).alias("status"),
        F.when(F.col("auto"), percent(F.col("score"))).otherwise("").alias("similarity"),
        _checked(F.col("auto")).alias("checked"),
    )


def result_table(run: Reconciliation) -> DataFrame:
    """Row by row what is written into the form, with the exact sum beside it."""
    exact = F.coalesce(round_half_up(F.col("units"), 4), F.lit(0.0)).alias("exact_units")
    rows = run.results
    return rows.select(
        "excel_row",
        "zone",
        "category",
        "unit",
        "sources",
        *[
            F.coalesce(round_half_up(F.col(c), d), F.lit(0.0)).alias(c)
            for c, d in (("units", 0), ("mass", 2), ("volume", 2), ("density", 2))
        ],
        "norm_mass",
        "norm_volume",
        "registry_rows",
        "zero_sources",
        exact,
    )


def verification_table(run: Reconciliation, files: DataFrame) -> DataFrame:
    """Files, summary, checks and issues as rows of section, label and values.

    ``files`` is ``(label, name)``.
    """
    empty = F.lit("")
    kinds = dict(run.summary.dtypes) | dict(run.checks.dtypes)
    text = lambda c: _plain(c, kinds.get(c, "string"))
    of_files = files.select(F.lit("files").alias("section"), "label", F.col("name").alias("value"), empty.alias("actual"), empty.alias("outcome"))
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), text(c).alias("value")) for c, label in SUMMARY_LABELS.items()])
    of_summary = run.summary.select(F.explode(pairs).alias("p")).select(
        F.lit("summary").alias("section"), "p.label", "p.value", empty.alias("actual"), empty.alias("outcome")
    )
    of_checks = run.checks.select(
        F.lit("checks").alias("section"),
        F.col("name").alias("label"),
        text("expected").alias("value"),
        text("actual").alias("actual"),
        F.when(F.col("ok"), F.lit(CHECK_OK)).otherwise(F.lit(CHECK_OFF)).alias("outcome"),
    )
    of_issues = run.issues.select(
        F.lit("issues").alias("section"),
        level_label(F.col("level")).alias("label"),
        F.col("title").alias("value"),
        text("note").alias("actual"),
        F.concat_ws(" / ", text("excel_row"), text("zone"), text("category")).alias("outcome"),
    )
    none = run.issues.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit("issues").alias("section"), empty.alias("label"), F.lit(NO_ISSUES).alias("value"), empty.alias("actual"), empty.alias("outcome")
    )
    return of_files.unionByName(of_summary).unionByName(of_checks).unionByName(of_issues).unionByName(none)


def norms_table(run: Reconciliation) -> DataFrame:
    """Norms as they were recognised."""
    return run.norms.select(
        "name",
        F.coalesce(basis_label(F.col("basis")), F.lit("")).alias("basis"),
        "mass",
        "volume",
        "raw_mass",
        "raw_volume",
        "file",
    )


def filled_form(run: Reconciliation) -> DataFrame:
    """Form rows as they are written: the given columns, then the filled ones.

    The column for units taken from the registry stays empty, and the norms come
    last, whether or not an earlier run had added them.
    """
    rows = written(run.results)
    return rows.select(
        "idx",
        "excel_row",
        "subject",
        "zone",
        "municipality",
        "category",
        "unit",
        "sources",
        "units",
        "mass",
        "volume",
        "density",
        F.lit(None).cast("double").alias("registry_units"),
        "norm_mass",
        "norm_volume",
    )
