"""From registry groups to form rows: targets, measures, and what did not land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.text import round_half_up
from ledgerfold.operators.formula import evaluate_rules
from ledgerfold.operators.relational import join_lookup
from ledgerfold.operators.template import keyed_rows

KEYS = ["zone_key", "municipality_key", "category_key"]
ASSIGNED = ("target_zone", "target_municipality", "target_category", "reason")

# --- fixed values: kilograms in a tonne, and why a group did not land ----------
KG_PER_TONNE = 1000
NO_ZONE = "зона не сопоставлена"
NO_CATEGORY = "категория не сопоставлена"
NO_MUNICIPALITY = "в реестре не указано муниципальное образование"
NO_ROW = "нет такой строки в шаблоне"


def resolve_norms(mapping: DataFrame, norms: DataFrame) -> DataFrame:
    """Norm of every form category by the mode of its mapping."""
    entries = norms.select(F.col("id").alias("entry_id"), F.col("mass").alias("e_mass"), F.col("volume").alias("e_volume"))
    formulas = evaluate_rules(mapping.filter("mode = 'formula'").select("key", "expression"), norms)
    mode = F.col("mode")
    finite = lambda c: F.when(F.abs(c) < F.lit(float("inf")), F.col(c))

    def by_mode(single: str, formula: str, manual: str) -> Column:
        return (
            F.when(mode == "formula", F.col(formula))
            .when(mode == "manual", finite(manual))
            .when(mode == "single", F.col(single))
        )

    return (
        mapping.join(entries, "entry_id", "left")
        .join(formulas, "key", "left")
        .select(
            "key",
            "mode",
            by_mode("e_mass", "formula_mass", "manual_mass").alias("norm_mass"),
            by_mode("e_volume", "formula_volume", "manual_volume").alias("norm_volume"),
            F.when(mode == "formula", F.col("formula_error")).alias("norm_error"),
        )
    )


def assign_targets(groups: DataFrame, zone_map: DataFrame, category_map: DataFrame, template: DataFrame) -> DataFrame:
    """Every registry group with the form key it goes to, or the reason it does not."""
    uses = template.select(F.coalesce(F.max(F.col("municipality") != ""), F.lit(False)).alias("u")).scalar()
    zones = zone_map.select(F.col("key").alias("zone_key"), F.col("template_key").alias("target_zone"))
    categories = category_map.select(F.col("key").alias("category_key"), F.col("template_key").alias("target_category"))
    placed = join_lookup(groups, zones, ["zone_key"], "left")
    placed = join_lookup(placed, categories, ["category_key"], "left")
    no_zone = F.coalesce("target_zone", F.lit("")) == ""
    no_category = F.coalesce("target_category", F.lit("")) == ""
    return placed.select(
        *groups.columns,
        "target_zone",
        F.when(uses, F.col("municipality_key")).otherwise(F.lit("")).alias("target_municipality"),
        "target_category",
        F.when(no_zone, F.lit(NO_ZONE))
        .when(no_category, F.lit(NO_CATEGORY))
        .when(uses & (F.col("municipality_key") == ""), F.lit(NO_MUNICIPALITY))
        .alias("reason"),
    )


def parts(assigned: DataFrame) -> DataFrame:
    """Registry groups that make up each form key: its lineage, as a relation."""
    return assigned.filter("reason IS NULL").select(
        F.col("target_zone").alias("zone_key"),
        F.col("target_municipality").alias("municipality_key"),
        F.col("target_category").alias("category_key"),
        *[c for c in assigned.columns if c not in KEYS and not c.startswith("target_") and c != "reason"],
    )


def targets(made_of: DataFrame) -> DataFrame:
    return made_of.groupBy(*KEYS).agg(
        F.sum("sources").alias("sources"),
        F.sum("units").alias("units"),
        F.bool_and("units_known").alias("units_known"),
        F.sum("n_rows").alias("registry_rows"),
        F.sum("zero_sources").alias("zero_sources"),
        F.count("*").alias("n_parts"),
    )


def results(template: DataFrame, totals: DataFrame, norms_of: DataFrame) -> DataFrame:
    """Form rows with their registry totals, norms and derived measures.

    Only the first row of a repeated key takes the totals; repeats get zeros
    without passing through the join, and keep their norm.
    """
    return results_of(keyed_rows(template), totals, norms_of)


def results_of(keyed: DataFrame, totals: DataFrame, norms_of: DataFrame) -> DataFrame:
    """The same for rows that have their key and the mark of repeats already."""
    zero = {
        "sources": F.lit(0).cast("bigint"),
        "units": F.lit(0.0),
        "units_known": F.lit(True),
        "registry_rows": F.lit(0).cast("bigint"),
        "zero_sources": F.lit(0).cast("bigint"),
        "n_parts": F.lit(0).cast("bigint"),
    }
    first = keyed.filter(~F.col("duplicate")).join(totals, KEYS, "left")
    first = first.withColumns({c: F.coalesce(c, zero[c]) for c in zero})
    rows = first.unionByName(keyed.filter("duplicate").withColumns(zero))
    norms = norms_of.select(
        F.col("key").alias("category_key"), "mode", "norm_mass", "norm_volume", "norm_error"
    )
    rows = join_lookup(rows, norms, ["category_key"], "left")
    mass = F.col("norm_mass") * F.col("units") / KG_PER_TONNE
    rows = rows.withColumns(
        {
            "norm_mode": F.coalesce("mode", F.lit("none")),
            "mass": mass,
            "volume": F.col("norm_volume") * F.col("units"),
        }
    ).drop("mode")
    return rows.withColumn("density", F.try_divide("mass", "volume"))


def unassigned(assigned: DataFrame, made_of: DataFrame, totals: DataFrame, template: DataFrame) -> DataFrame:
    """Registry data that reached no form row, merged per zone, category and reason.

    A group kept out by its mapping reports zero units when they are unknown; a
    group whose key the form lacks reports its own units and the rows of the
    whole key.
    """
    uses = template.select(F.coalesce(F.max(F.col("municipality") != ""), F.lit(False)).alias("u")).scalar()
    unmapped = assigned.filter("reason IS NOT NULL").select(
        "zone",
        "municipality",
        "category",
        "sources",
        F.when(F.col("units_known"), F.col("units")).otherwise(0.0).alias("units"),
        "n_rows",
        "reason",
    )
    lacking = totals.join(keyed_rows(template).select(*KEYS).distinct(), KEYS, "left_anti")
    rowless = made_of.join(lacking.select(*KEYS, "registry_rows"), KEYS).select(
        "zone", "municipality", "category", "sources", "units", F.col("registry_rows").alias("n_rows"),
        F.lit(NO_ROW).alias("reason"),
    )
    items = unmapped.unionByName(rowless).withColumn("shown", F.when(uses, F.col("municipality")).otherwise(F.lit("")))
    return (
        items.groupBy("zone", "shown", "category", "reason")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("units").alias("units"),
            F.sum("sources").alias("sources"),
            F.count("*").alias("n_groups"),
            F.count_distinct(F.when(F.col("municipality") != "", F.col("municipality"))).alias("n_municipalities"),
        )
        .withColumn("municipality", F.when(uses, F.col("shown")))
        .drop("shown")
    )


def by_weight(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc("units"), F.desc("n_rows"))


def with_data(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("units") > 0) | (F.col("sources") > 0))


def written(rows: DataFrame) -> DataFrame:
    """Values as they are written: rounded, and zero where nothing is known."""

    def shown(column: str, digits: int) -> Column:
        return F.coalesce(round_half_up(F.col(column), digits), F.lit(0.0)).alias(column)

    return rows.select(
        *[c for c in rows.columns if c not in ("units", "mass", "volume", "density", "norm_mass", "norm_volume")],
        shown("units", 0),
        shown("mass", 2),
        shown("volume", 2),
        shown("density", 2),
        round_half_up(F.col("norm_mass"), 6).alias("norm_mass"),
        round_half_up(F.col("norm_volume"), 6).alias("norm_volume"),
    )
