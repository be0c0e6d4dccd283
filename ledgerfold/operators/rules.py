"""User rules laid over the suggested mappings, and their portable form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.text import normalize
from ledgerfold.operators.formula import NAMED_REFERENCE, portable, replace_references


def status_for_mode(mode: Column, entry_id: Column) -> Column:
    return (
        F.when(mode == "formula", F.lit("formula"))
        .when(mode == "manual", F.lit("manual"))
        .when(mode == "none", F.lit("ignored"))
        .when(entry_id.isNotNull(), F.lit("manual"))
        .otherwise(F.lit("none"))
    )


def latest(edits: DataFrame, key: str = "key", order: str = "edit") -> DataFrame:
    """Rules in force after a log of edits: the last one per key, unless it is a reset."""
    fields = [c for c in edits.columns if c != key]
    last = edits.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("e"))
    return last.select(key, "e.*").filter(~F.col("reset")).drop("reset", order)


def norm_ids_by_name(norms: DataFrame) -> DataFrame:
    """Norm id per normalised name; of equal names the last one counts."""
    return norms.groupBy(normalize(F.col("name")).alias("name_key")).agg(F.max_by("id", "pos").alias("id"))


def bind_norm_rules(rules: DataFrame, norms: DataFrame) -> DataFrame:
    """Turn names in stored norm rules into the ids of the norms at hand."""
    by_name = norm_ids_by_name(norms)
    entry = by_name.select(F.col("name_key").alias("entry_key"), F.col("id").alias("entry_id"))
    bound = rules.withColumn("entry_key", F.when(F.coalesce("entry_name", F.lit("")) != "", normalize(F.col("entry_name"))))
    bound = bound.join(entry, "entry_key", "left").drop("entry_key")
    bound = bound.withColumn("expression", F.coalesce("expression", F.lit("")))
    table = by_name.select(F.col("name_key").alias("ref"), F.col("id").alias("replacement"))
    return replace_references(bound, table, NAMED_REFERENCE, normalize(F.col("inner")), "[", "]")


def overlay_norms(mapping: DataFrame, rules: DataFrame, norms: DataFrame) -> DataFrame:
    """Stored norm rules take the place of the suggestion for their category."""
    bound = bind_norm_rules(rules, norms).select(
        "key", *[F.col(c).alias(f"r_{c}") for c in ("mode", "entry_id", "expression", "manual_mass", "manual_volume")],
        F.lit(True).alias("ruled"),
    )
    ruled = F.coalesce("ruled", F.lit(False))
    joined = mapping.join(bound, "key", "left")

    def pick(column: str) -> Column:
        return F.when(ruled, F.col(f"r_{column}")).otherwise(F.col(column)).alias(column)

    status = status_for_mode(F.col("r_mode"), F.col("r_entry_id"))
    return joined.select(
        "key",
        pick("mode"),
        pick("entry_id"),
        "score",
        F.when(ruled, status).otherwise(F.col("status")).alias("status"),
        (F.col("auto") & ~ruled).alias("auto"),
        pick("expression"),
        pick("manual_mass"),
        pick("manual_volume"),
    )


def overlay_targets(mapping: DataFrame, rules: DataFrame) -> DataFrame:
    """Stored category or zone rules; an empty target takes the name out of the form."""
    ruled = F.coalesce("ruled", F.lit(False))
    chosen = rules.select(
        "key", F.nullif("template_key", F.lit("")).alias("r_target"), F.lit(True).alias("ruled")
    )
    return mapping.join(chosen, "key", "left").select(
        "key",
        F.when(ruled, F.col("r_target")).otherwise(F.col("template_key")).alias("template_key"),
        "score",
        F.when(ruled, F.when(F.col("r_target").isNotNull(), F.lit("manual")).otherwise(F.lit("ignored")))
        .otherwise(F.col("status"))
        .alias("status"),
        (F.col("auto") & ~ruled).alias("auto"),
    )


def portable_norm_rules(mapping: DataFrame, norms: DataFrame) -> DataFrame:
    """Rules set by hand in the form they are stored: by names, not by ids."""
    by_hand = mapping.filter(~F.col("auto")).join(
        norms.select(F.col("id").alias("entry_id"), F.col("name").alias("entry_name")), "entry_id", "left"
    )
    named = portable(by_hand.select("key", "mode", "entry_name", "expression", "manual_mass", "manual_volume"), norms)
    return named.select("key", "mode", "entry_name", "expression", "manual_mass", "manual_volume")


# --- review of mappings --------------------------------------------------------
# fixed values: statuses that ask for attention
ATTENTION = ("weak", "none")


def review_norms(mapping: DataFrame, show: str = "all", search: str = "") -> DataFrame:
    """Mappings (with ``name``) that a review filter shows."""
    by = {
        "all": F.lit(True),
        "attention": F.col("status").isin(*ATTENTION) | (F.col("mode") == "none"),
        "none": (F.col("mode") == "none") | (F.col("entry_id").isNull() & (F.col("mode") == "single")),
        "manual": ~F.col("auto"),
    }
    return mapping.filter(by[show] & F.contains(F.lower("name"), F.lit(search.strip().lower())))


def review_registry(mapping: DataFrame, show: str = "all", search: str = "") -> DataFrame:
    by = {
        "all": F.lit(True),
        "attention": ~(F.col("status").isin("exact", "auto") & F.col("auto")),
        "none": F.col("template_key").isNull(),
        "manual": ~F.col("auto"),
    }
    return mapping.filter(by[show] & F.contains(F.lower("name"), F.lit(search.strip().lower())))
