"""User rules as portable JSON: by names, so that they outlive a new norms order.

A rule file also stores the layouts that were chosen for the norms order and for
the registry, so that the next files of the same kind are read the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NORM = "struct<mode:string,entryName:string,expression:string,manualMass:double,manualVolume:double>"
_TABLE = (
    "struct<headerRowCount:int,nameColumn:int,unitColumn:int,massColumn:int,volumeColumn:int,"
    "massFactor:double,volumeFactor:double,basis:string>"
)
_NORMS_LAYOUT = f"struct<tables:array<struct<tableIndex:int,layout:{_TABLE}>>,source:string>"
_MARKUP = (
    "struct<sheet:int,headerRow:int,"
    "columns:struct<category:int,units:int,zone:int,municipality:int,unitName:int>,source:string>"
)
_BODY = (
    f"norms:map<string,{_NORM}>,registry:map<string,string>,zones:map<string,string>,"
    f"normsLayout:{_NORMS_LAYOUT},registryMarkup:{_MARKUP}"
)
SCHEMA = f"struct<version:int,rules:struct<{_BODY}>,{_BODY}>"
VERSION = 1


def parse_rules(documents: DataFrame) -> dict[str, DataFrame]:
    """Rule tables from ``documents(text)``; the rules may stand bare or under 'rules'.

    ``norms``, ``registry`` and ``zones`` are the rules, ``norms_layout`` and
    ``registry_markup`` the stored layouts: one row per table of the order, in
    its order of reading, and one row at most for the registry.  A layout belongs
    to one document; of several, the one of the greatest text counts.
    """
    parts = ("norms", "registry", "zones", "normsLayout", "registryMarkup")
    body = documents.select("text", F.from_json("text", SCHEMA).alias("d")).select(
        "text", *[F.coalesce(f"d.rules.{part}", f"d.{part}").alias(part) for part in parts]
    )
    norm = body.select(F.explode("norms").alias("key", "r")).select(
        "key",
        F.col("r.mode").alias("mode"),
        F.col("r.entryName").alias("entry_name"),
        F.coalesce("r.expression", F.lit("")).alias("expression"),
        F.col("r.manualMass").alias("manual_mass"),
        F.col("r.manualVolume").alias("manual_volume"),
    )

    def targets(part: str) -> DataFrame:
        return body.select(F.explode(part).alias("key", "template_key"))

    return {
        "norms": norm,
        "registry": targets("registry"),
        "zones": targets("zones"),
        "norms_layout": _stored_tables(_last(body, "normsLayout")),
        "registry_markup": _stored_markup(_last(body, "registryMarkup")),
    }


def _last(body: DataFrame, part: str) -> DataFrame:
    """The stored layout, if there is one."""
    return body.filter(F.col(part).isNotNull()).agg(F.max_by(part, "text").alias("l")).filter("l IS NOT NULL")


def _stored_tables(layout: DataFrame) -> DataFrame:
    told = layout.select("l.source", F.posexplode("l.tables").alias("list_pos", "t"))
    absent = F.lit(-1)
    return told.select(
        F.col("t.tableIndex").alias("table_idx"),
        "list_pos",
        F.coalesce("t.layout.headerRowCount", absent).alias("header_row_count"),
        *[F.coalesce(f"t.layout.{c}Column", absent).alias(f"{c}_column") for c in ("name", "unit", "mass", "volume")],
        F.col("t.layout.massFactor").alias("mass_factor"),
        F.col("t.layout.volumeFactor").alias("volume_factor"),
        F.col("t.layout.basis").alias("basis"),
        "source",
    )


def _stored_markup(markup: DataFrame) -> DataFrame:
    """Columns are null where the registry has none; without a category there is no markup."""
    named = {"category": "category", "units": "units", "zone": "zone", "municipality": "municipality", "unit_name": "unitName"}
    columns = [F.when(F.col(f"l.columns.{c}") >= 0, F.col(f"l.columns.{c}")).alias(name) for name, c in named.items()]
    return markup.filter("l.columns IS NOT NULL").select(
        F.col("l.sheet").alias("table_idx"), F.col("l.headerRow").alias("header_row"), *columns, "l.source"
    )


def bind_norms_layout(stored: DataFrame, orders: DataFrame) -> DataFrame:
    """The stored layout for each file of ``orders(file)``: one row per table it names.

    A layout is one document, so its tables travel as one value; tables that a
    file lacks stay in, for ``norms.layout_errors`` to tell.
    """
    tables = stored.agg(F.collect_list(F.struct(*stored.columns)).alias("t")).scalar()
    return orders.select("file").distinct().select("file", F.explode(tables).alias("t")).select("file", "t.*")


def read_rules(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Rules from a JSON file (or a folder of them)."""
    return parse_rules(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def rule_lines(
    norms: DataFrame,
    registry: DataFrame,
    zones: DataFrame,
    norms_layout: DataFrame | None = None,
    registry_markup: DataFrame | None = None,
) -> DataFrame:
    """Rules as JSON documents, one per rule, each readable by ``parse_rules``.

    One document per rule keeps the writing distributed however many rules there
    are; a reader takes them together.  A stored layout is one document whole.
    """
    entry = F.struct(
        "mode",
        F.col("entry_name").alias("entryName"),
        "expression",
        F.col("manual_mass").alias("manualMass"),
        F.col("manual_volume").alias("manualVolume"),
    )

    def document(frame: DataFrame, part: str, value) -> DataFrame:
        rules = F.struct(F.create_map("key", value).alias(part))
        return frame.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), rules.alias("rules"))).alias("text"))

    target = F.coalesce("template_key", F.lit(""))
    lines = (
        document(norms, "norms", entry)
        .unionByName(document(registry, "registry", target))
        .unionByName(document(zones, "zones", target))
    )
    for stored, value in ((norms_layout, _norms_layout_value), (registry_markup, _markup_value)):
        if stored is not None:
            kept = value(stored).filter("stored IS NOT NULL")
            told = F.struct(F.lit(VERSION).alias("version"), F.col("stored").alias("rules"))
            lines = lines.unionByName(kept.select(F.to_json(told).alias("text")))
    return lines


def _norms_layout_value(tables: DataFrame) -> DataFrame:
    layout = F.struct(
        F.col("header_row_count").alias("headerRowCount"),
        *[F.col(f"{c}_column").alias(f"{c}Column") for c in ("name", "unit", "mass", "volume")],
        F.col("mass_factor").alias("massFactor"),
        F.col("volume_factor").alias("volumeFactor"),
        "basis",
    )
    row = F.struct("list_pos", F.col("table_idx").alias("tableIndex"), layout.alias("layout"))
    whole = tables.agg(F.sort_array(F.collect_list(row)).alias("rows"), F.max("source").alias("source"))
    plain = F.transform("rows", lambda t: F.struct(t["tableIndex"].alias("tableIndex"), t["layout"].alias("layout")))
    kept = F.when(F.size("rows") > 0, F.struct(F.struct(plain.alias("tables"), "source").alias("normsLayout")))
    return whole.select(kept.alias("stored"))


def _markup_value(markup: DataFrame) -> DataFrame:
    columns = F.struct("category", "units", "zone", "municipality", F.col("unit_name").alias("unitName"))
    whole = F.struct(F.col("table_idx").alias("sheet"), F.col("header_row").alias("headerRow"), columns.alias("columns"), "source")
    return markup.select(F.struct(whole.alias("registryMarkup")).alias("stored"))


def write_rules(
    norms: DataFrame,
    registry: DataFrame,
    zones: DataFrame,
    path: str,
    norms_layout: DataFrame | None = None,
    registry_markup: DataFrame | None = None,
) -> None:
    rule_lines(norms, registry, zones, norms_layout, registry_markup).write.mode("overwrite").text(path)


def read_rule_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_rules(spark.read.text(path).withColumnRenamed("value", "text"))
