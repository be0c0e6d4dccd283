"""Landed inputs derived from the supplied star schema and text tables.

Line items become registry extracts, parts become the form and the norms order.
Everything is a projection, join or aggregate of whole tables; header rows are
added per file.  Sides of joins are left to Catalyst, as they grow with the data.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.text import cell_text
from ledgerfold.operators.relational import kept_together

_COMMA = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(*texts) -> Column:
    return F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])


def order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation of every order, by number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")


def part_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category of every part, spelled the way extracts spell things."""
    size = F.col("p_size") % 4
    base = (
        F.when((F.col("p_type") == "PROMO") & (F.col("p_size") > 40), F.concat(F.lit("unlisted goods "), F.col("p_brand")))
        .when(F.col("p_brand") == "Brand#3", F.concat("p_name", F.lit("s")))
        .otherwise(F.col("p_name"))
    )
    category = (
        F.when(size == 0, F.upper("base"))
        .when(size == 1, F.replace("base", F.lit(" "), F.lit("  ")))
        .when(size == 2, F.concat("base", F.lit(".")))
        .otherwise(F.col("base"))
    )
    return table(spark, sf_dir, "part").withColumn("base", base).select("p_partkey", category.alias("category"))


def nation_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Municipality and zone of every nation."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    turn = F.col("n_nationkey") % 3
    zone = F.when(turn == 0, F.upper("r_name")).when(turn == 1, F.lower("r_name")).otherwise(F.concat(F.lit(" "), "r_name"))
    placed = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    return placed.select("n_nationkey", F.col("n_name").alias("municipality"), zone.alias("zone"))


def registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry row per line item, spelled the way extracts spell things.

    Numbers of lines meet their orders before any text is beside them, and what
    hangs on a part or a nation is spelled once for it, not for every line.
    """
    lines = table(spark, sf_dir, "lineitem")
    units = (
        F.when(F.col("l_returnflag") == "R", F.lit("0"))
        .when(F.col("l_tax") > 0.07, F.lit("n/a"))
        .when(F.col("l_discount") > 0.09, F.lit(""))
        .otherwise(_COMMA(F.col("l_quantity")))
    )
    slim = lines.select(
        "l_orderkey", "l_partkey", "l_linenumber", units.alias("units"), (F.col("l_suppkey") % 50 == 0).alias("zoneless")
    )
    facts = (
        slim.join(order_places(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part_categories(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
        .join(nation_zones(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return facts.select(
        F.concat(F.lit("extract_"), F.col("l_linenumber").cast("string"), F.lit(".xlsx")).alias("file"),
        "l_linenumber",
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") + 2).alias("row_idx"),
        "category",
        "units",
        F.when(F.col("zoneless"), F.lit("")).otherwise(F.col("zone")).alias("zone"),
        "municipality",
    )


# Extract 3 has no municipality and another column order, extract 7 no units.
_REGISTRY_HEADS = {
    "usual": ("Категория потребителя", "Количество расчетных единиц", "Зона деятельности", "Муниципальное образование"),
    "short": ("Зона деятельности", "Количество расчетных единиц", "Категория потребителя"),
    "unitless": ("Муниципальное образование", "Категория потребителя", "Зона деятельности"),
}


def _by_kind(usual: Column, short: Column, unitless: Column) -> Column:
    number = F.col("l_linenumber")
    return F.when(number == 3, short).when(number == 7, unitless).otherwise(usual)


def registry_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and header row of every extract."""
    files = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    heads = _by_kind(*[_cells(*_REGISTRY_HEADS[k]) for k in ("usual", "short", "unitless")])
    return files.select(
        F.concat(F.lit("extract_"), F.col("l_linenumber").cast("string"), F.lit(".xlsx")).alias("file"),
        F.lit(0).alias("table_idx"),
        F.lit("Реестр").alias("title"),
        F.posexplode(F.array(_cells("Выгрузка реестра"), heads)).alias("row_idx", "cells"),
    ).withColumn("row_idx", F.col("row_idx").cast("bigint"))


def registry_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_lines(spark, sf_dir).select(
        "file",
        F.lit(0).alias("table_idx"),
        F.lit("Реестр").alias("title"),
        "row_idx",
        _by_kind(
            F.array("category", "units", "zone", "municipality"),
            F.array("zone", "units", "category"),
            F.array("municipality", "category", "zone"),
        ).alias("cells"),
    )


def registry_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_heads(spark, sf_dir).unionByName(registry_body(spark, sf_dir))


FORM_HEADER = (
    "Субъект РФ",
    "Зона деятельности регионального оператора",
    "Муниципальное образование / ГО, входящее в зону",
    "Категория потребителя",
    "Единица измерения расчетных единиц",
    "Количество источников образования ТКО",
    "Количество расчетных единиц",
    "Расчетная масса, т",
    "Расчетный объем, м3",
    "Расчетный коэффициент плотности отходов, т/м³",
    "Количество расчетных единиц (Данные из реестра ИОО)",
)
FORM_META = (
    ("список",) * 5 + ("число",) * 6,
    ("обязательное поле",) * 10 + ("справочное поле, данные из него не загружаются",),
)


def template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form rows: the first part of each region and name, plus some repeats."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    regions = table(spark, sf_dir, "region")
    placed = parts.withColumn("r_regionkey", (F.col("p_partkey") % 5).cast("int")).filter(
        ~(F.col("p_name").startswith("hot") & (F.col("r_regionkey") == 4))
    )
    first = placed.groupBy("r_regionkey", "p_name").agg(F.min("p_partkey").alias("first_key"))
    kept = placed.join(first, ["r_regionkey", "p_name"]).filter(
        (F.col("p_partkey") == F.col("first_key")) | (F.col("p_partkey") % 97 == 0)
    )
    zone = F.when(F.col("r_regionkey") % 2 == 0, F.concat("r_name", F.lit(" zone"))).otherwise(F.col("r_name"))
    turn = F.col("p_partkey") % 3
    unit = F.when(turn == 0, F.lit("Квадратный метр")).when(turn == 1, F.lit("Человек")).otherwise(F.lit(""))
    return kept.join(regions, "r_regionkey").select(
        (F.col("p_partkey") + 3).alias("row_idx"), zone.alias("zone"), F.col("p_name").alias("category"), unit.alias("unit")
    )


def template_grid(spark: SparkSession, sf_dir: str, municipality: Column | None = None) -> DataFrame:
    lines = template_lines(spark, sf_dir)
    place = municipality if municipality is not None else F.lit("")
    body = lines.select(
        "row_idx",
        F.concat(F.array(F.lit("Country"), F.col("zone"), place, F.col("category"), F.col("unit")), F.array_repeat(F.lit(""), 6)).alias("cells"),
    )
    top = F.array(_cells(*FORM_HEADER), *[_cells(*row) for row in FORM_META])
    heads = (
        table(spark, sf_dir, "region")
        .agg(F.count("*").alias("n"))
        .select(F.posexplode(top).alias("row_idx", "cells"))
        .withColumn("row_idx", F.col("row_idx").cast("bigint"))
    )
    return heads.unionByName(body).select(
        F.lit("form.xlsx").alias("file"), F.lit(0).alias("table_idx"), F.lit("Общие сведения").alias("title"), "row_idx", "cells"
    )


PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
_NAME, _NORM = "Наименование категории", "Норматив накопления"
_NORM_HEADS = (
    ((_NAME, _NORM, _NORM), (_NAME, "куб.м в год", "кг в год"), ("1", "2", "3")),
    ((_NAME, _NORM, _NORM), (_NAME, "куб.м в год", "т в год"), ("1", "2", "3")),
    ((_NAME, "Расчетная единица", _NORM, _NORM), (_NAME, "Расчетная единица", "куб.м в год", "кг в год"), ("1", "2", "3", "4")),
    ((_NAME, "показатели", "показатели"), (_NAME, "по первому", "по второму"), ("1", "2", "3")),
    ((_NAME, "объем", "масса"), (_NAME, "объем", "масса"), ("1", "2", "3")),
    (("№ п/п", _NAME, "масса, кг в год", "показатель"), ("№ п/п", _NAME, "масса, кг в год", "показатель"), ("1", "2", "3", "4")),
)


def part_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .groupBy("p_type", "p_name")
        .agg(
            F.min("p_retailprice").alias("mass"),
            F.min("p_size").alias("volume"),
            F.min("p_partkey").alias("first_key"),
        )
        .withColumn("table_idx", (F.array_position(F.array(*[F.lit(t) for t in PART_TYPES]), F.col("p_type")) - 1).cast("int"))
    )


def norm_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of six tables that differ in layout, one per type of part."""
    lines = part_norms(spark, sf_dir)
    mass, volume = _COMMA(F.col("mass")), _COMMA(F.col("volume").cast("double"))
    unit = F.when(F.col("first_key") % 2 == 0, F.lit("на 1 человека")).otherwise(F.lit("на 1 кв. метр"))
    number = F.concat((F.col("first_key") % 90 + 1).cast("string"), F.lit(".1"))
    kind = F.col("table_idx")
    cells = (
        F.when(kind == 2, F.array("p_name", unit, volume, mass))
        .when(
            kind == 3,
            F.array("p_name", F.concat(volume, F.lit(" м3/1 человека в год")), F.concat(mass, F.lit(" кг/1 человека в год"))),
        )
        .when(kind == 5, F.array(number, F.col("p_name"), mass, volume))
        .otherwise(F.array("p_name", volume, mass))
    )
    body = lines.select("table_idx", (F.col("first_key") + 10).alias("row_idx"), cells.alias("cells"))
    tiers = F.coalesce(*[F.when(kind == k, F.array(*[_cells(*t) for t in head])) for k, head in enumerate(_NORM_HEADS)])
    heads = (
        lines.select("table_idx")
        .distinct()
        .select("table_idx", F.posexplode(tiers).alias("row_idx", "cells"))
        .withColumn("row_idx", F.col("row_idx").cast("bigint"))
    )
    grids = heads.unionByName(body)
    return grids.select(
        F.lit("order.docx").alias("file"),
        "table_idx",
        F.concat(F.lit("Приложение "), F.col("table_idx").cast("string")).alias("title"),
        "row_idx",
        "cells",
    )


def norm_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored norm rules for some part names: every mode, and formulas of every kind."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    name = F.col("p_name")
    tail = F.substring_index(name, " ", -1)
    mode = (
        F.when(name.startswith("red"), "manual")
        .when(name.startswith("blue") | name.startswith("small"), "formula")
        .when(name.startswith("old"), "none")
        .when(name.startswith("cold"), "single")
    )
    expression = (
        F.when(name.startswith("blue"), F.concat(F.lit("0,5*[@"), F.upper("p_name"), F.lit("] + (2 - 1)")))
        .when(name == "small bolt", F.concat(F.lit("[@"), "p_name", F.lit("] / 0")))
        .when(name == "small gear", F.lit("[nowhere] + 1"))
        .when(name.startswith("small"), F.concat(F.lit("-[@"), "p_name", F.lit("]*2 +")))
    )
    return names.filter(mode.isNotNull()).select(
        name.alias("key"),
        mode.alias("mode"),
        F.when(name.startswith("cold"), F.concat(F.lit("hot "), tail)).alias("entry_name"),
        expression.alias("expression"),
        F.when(name.startswith("red"), F.length("p_name").cast("double")).alias("manual_mass"),
        F.lit(None).cast("double").alias("manual_volume"),
    )


def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plural registry names are taken out; unlisted goods of one brand go to rings."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    plural = names.select(F.concat("p_name", F.lit("s")).alias("key"), F.lit("").alias("template_key"))
    brands = table(spark, sf_dir, "part").filter("p_brand = 'Brand#12'").select("p_brand").distinct()
    listed = brands.select(F.lit("unlisted goods brand 12").alias("key"), F.lit("blue ring").alias("template_key"))
    return plural.unionByName(listed)


def zone_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").filter("r_name = 'ASIA'")
    return regions.select(F.lower("r_name").alias("key"), F.lit("america").alias("template_key"))


def _words(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """All words of all documents with their page of ``size`` words and position; those of a page stay together.

    Texts are dealt out by page: so what is told of a page later meets its words
    where they lie, and a long document is not one task's work.
    """
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.split(cell_text(F.col("text")), " ").alias("words"))
    last = F.ceil(F.size("words") / size).cast("int") - 1
    pieces = F.transform(F.sequence(F.lit(0), last), lambda p: F.array_join(F.slice("words", p * size + 1, F.lit(size)), " "))
    pages = kept_together(words.select("doc", F.posexplode(pieces).alias("page", "text")), "doc", "page")
    placed = pages.select("doc", "page", F.posexplode(F.split("text", " ")).alias("within", "text"))
    # Empty texts go here, as one empty word: a filter on texts would clean them all a second time.
    at = F.col("page").cast("bigint") * size + F.col("within")
    return placed.select("doc", "page", at.alias("at"), "within", "text").filter(F.col("text") != "")


def cell_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set as tables of four columns, two lines to a cell, thirty rows to a page.

    Every tenth row has its first cell only, as a caption would.
    """
    within = F.col("within")
    placed = _words(spark, sf_dir, 240).withColumns(
        {
            "row": F.floor(within / 8),
            "cell": F.floor(within % 8 / 2),
            "line": within % 2,
        }
    )
    kept = placed.filter((F.col("row") % 10 != 0) | (F.col("cell") == 0))
    return kept.select(
        "doc",
        "page",
        F.col("at").cast("bigint").alias("seq"),
        "text",
        (F.col("cell") * 100.0 + 50).alias("x"),
        (F.col("row") * 40.0 + F.col("line") * 11.2 + 40).alias("y"),
        F.lit(50.0).alias("width"),
        F.lit(9.0).alias("height"),
    )


def scan_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scans: a word per cell, four columns, odd documents lying askew."""
    within = F.col("within")
    placed = _words(spark, sf_dir, 200).withColumns(
        {
            "row": F.floor(within / 4),
            "x": within % 4 * 100.0 + 100,
        }
    )
    tilt = F.when(F.col("doc") % 2 == 1, 0.02).otherwise(0.0)
    return placed.select(
        "doc",
        "page",
        F.col("at").cast("bigint").alias("seq"),
        "text",
        "x",
        (F.col("row") * 16.0 + 60 + tilt * F.col("x")).alias("y"),
        F.least(F.length("text") * 5.2, F.lit(60.0)).alias("width"),
        F.lit(10.0).alias("height"),
    )
