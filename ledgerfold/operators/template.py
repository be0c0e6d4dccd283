"""The form to fill: its header, its rows, and the categories it asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.text import cell_text, normalize
from ledgerfold.functions.units import unit_basis
from ledgerfold.operators.grid import TABLE
from ledgerfold.operators.relational import join_lookup, running_position

# --- fixed values: wording of the metadata rows -------------------------------
META_WORDS = (
    "список", "число", "текст", "дата", "да нет", "логическое",
    "обязательное поле", "необязательное поле", "опциональное поле",
)
META_BEGINNINGS = "^заполняется|^справочное|^формат"
HEADER_DEPTH = 20
SHEET_TITLE = "(?iu)общие сведени"

# --- fixed values: roles of the form's columns, the first that fits wins ------
ROLE_PATTERNS = (
    ("subject", "субъект", None),
    ("zone", "зона", None),
    ("municipality", "муниципальн", None),
    ("category", "категори[а-я]* потребител|^категори", None),
    ("unit", "единиц[а-я]*\\s+измерен", None),
    ("sources", "количеств[а-я]*\\s+источник", None),
    ("registry_units", "^(?=.*количеств[а-я]*\\s+расчетн)(?=.*реестр)", None),
    ("units", "количеств[а-я]*\\s+расчетн", "реестр"),
    ("mass", "расчетн[а-я]*\\s+масс", None),
    ("volume", "расчетн[а-я]*\\s+объем", None),
    ("density", "плотност", None),
    ("norm_mass", "^(?=.*норматив)(?=.*масс)", None),
    ("norm_volume", "^(?=.*норматив)(?=.*объем)", None),
)
ROLES = [role for role, _, _ in ROLE_PATTERNS]


def is_meta_row(cells: Column) -> Column:
    keys = F.transform(cells, normalize)
    return F.size(F.filter(keys, lambda k: k.isin(*META_WORDS) | k.rlike(META_BEGINNINGS))) >= 2


def _fits(text: Column, wanted: str, unwanted: str | None) -> Column:
    fits = text.rlike(wanted)
    return fits & ~text.rlike(unwanted) if unwanted else fits


def assign_roles(headers: Column) -> Column:
    """Column number (from one, null if absent) of every role, as a struct.

    A header cell takes the first role that fits it and is still free.
    """
    keys = F.transform(headers, normalize)
    fitting = F.transform(
        keys,
        lambda k, i: F.struct(
            (i + 1).alias("at"),
            F.array(*[(k != "") & _fits(k, wanted, unwanted) for _, wanted, unwanted in ROLE_PATTERNS]).alias("fits"),
        ),
    )
    free = F.array(*[F.lit(0) for _ in ROLES])

    def take(state, header):
        open_fits = F.zip_with(state, header["fits"], lambda taken, fits: (taken == 0) & fits)
        role = F.array_position(open_fits, True)
        return F.transform(state, lambda taken, k: F.when(k + 1 == role, header["at"]).otherwise(taken))

    state = F.aggregate(fitting, free, take)
    return F.struct(*[F.nullif(F.get(state, k), F.lit(0)).alias(role) for k, role in enumerate(ROLES)])


def template_layout(grids: DataFrame) -> DataFrame:
    """Header row and column roles of the form; a sheet titled for it goes first."""
    texts = F.transform("cells", cell_text)
    heads = (
        grids.filter(F.col("row_idx") < HEADER_DEPTH)
        .select(*TABLE, "title", "row_idx", texts.alias("texts"))
        .filter(
            F.exists("texts", lambda t: t.rlike("(?iu)категори")) & F.exists("texts", lambda t: t.rlike("(?iu)единиц"))
        )
    )
    per_sheet = heads.groupBy(*TABLE, "title").agg(F.min(F.struct("row_idx", "texts")).alias("h"))
    rank = F.struct(F.when(F.col("title").rlike(SHEET_TITLE), 0).otherwise(1).alias("named"), "table_idx", "h")
    chosen = per_sheet.groupBy("file").agg(F.min(rank).alias("b"))
    roles = assign_roles(F.col("b.h.texts"))
    last_header = F.array_max(F.transform(F.col("b.h.texts"), lambda t, i: F.when(t != "", i + 1).otherwise(0)))
    return (
        chosen.select(
            "file",
            F.col("b.table_idx").alias("table_idx"),
            F.col("b.h.row_idx").cast("bigint").alias("header_row"),
            last_header.alias("last_header_column"),
            roles.alias("r"),
        )
        .filter(F.col("r.category").isNotNull() & F.col("r.zone").isNotNull())
        .select("file", "table_idx", "header_row", "last_header_column", "r.*")
    )


def template_rows(grids: DataFrame, layout: DataFrame) -> DataFrame:
    """Data rows of the form, numbered in order; metadata and blank rows left out."""

    def at(role: str) -> Column:
        return F.coalesce(F.get(F.col("texts"), F.col(f"l_{role}") - 1), F.lit(""))

    named = layout.select(*TABLE, "header_row", *[F.col(r).alias(f"l_{r}") for r in ROLES])
    body = join_lookup(grids, named, TABLE).filter(F.col("row_idx") > F.col("header_row"))
    body = body.filter(~is_meta_row(F.col("cells"))).withColumn("texts", F.transform("cells", cell_text))
    rows = body.select(
        "file",
        (F.col("row_idx") + 1).alias("excel_row"),
        *[at(r).alias(r) for r in ("subject", "zone", "municipality", "category", "unit")],
    ).filter(F.col("category") != "")
    return running_position(rows, ["file"], "excel_row", "idx")


def template_categories(rows: DataFrame) -> DataFrame:
    """Distinct categories of the form with their unit, rows and zones counted."""
    keyed = rows.withColumn("category_key", normalize(F.col("category")))
    unit = F.coalesce(
        F.min_by("unit", "idx"),
        F.lit(""),
    )
    given = F.expr("min_by(unit, idx) FILTER (WHERE unit <> '')")
    return (
        keyed.groupBy("category_key")
        .agg(
            F.min(F.struct("idx", "category")).alias("f"),
            F.coalesce(given, unit).alias("unit"),
            F.count("*").alias("n_rows"),
            F.count_distinct("zone").alias("n_zones"),
        )
        .select(
            "category_key",
            F.col("f.category").alias("name"),
            "unit",
            unit_basis(F.col("unit")).alias("basis"),
            F.col("f.idx").alias("first_idx"),
            "n_rows",
            "n_zones",
        )
    )


def template_zones(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("zone_key", normalize(F.col("zone")))
        .groupBy("zone_key")
        .agg(F.min(F.struct("idx", "zone")).alias("f"))
        .select("zone_key", F.col("f.zone").alias("name"), F.col("f.idx").alias("first_idx"))
    )


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Rows with their comparison key and a mark on repeats of a key.

    The municipality takes part only if some row of the form names one; repeats
    are told by a hash aggregate of the first row per key, not by a window.
    """
    uses = rows.select(F.coalesce(F.max(F.col("municipality") != ""), F.lit(False)).alias("u")).scalar()
    keyed = rows.withColumns(
        {
            "zone_key": normalize(F.col("zone")),
            "municipality_key": F.when(uses, normalize(F.col("municipality"))).otherwise(F.lit("")),
            "category_key": normalize(F.col("category")),
        }
    )
    keys = ["zone_key", "municipality_key", "category_key"]
    first = keyed.groupBy(*keys).agg(F.min("idx").alias("first_idx"))
    return keyed.join(first, keys).withColumn("duplicate", F.col("idx") > F.col("first_idx")).drop("first_idx")
