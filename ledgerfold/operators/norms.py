"""Norm tables: finding out which column is what, and reading the entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.text import cell_text, let, normalize, strip
from ledgerfold.functions.units import (
    is_mass_header,
    is_measure,
    is_volume_header,
    mass_factor,
    parse_measure,
    unit_basis,
    volume_factor,
)
from ledgerfold.operators.grid import (
    TABLE,
    WORDY,
    header_texts,
    is_numbering,
    is_remark,
    is_service,
    is_significant,
    is_spanning,
    significant_rows,
)
from ledgerfold.operators.relational import join_lookup, running_position, spread
from ledgerfold.session import cut

# --- fixed values: how columns of a norms table are recognised ----------------
NUMBERING_HEADER = r"(?iu)^\s*(n|№)\s*(п/п)?\s*$"
NAME_HEADER = "(?iu)наименование|категор"
UNIT_HEADER = "расчетн[а-я]*\\s+единиц|единиц[а-я]*\\s+измерени"
MASS_WORD, VOLUME_WORD = "(?iu)масс", "(?iu)объем|объём"
ORDINAL = r"^\d{1,3}(\.\d{1,3})*\.?$"
ORDINAL_SHARE = 0.7

COLUMNS = ["name_column", "unit_column", "mass_column", "volume_column"]


def first_data_rows(rows: DataFrame) -> DataFrame:
    """First row, below the first of the table, that holds both a measure and a name.

    Written out, as all that follows looks it up.  One aggregate finds it in all
    tables but those whose very first row is data; these are read once more.
    """
    cells = F.col("cells")
    measured = F.exists(cells, is_measure)
    named = F.exists(cells, lambda c: strip(c).rlike(WORDY) & ~is_remark(strip(c)))
    flagged = rows.withColumn("data", ~is_spanning(cells) & ~is_numbering(cells) & measured & named)
    firsts = cut(
        flagged.groupBy(*TABLE).agg(
            F.min("row_idx").alias("top"), F.min(F.when(F.col("data"), F.col("row_idx"))).alias("data_from")
        )
    )
    usual = firsts.filter(F.col("data_from") > F.col("top")).select(*TABLE, "data_from")
    headless = firsts.filter(F.col("data_from") == F.col("top")).select(*TABLE, "top")
    if headless.isEmpty():
        return usual
    later = (
        flagged.join(headless, TABLE)
        .filter((F.col("row_idx") > F.col("top")) & F.col("data"))
        .groupBy(*TABLE)
        .agg(F.min("row_idx").alias("data_from"))
    )
    return cut(usual.unionByName(later))


def header_row_counts(rows: DataFrame, data_from: DataFrame) -> DataFrame:
    """How many significant rows stand above the first data row."""
    above = join_lookup(rows.select(*TABLE, "row_idx"), data_from, TABLE, written=True).filter(F.col("row_idx") < F.col("data_from"))
    return above.groupBy(*TABLE).agg(F.count("*").alias("header_row_count"))


def profile_columns(rows: DataFrame, data_from: DataFrame) -> DataFrame:
    """Header text of every column and what lies below it.

    Counts masses, volumes, plain numbers, words and ordinals.  One pass over
    the cells: a first aggregate keeps numbers only and combines map-side, the
    second folds the few distinct header texts of a column.
    """
    service = is_spanning(F.col("cells")) | is_numbering(F.col("cells"))
    cells = (
        join_lookup(rows.select(*TABLE, "row_idx", "cells"), data_from, TABLE, written=True)
        .withColumn("is_data", F.col("row_idx") >= F.col("data_from"))
        .withColumn("counts", F.col("is_data") & ~service)
        .select(*TABLE, "row_idx", "is_data", "counts", F.posexplode("cells").alias("col_idx", "cell"))
        .withColumn("cell", strip(F.col("cell")))
        .withColumn("kind", F.when(F.col("counts"), let(parse_measure(F.col("cell")), _kind)))
    )
    filled = F.col("is_data") & (F.col("cell") != "")
    text = F.col("counts") & F.col("kind").isNull() & F.col("cell").rlike(WORDY)
    counted = cells.groupBy(*TABLE, "col_idx", F.when(~F.col("is_data"), F.col("cell")).alias("tier_text")).agg(
        F.min("row_idx").alias("tier"),
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in ("mass", "volume", "plain")],
        F.count_if(text).alias("text"),
        F.count_if(filled).alias("filled"),
        F.count_if(filled & F.col("cell").rlike(ORDINAL)).alias("ordinals"),
    )
    tiers = F.expr("collect_list(struct(tier, tier_text)) FILTER (WHERE tier_text <> '')")
    counts = ["mass", "volume", "plain", "text", "filled", "ordinals"]
    return (
        counted.groupBy(*TABLE, "col_idx")
        .agg(F.sort_array(tiers).alias("tiers"), *[F.sum(c).alias(c) for c in counts])
        .select(*TABLE, "col_idx", F.array_join("tiers.tier_text", " ").alias("header"), *counts)
    )


def _kind(measure: Column) -> Column:
    return F.when(measure.isNotNull(), F.coalesce(measure["kind"], F.lit("plain")))


def _first(columns: Column, test) -> Column:
    """Number of the first column that passes, or -1."""
    return F.coalesce(F.get(F.filter(columns, test), 0)["col_idx"], F.lit(-1))


def _most(columns: Column, field: str, test) -> Column:
    """Number of the column with the largest positive count, the first among equals, or -1."""
    counted = F.transform(
        F.filter(columns, lambda c: test(c) & (c[field] > 0)),
        lambda c: F.struct(c[field].alias("n"), (-c["col_idx"]).alias("back")),
    )
    return F.coalesce(-F.array_max(counted)["back"], F.lit(-1))


def _header(columns: Column, index: Column) -> Column:
    return F.coalesce(F.get(F.filter(columns, lambda c: c["col_idx"] == index), 0)["header"], F.lit(""))


def detect_layouts(rows: DataFrame) -> DataFrame:
    """Layout of every table that reads as a norms table.

    The columns of a table are few, so its profile becomes one array and each
    rule is a search in it: by the units in the cells, then by the units in the
    header, then by the header's words, then by being the only number left.
    """
    data_from = first_data_rows(rows)
    header = F.col("header")
    described = profile_columns(rows, data_from).select(
        *TABLE,
        F.struct(
            "col_idx",
            "header",
            "mass",
            "volume",
            "plain",
            "text",
            ((F.col("filled") > 0) & (F.col("ordinals") >= F.col("filled") * ORDINAL_SHARE)).alias("ordinal"),
            (~header.rlike(NUMBERING_HEADER) & header.rlike(NAME_HEADER)).alias("names"),
            normalize(header).rlike(UNIT_HEADER).alias("units"),
            is_mass_header(header).alias("mass_unit"),
            is_volume_header(header).alias("volume_unit"),
            header.rlike(MASS_WORD).alias("mass_word"),
            header.rlike(VOLUME_WORD).alias("volume_word"),
        ).alias("c"),
    )
    tables = described.groupBy(*TABLE).agg(F.sort_array(F.collect_list("c")).alias("columns"))
    cols, at = F.col("columns"), "col_idx"
    name, unit, mass, volume = (F.col(c) for c in COLUMNS)

    def otherwise(found: Column, fallback: Column) -> Column:
        return F.when(found >= 0, found).otherwise(fallback)

    def numeric(c, other):
        return (c[at] != name) & (c[at] != other) & (c["plain"] > 0)

    def free(c):
        return (c[at] != name) & (c[at] != unit)

    tables = tables.withColumn(
        "name_column",
        otherwise(_first(cols, lambda c: c["names"]), _most(cols, "text", lambda c: F.lit(True))),
    )
    tables = tables.withColumn("unit_column", _first(cols, lambda c: (c[at] != name) & c["units"] & ~c["ordinal"]))
    tables = tables.withColumns({"mass_column": _most(cols, "mass", free), "volume_column": _most(cols, "volume", free)})
    for flag in ("unit", "word"):
        tables = tables.withColumn(
            "mass_column", otherwise(mass, _first(cols, lambda c: numeric(c, volume) & c[f"mass_{flag}"]))
        )
        tables = tables.withColumn(
            "volume_column", otherwise(volume, _first(cols, lambda c: numeric(c, mass) & c[f"volume_{flag}"]))
        )
    spare = F.filter(cols, lambda c: free(c) & (c[at] != mass) & (c["plain"] > 0) & ~c["ordinal"])
    tables = tables.withColumn("spare", spare).withColumn(
        "volume_column",
        F.when((mass >= 0) & (volume < 0) & (F.size("spare") == 1), F.get("spare", 0)[at]).otherwise(volume),
    )
    none = F.lit(None)
    found = tables.join(data_from, TABLE).select(
        *TABLE,
        "data_from",
        *COLUMNS,
        _header(cols, mass).alias("mass_header"),
        _header(cols, volume).alias("volume_header"),
        none.cast("double").alias("mass_factor"),
        none.cast("double").alias("volume_factor"),
        none.cast("string").alias("basis"),
        F.col("table_idx").alias("list_pos"),
    )
    # Written out before it is filtered, as a filter would repeat the searches.
    return cut(found).filter((name >= 0) & ((mass >= 0) | (volume >= 0)))


def place_layouts(rows: DataFrame, layouts: DataFrame) -> DataFrame:
    """Explicit layouts with their row bound and header texts looked up.

    ``rows`` hold ``sig_idx``.  ``layouts`` gives ``header_row_count`` and the
    columns (-1 if absent), and may give factors, a basis and ``list_pos``.
    """
    optional = {"mass_factor": "double", "volume_factor": "double", "basis": "string"}
    for column, kind in optional.items():
        if column not in layouts.columns:
            layouts = layouts.withColumn(column, F.lit(None).cast(kind))
    if "list_pos" not in layouts.columns:
        layouts = layouts.withColumn("list_pos", F.col("table_idx"))
    usable = layouts.filter(
        (F.col("header_row_count") >= 0)
        & (F.col("name_column") >= 0)
        & ((F.col("mass_column") >= 0) | (F.col("volume_column") >= 0))
    )
    counts = usable.select(*TABLE, "header_row_count")
    bounds = (
        join_lookup(rows.select(*TABLE, "row_idx", "sig_idx"), counts, TABLE)
        .filter(F.col("sig_idx") == F.col("header_row_count"))
        .select(*TABLE, F.col("row_idx").alias("data_from"))
    )
    headers = cut(header_texts(rows, counts))
    placed = usable.join(bounds, TABLE)
    for role in ("mass", "volume"):
        named = headers.select(*TABLE, F.col("col_idx").alias(f"{role}_column"), F.col("header").alias(f"{role}_header"))
        placed = placed.join(named, [*TABLE, f"{role}_column"], "left")
    return cut(placed.withColumns({h: F.coalesce(h, F.lit("")) for h in ("mass_header", "volume_header")}))


def _unless_other(text: Column) -> Column:
    return F.nullif(unit_basis(text), F.lit("other"))


def _or_else(*texts: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def extract(rows: DataFrame, layouts: DataFrame) -> DataFrame:
    """Norm entries of the tables that have a layout, numbered n0, n1, … per file.

    ``layouts`` is a written table, from ``detect_layouts`` or ``place_layouts``.
    A pass over the rows with the layouts looked up.  A unit in the cell goes
    before the factor of its header; rows whose cell names the other kind of
    unit than its column are dropped.
    """
    mass_header, volume_header = F.col("mass_header"), F.col("volume_header")
    terms = layouts.select(
        *TABLE,
        "data_from",
        *COLUMNS,
        "mass_header",
        "volume_header",
        "list_pos",
        F.coalesce("mass_factor", mass_factor(mass_header), F.lit(1.0)).alias("to_mass"),
        F.coalesce("volume_factor", volume_factor(volume_header), F.lit(1.0)).alias("to_volume"),
        F.coalesce(
            F.nullif("basis", F.lit("")), _unless_other(mass_header), unit_basis(volume_header)
        ).alias("header_basis"),
    )
    cells = F.col("cells")
    body = join_lookup(rows.select(*TABLE, "title", "row_idx", "cells"), terms, TABLE, written=True).filter(
        (F.col("row_idx") >= F.col("data_from")) & ~is_service(cells, F.col("name_column"))
    )

    def at(role: str) -> Column:
        return F.when(F.col(f"{role}_column") >= 0, F.get(cells, F.col(f"{role}_column")))

    read = body.select(
        "*",
        cell_text(F.get(cells, F.col("name_column"))).alias("name"),
        strip(at("unit")).alias("unit_cell"),
        F.when(F.col("mass_column") >= 0, parse_measure(at("mass"))).alias("m"),
        F.when(F.col("volume_column") >= 0, parse_measure(at("volume"))).alias("v"),
    )
    usable = (
        F.when(F.col("name") == "", False)
        .when(F.col("m").isNull() & F.col("v").isNull(), False)
        .when((F.col("m.kind") == "volume") | (F.col("v.kind") == "mass"), False)
        .otherwise(True)
    )
    entries = read.select(
        *TABLE,
        "row_idx",
        "name",
        F.coalesce(
            _unless_other(F.col("unit_cell")),
            "m.basis",
            "v.basis",
            "header_basis",
            unit_basis(F.col("title")),
            F.lit("other"),
        ).alias("basis"),
        _or_else(
            F.col("unit_cell"), F.col("v.unit_text"), F.col("m.unit_text"), mass_header, volume_header
        ).alias("unit_text"),
        (F.col("m.value") * F.coalesce("m.factor", "to_mass")).alias("mass"),
        (F.col("v.value") * F.coalesce("v.factor", "to_volume")).alias("volume"),
        F.col("m.value").alias("raw_mass"),
        F.col("v.value").alias("raw_volume"),
        _or_else(F.col("m.unit_text"), mass_header).alias("mass_unit"),
        _or_else(F.col("v.unit_text"), volume_header).alias("volume_unit"),
        F.coalesce("title", F.lit("")).alias("title"),
        (F.col("list_pos").cast("bigint") * (1 << 40) + F.col("row_idx")).alias("reading_order"),
        usable.alias("usable"),
    )
    # Entries are few beside their grids; written once, they are numbered after.
    kept = cut(entries).filter("usable").drop("usable")
    numbered = running_position(kept, ["file"], "reading_order", "pos")
    return numbered.withColumn("id", F.concat(F.lit("n"), F.col("pos").cast("string"))).drop("reading_order")


def _dealt_rows(grids: DataFrame) -> DataFrame:
    """Significant rows dealt out to all cores.

    Cells are searched much on few bytes: an order landed in one piece would be
    one task's work, several times over.
    """
    return spread(grids, [*TABLE, "row_idx"]).filter(is_significant(F.col("cells")))


def read_norms(grids: DataFrame) -> DataFrame:
    """Entries of all tables, each table's layout being detected."""
    rows = _dealt_rows(grids)
    return extract(rows, detect_layouts(rows))


def apply_layouts(grids: DataFrame, layouts: DataFrame) -> DataFrame:
    """Entries read by explicit layouts; tables without one are left out."""
    return extract(_dealt_rows(grids), place_layouts(significant_rows(grids), layouts))


def layout_errors(grids: DataFrame, layouts: DataFrame, entries: DataFrame) -> DataFrame:
    """Tables that a layout names and that gave nothing, with the reason.

    ``no-table``: the file has no such table; ``nothing-read``: the layout is not
    usable, starts below the last row, or no row of the table reads by it.
    ``entries`` are those of ``apply_layouts``.  Tables of a file meet as one
    row each, map-side, before they are joined.
    """
    landed = grids.select(*TABLE).distinct().withColumn("landed", F.lit(True))
    read = entries.select(*TABLE).distinct()
    missed = layouts.select(*TABLE).distinct().join(read, TABLE, "left_anti").join(landed, TABLE, "left")
    return missed.select(*TABLE, F.when(F.col("landed"), "nothing-read").otherwise("no-table").alias("reason"))


def skipped_tables(grids: DataFrame, entries: DataFrame) -> DataFrame:
    """Tables of more than one row from which nothing was read."""
    sizes = grids.groupBy(*TABLE).agg(F.max("title").alias("title"), F.count("*").alias("n_rows"))
    return sizes.filter(F.col("n_rows") > 1).join(entries.select(*TABLE).distinct(), TABLE, "left_anti")


def table_counts(entries: DataFrame) -> DataFrame:
    """Entries per table and how many have a mass and a volume."""
    return entries.groupBy(*TABLE).agg(
        F.count("*").alias("n"),
        F.count("mass").alias("with_mass"),
        F.count("volume").alias("with_volume"),
    )


def compare_names(current: DataFrame, preview: DataFrame) -> DataFrame:
    """Names that another reading of the norms adds and removes."""
    before, after = current.select("name"), preview.select("name")
    added = after.subtract(before).select(F.lit("added").alias("change"), "name")
    return added.unionByName(before.subtract(after).select(F.lit("removed").alias("change"), "name"))
