"""Registry extracts: finding the columns, typing the rows, rolling them up.

The rows are scanned once.  ``cube`` counts them per file and raw spelling with
a map-side combine; keys are normalised on the few distinct spellings that
remain, and every roll-up below is derived from the cube.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions.text import NOT_BLANK, cell_text, normalize, parse_number, strip
from ledgerfold.operators.grid import TABLE
from ledgerfold.operators.relational import index_where
from ledgerfold.session import cut

# --- fixed values: how the columns of an extract are headed -------------------
COLUMN_PATTERNS = {
    "category": "категор",
    "units": "количеств[а-я]*\\s+расчетн|расчетн[а-я]*\\s+единиц|кол во расчетн",
    "zone": "зона",
    "unit_name": "единиц[а-я]*\\s+измерен",
    "municipality": "муниципальн|городско|район",
    "source": "наименование источник|адрес|источник образован",
}
ROLE_SCORE = {"category": 2, "units": 2}
HEADER_DEPTH = 25
WARNINGS_SHOWN = 50
LAYOUT = ["header_row", "category", "units", "zone", "municipality", "unit_name"]


def header_candidates(grids: DataFrame, depth: int = HEADER_DEPTH) -> DataFrame:
    """Rows that could be the header: recognised roles and their score.

    The first rows are written: where numbers of rows come of a join, as those of
    CSV lines do, the search for roles would else be moved below it, to all rows.
    """
    top = cut(grids.filter(F.col("row_idx") < depth).select(*TABLE, "row_idx", "cells"))
    top = top.select(*TABLE, "row_idx", F.transform("cells", normalize).alias("texts"))
    roles = {
        role: index_where(F.col("texts"), lambda t, p=pattern: t.rlike(p))
        for role, pattern in COLUMN_PATTERNS.items()
    }
    found = top.select(*TABLE, "row_idx", *[c.alias(role) for role, c in roles.items()])
    score = sum(
        (F.when(F.col(role).isNotNull(), ROLE_SCORE.get(role, 1)).otherwise(0) for role in roles),
        F.lit(0),
    )
    others = F.coalesce(*[F.col(role) for role in roles if role != "category"])
    return found.withColumn("score", score).filter(F.col("category").isNotNull() & others.isNotNull())


def detect_columns(grids: DataFrame, depth: int = HEADER_DEPTH) -> DataFrame:
    """The best header row per table, the earliest among equals."""
    found = header_candidates(grids, depth)
    roles = list(COLUMN_PATTERNS)
    best = F.max(F.struct("score", (-F.col("row_idx")).alias("early"), *roles))
    return found.groupBy(*TABLE).agg(best.alias("b")).select(
        *TABLE,
        (-F.col("b.early")).cast("bigint").alias("header_row"),
        *[F.col(f"b.{role}").alias(role) for role in roles],
        F.col("b.score").alias("score"),
    )


def best_sheet(grids: DataFrame, detected: DataFrame) -> DataFrame:
    """One table per file: the longest of those with a header, the first on a tie.

    ``detected`` is a written table.  Lengths are looked up only for files with
    several such tables; where every file has one, no row is scanned for it.
    """
    counted = detected.withColumn("__tables", F.count("*").over(Window.partitionBy("file")))
    several = counted.filter(F.col("__tables") > 1).drop("__tables")
    if several.isEmpty():
        return detected
    lengths = (
        grids.select(*TABLE, "row_idx")
        .join(several.select(*TABLE), TABLE)
        .groupBy(*TABLE)
        .agg((F.max("row_idx") + 1).alias("length"))
    )
    order = Window.partitionBy("file").orderBy(F.desc("length"), "table_idx")
    longest = (
        several.join(lengths, TABLE)
        .withColumn("__place", F.row_number().over(order))
        .filter(F.col("__place") == 1)
        .drop("__place", "length")
    )
    return cut(counted.filter(F.col("__tables") == 1).drop("__tables").unionByName(longest))


def layouts(grids: DataFrame, explicit: DataFrame | None = None, top: DataFrame | None = None) -> DataFrame:
    """Detected layout per file, replaced where an explicit one is given.

    ``explicit`` has the columns of ``LAYOUT`` next to ``file, table_idx``; an
    absent column is null there.  ``top`` may supply the first rows of the
    tables where they are landed apart from the rest.
    """
    detected = cut(detect_columns(grids if top is None else top))
    found = best_sheet(grids, detected).select(*TABLE, *LAYOUT, F.lit("detected").alias("layout_source"))
    if explicit is None:
        return found
    given = explicit.select(*TABLE, *LAYOUT, F.lit("explicit").alias("layout_source"))
    rest = found.join(given.select("file").distinct(), "file", "left_anti")
    return cut(rest.unionByName(given))


def _cell(column: str) -> Column:
    return F.get(F.col("cells"), F.col(column))


def _placed(grids: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows below the header of their file with their cells by role, as landed.

    ``layout`` comes from ``layouts``, so its size is known and Catalyst
    broadcasts it: the rows are read, projected and filtered in one stage.
    """
    below = grids.join(layout, TABLE).filter(F.col("row_idx") > F.col("header_row"))
    absent = F.lit("")
    return below.select(
        "file",
        (F.col("row_idx") + 1).alias("excel_row"),
        _cell("category").alias("category"),
        F.col("units").isNotNull().alias("has_units"),
        F.when(F.col("units").isNotNull(), _cell("units")).alias("raw_units"),
        *[F.when(F.col(role).isNotNull(), _cell(role)).otherwise(absent).alias(role) for role in ("zone", "municipality", "unit_name")],
    )


def _named() -> Column:
    return F.coalesce("category", F.lit("")).rlike(NOT_BLANK)


def _numbered(placed: DataFrame) -> DataFrame:
    """Units are null where the extract has no such column and 0 where the cell cannot be read."""
    has_units, number = F.col("has_units"), F.col("number")
    return placed.withColumn("number", parse_number(F.col("raw_units"))).select(
        *placed.columns,
        F.when(has_units, F.coalesce(number, F.lit(0.0))).alias("units"),
        (has_units & number.isNull()).alias("units_missing"),
        (has_units & number.isNull() & F.coalesce("raw_units", F.lit("")).rlike(NOT_BLANK)).alias("unreadable"),
    )


def _spelled(column: str) -> Column:
    return (cell_text if column == "category" else strip)(F.col(column))


def typed_rows(grids: DataFrame, layout: DataFrame) -> DataFrame:
    """Registry rows of every file; rows without a category are left out.

    Units are null where the extract has no such column and 0 where the cell
    cannot be read; ``unreadable`` marks the non-blank ones among the latter.
    """
    return _numbered(_placed(grids, layout).filter(_named())).select(
        "file",
        "excel_row",
        _spelled("category").alias("category"),
        "units",
        "units_missing",
        "unreadable",
        "raw_units",
        *[_spelled(c).alias(c) for c in ("zone", "municipality", "unit_name")],
        "has_units",
    )


def warnings(rows: DataFrame, shown: int = WARNINGS_SHOWN) -> DataFrame:
    """The first unreadable quantities of every file, by row."""
    order = Window.partitionBy("file").orderBy("excel_row", "raw_units", "category")
    return (
        rows.filter("unreadable")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= shown)
        .select("file", "place", "excel_row", "raw_units")
    )


CUBE_KEYS = ["file", "zone", "municipality", "category"]
CUBE_COUNTS = ["n_rows", "n_unknown", "n_zero", "units", "n_unreadable", "n_without_column"]


def cube(rows: DataFrame) -> DataFrame:
    """Counts per file and raw spelling; all buffers are numbers, so it hash-aggregates."""
    units = F.col("units")
    return rows.groupBy(*CUBE_KEYS).agg(
        F.count("*").alias("n_rows"),
        F.count_if(units.isNull()).alias("n_unknown"),
        F.count_if(units == 0).alias("n_zero"),
        F.coalesce(F.sum(units), F.lit(0.0)).alias("units"),
        F.count_if("unreadable").alias("n_unreadable"),
        F.count_if(~F.col("has_units")).alias("n_without_column"),
        F.min("excel_row").alias("first_row"),
    )


def cube_of(grids: DataFrame, layout: DataFrame) -> DataFrame:
    """``cube(typed_rows(grids, layout))``, with names trimmed on their distinct cells only.

    Cells are counted as they were landed; what is left is trimmed, rows without
    a category are dropped, and cells that are the same then are added up.
    """
    landed = cube(_numbered(_placed(grids, layout))).filter(_named())
    spelled = landed.withColumns({c: _spelled(c) for c in CUBE_KEYS if c != "file"})
    return spelled.groupBy(*CUBE_KEYS).agg(*[F.sum(c).alias(c) for c in CUBE_COUNTS], F.min("first_row").alias("first_row"))


def keyed(cells: DataFrame) -> DataFrame:
    return cells.withColumns(
        {
            "zone_key": normalize(F.col("zone")),
            "municipality_key": normalize(F.col("municipality")),
            "category_key": normalize(F.col("category")),
        }
    )


GROUP_KEYS = ["zone_key", "municipality_key", "category_key"]


def _known_sources() -> Column:
    return F.sum(F.col("n_rows") - F.col("n_zero"))


def groups(cells: DataFrame) -> DataFrame:
    """Registry groups by zone, municipality and category.

    Names are those of the first row met, files being taken in name order.
    """
    first = F.min(F.struct("file", "first_row", "zone", "municipality", "category"))
    return (
        keyed(cells)
        .groupBy(*GROUP_KEYS)
        .agg(
            first.alias("f"),
            F.sum("n_rows").alias("n_rows"),
            _known_sources().alias("sources"),
            F.sum("n_zero").alias("zero_sources"),
            F.sum("units").alias("units"),
            (F.sum("n_unknown") == 0).alias("units_known"),
            F.count_distinct("file").alias("n_files"),
        )
        .select(
            *GROUP_KEYS,
            *[F.col(f"f.{n}").alias(n) for n in ("zone", "municipality", "category")],
            "n_rows",
            "sources",
            "zero_sources",
            "units",
            "units_known",
            "n_files",
        )
    )


def group_files(cells: DataFrame) -> DataFrame:
    """Which files each group came from, as a relation of its own."""
    return keyed(cells).select(*GROUP_KEYS, "file").distinct()


def categories(cells: DataFrame) -> DataFrame:
    first = F.min(F.struct("file", "first_row", "category"))
    return (
        keyed(cells)
        .groupBy("category_key")
        .agg(
            first.alias("f"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("units").alias("units"),
            (F.sum("n_unknown") == 0).alias("units_known"),
            _known_sources().alias("sources"),
            F.count_distinct("zone").alias("n_zones"),
        )
        .select(
            "category_key",
            F.col("f.category").alias("name"),
            "n_rows",
            "units",
            "units_known",
            "sources",
            "n_zones",
            F.col("f.file").alias("first_file"),
            F.col("f.first_row").alias("first_row"),
        )
    )


def places(cells: DataFrame, column: str, keep_empty: bool) -> DataFrame:
    """Rows per zone or municipality under the name met first."""
    key = f"{column}_key"
    counted = (
        keyed(cells)
        .groupBy(key)
        .agg(F.min(F.struct("file", "first_row", column)).alias("f"), F.sum("n_rows").alias("n_rows"))
        .select(
            key,
            F.col(f"f.{column}").alias("name"),
            "n_rows",
            F.col("f.file").alias("first_file"),
            F.col("f.first_row").alias("first_row"),
        )
    )
    return counted if keep_empty else counted.filter(F.col(key) != "")


def zones(cells: DataFrame) -> DataFrame:
    return places(cells, "zone", keep_empty=True)


def municipalities(cells: DataFrame) -> DataFrame:
    return places(cells, "municipality", keep_empty=False)


def by_size(counted: DataFrame) -> DataFrame:
    """Largest first, ties in the order they were met."""
    return counted.orderBy(F.desc("n_rows"), "first_file", "first_row")


def totals(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """Totals over all files; units count as known only if every file has the column.

    Files are those of ``layout``: one that has a header and no row counts too.
    """
    known = layout.agg((F.count_if(F.col("units").isNull()) == 0).alias("has_units"))
    return cells.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("n_zero"), F.lit(0)).alias("zero_rows"),
        F.coalesce(F.sum("n_unknown"), F.lit(0)).alias("rows_without_units"),
    ).withColumn("has_units", known.scalar())


def file_stats(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows, known units and warnings of every file of ``layout``, without rows too."""
    files = layout.groupBy("file").agg(F.bool_and(F.col("units").isNotNull()).alias("has_units"))
    counted = cells.groupBy("file").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_unreadable").alias("warnings_total"))
    none = F.lit(0).cast("bigint")
    return files.join(counted, "file", "left").select(
        "file", F.coalesce("n_rows", none).alias("n_rows"), "has_units", F.coalesce("warnings_total", none).alias("warnings_total")
    )


def unread_files(grids: DataFrame, layout: DataFrame) -> DataFrame:
    """Files that no layout reads, with the reason and the number of their rows."""
    landed = grids.groupBy("file").agg(F.count("*").alias("n_rows"))
    return landed.join(layout.select("file").distinct(), "file", "left_anti").select("file", F.lit("no-header").alias("reason"), "n_rows")


def distinct_names(cells: DataFrame) -> DataFrame:
    """Distinct non-empty spellings of category, zone and municipality per file."""
    counts = [
        F.count_distinct(F.when(F.col(c) != "", F.col(c))).alias(f"n_{c}") for c in ("category", "zone", "municipality")
    ]
    return cells.groupBy("file").agg(*counts)
