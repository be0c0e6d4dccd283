"""Operators on landed grids.

A grid row is ``(file, table_idx, title, row_idx, cells ARRAY<STRING>)``; a
sparse sheet is ``(file, table_idx, row_idx, col_idx, value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions.text import NOT_BLANK, parse_number, strip
from ledgerfold.functions.units import is_mass_header, is_volume_header
from ledgerfold.operators.relational import join_lookup, running_position, running_sum

CUTS_TOGETHER = 256
TABLE = ["file", "table_idx"]

# --- fixed values: wording of rows that carry remarks, not data --------------
REMARK = (
    r"(?iu)список изменяющих|действие изменений|в ред\.|введен|введена|введено|утратил"
    r"|исключен|дополнен|примечани|^\s*<?\*"
)
WORDY = "(?iu)[а-яa-z]{4}"
FILL_ROWS = 3
CAPTION_PARTS = 4


def dense_rows(cells: DataFrame, least_width: int = 0) -> DataFrame:
    """Sparse cells to rows of equal width per table, absent cells as ''."""
    kept = cells.filter(F.col("value").isNotNull() & (F.col("value") != ""))
    widths = cells.groupBy(*TABLE).agg(F.greatest(F.max("col_idx"), F.lit(least_width)).alias("width"))
    rows = kept.groupBy(*TABLE, "row_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("by_col")
    )
    dense = F.transform(
        F.sequence(F.lit(1), F.col("width")),
        lambda c: F.coalesce(F.try_element_at(F.col("by_col"), c), F.lit("")),
    )
    return join_lookup(rows, widths, TABLE).select(
        *TABLE, "row_idx", dense.alias("cells")
    )


def expand_spans(cells: DataFrame) -> DataFrame:
    """Repeat a cell that spans n columns n times, shifting its right neighbours."""
    left = Window.partitionBy(*TABLE, "row_idx").orderBy("col_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("span").over(left), F.lit(0))
    placed = cells.withColumn("start", start)
    return placed.select(
        *TABLE,
        "row_idx",
        F.explode(F.sequence("start", F.col("start") + F.col("span") - 1).cast("array<int>")).alias("col_idx"),
        "value",
    )


def fill_down(cells: DataFrame) -> DataFrame:
    """Give empty cells of rows 1 and 2 the value above them, one row after the other.

    Only the first three rows are gathered; everything below passes through.
    """
    head = cells.filter(F.col("row_idx") < FILL_ROWS)
    at = [F.max(F.when(F.col("row_idx") == r, F.col("value"))).alias(f"v{r}") for r in range(FILL_ROWS)]
    # A null means that the row is too short to hold the column: nothing passes it.
    second = F.when(F.col("v1") == "", F.coalesce("v0", "v1")).otherwise(F.col("v1"))
    third = F.when(F.col("v2") == "", F.coalesce("f1", "v2")).otherwise(F.col("v2"))
    filled = (
        head.groupBy(*TABLE, "col_idx")
        .agg(*at)
        .withColumn("f1", second)
        .withColumn("f2", third)
        .select(*TABLE, "col_idx", F.posexplode(F.array("v0", "f1", "f2")).alias("row_idx", "value"))
        .filter(F.col("value").isNotNull())
        .select(*TABLE, F.col("row_idx").cast("bigint").alias("row_idx"), "col_idx", "value")
    )
    below = cells.filter(F.col("row_idx") >= FILL_ROWS).select(
        *TABLE, F.col("row_idx").cast("bigint").alias("row_idx"), "col_idx", "value"
    )
    return filled.unionByName(below)


def captions(body: DataFrame) -> DataFrame:
    """Caption of each table: the last four non-empty paragraphs since the table before.

    ``body`` is ``(file, seq, is_table, text)`` in document order.
    """
    flag = F.col("is_table").cast("bigint")
    marked = running_sum(body, ["file"], "seq", flag, "seen").withColumn("island", F.col("seen") - flag)
    tables = marked.filter("is_table").select("file", "island", "seq")
    recent = Window.partitionBy("file", "island").orderBy(F.desc("seq"))
    said = (
        marked.filter(~F.col("is_table") & (F.col("text") != ""))
        .withColumn("back", F.row_number().over(recent))
        .filter(F.col("back") <= CAPTION_PARTS)
        .groupBy("file", "island")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("parts"))
        .select("file", "island", F.array_join(F.col("parts.text"), " ").alias("caption"))
    )
    return tables.join(said, ["file", "island"], "left").select(
        "file",
        F.col("island").alias("table_idx"),
        F.coalesce("caption", F.lit("")).alias("caption"),
    )


def filled_cells(cells: Column) -> Column:
    return F.filter(F.transform(cells, strip), lambda c: c != "")


def is_significant(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.coalesce(c, F.lit("")).rlike(NOT_BLANK))


def is_spanning(cells: Column) -> Column:
    """At least two filled cells, all equal: a heading across the table."""
    filled = filled_cells(cells)
    return (F.size(filled) > 1) & (F.size(F.array_distinct(filled)) == 1)


def is_numbering(cells: Column) -> Column:
    """1 | 2 | 3 …: the numbers of the columns."""
    filled = filled_cells(cells)
    counted = F.transform(
        filled,
        lambda c, i: c.rlike(r"^\d{1,2}\.?$") & (F.replace(c, F.lit("."), F.lit("")).try_cast("int") == i + 1),
    )
    return (F.size(filled) >= 2) & F.forall(counted, lambda ok: F.coalesce(ok, F.lit(False)))


def is_remark(text: Column) -> Column:
    return text.rlike(REMARK)


def is_service(cells: Column, name_column: Column) -> Column:
    """Rows of a norms table that carry no data."""
    name = strip(F.get(cells, name_column))
    return is_spanning(cells) | is_numbering(cells) | ((name != "") & is_remark(name))


def significant_rows(grids: DataFrame) -> DataFrame:
    """Drop blank rows and number the rest from zero per table (``sig_idx``)."""
    kept = grids.filter(is_significant(F.col("cells")))
    return running_position(kept, TABLE, "row_idx", "sig_idx")


def header_texts(rows: DataFrame, header_rows: DataFrame) -> DataFrame:
    """One text per column from a header of several rows, repeats left out.

    ``rows`` hold ``sig_idx``; ``header_rows`` is ``(file, table_idx, header_row_count)``.
    """
    head = join_lookup(rows, header_rows, TABLE).filter(
        F.col("sig_idx") < F.col("header_row_count")
    )
    tiers = (
        head.select(*TABLE, "sig_idx", F.posexplode("cells").alias("col_idx", "cell"))
        .withColumn("text", strip(F.col("cell")))
        .groupBy(*TABLE, "col_idx", "text")
        .agg(F.min("sig_idx").alias("tier"))
    )
    return (
        tiers.groupBy(*TABLE, "col_idx")
        .agg(F.sort_array(F.collect_list(F.struct("tier", "text"))).alias("tiers"))
        .select(
            *TABLE,
            "col_idx",
            F.array_join(F.filter(F.col("tiers.text"), lambda t: t != ""), " ").alias("header"),
        )
    )


def header_sample(grids: DataFrame, rows: int = 6, columns: int = 14, width: int = 120) -> DataFrame:
    """First rows × columns × characters of every sheet (blank rows left out)."""
    # The sheet is read two rows deeper than the sample, as blank rows fall out.
    top = grids.filter(F.col("row_idx") < rows + 2).filter(is_significant(F.col("cells")))
    order = Window.partitionBy(*TABLE).orderBy("row_idx")
    return (
        top.withColumn("sample_row", F.row_number().over(order) - 1)
        .filter(F.col("sample_row") < rows)
        .select(
            *TABLE,
            "title",
            "sample_row",
            F.transform(
                F.slice("cells", 1, columns), lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(width))
            ).alias("cells"),
        )
    )


# --- fixed values: caps of a norms sample ------------------------------------
SAMPLE_TABLES, SAMPLE_ROWS, SAMPLE_COLUMNS, SAMPLE_CELL, SAMPLE_CELLS = 12, 400, 16, 300, 20_000


def sample_allowance(grids: DataFrame) -> DataFrame:
    """Rows each table of a file may put into a sample.

    Small tables go in whole; what they leave is shared by the larger ones.
    """
    per_table = (
        grids.groupBy(*TABLE)
        .agg(
            F.count_if(is_significant(F.col("cells"))).alias("n"),
            F.max(F.size("cells")).alias("width"),
        )
        .filter(F.col("n") > 1)
    )
    first = Window.partitionBy("file").orderBy("table_idx")
    chosen = per_table.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= SAMPLE_TABLES)
    per_file = chosen.groupBy("file").agg(
        F.least(F.greatest(F.max("width"), F.lit(1)), F.lit(SAMPLE_COLUMNS)).alias("width"),
        F.sort_array(F.collect_list(F.struct("n", "table_idx"))).alias("order"),
    )
    start = F.struct(
        F.floor(F.lit(SAMPLE_CELLS) / F.col("width")).cast("bigint").alias("budget"),
        F.size("order").cast("bigint").alias("left"),
        F.array().cast("array<struct<table_idx:int,allowance:bigint>>").alias("given"),
    )

    def give(acc, table):
        share = F.floor(acc["budget"] / acc["left"]).cast("bigint")
        rows = F.least(table["n"], share, F.lit(SAMPLE_ROWS).cast("bigint"))
        entry = F.struct(table["table_idx"].cast("int").alias("table_idx"), rows.alias("allowance"))
        return F.struct(
            (acc["budget"] - rows).alias("budget"),
            (acc["left"] - 1).alias("left"),
            F.concat(acc["given"], F.array(entry)).alias("given"),
        )

    shared = per_file.withColumn("given", F.aggregate("order", start, give, lambda acc: acc["given"]))
    return shared.select("file", "width", F.explode("given").alias("g")).select(
        "file", F.col("g.table_idx").alias("table_idx"), "width", F.col("g.allowance").alias("allowance")
    )


def norms_sample(grids: DataFrame) -> DataFrame:
    """The budgeted sample itself: allowed rows, columns and characters."""
    rows = significant_rows(grids)
    allowed = sample_allowance(grids)
    return (
        join_lookup(rows, allowed, TABLE)
        .filter(F.col("sig_idx") < F.col("allowance"))
        .select(
            *TABLE,
            F.left(F.coalesce("title", F.lit("")), F.lit(SAMPLE_CELL)).alias("title"),
            "sig_idx",
            F.transform(
                F.slice("cells", F.lit(1), F.col("width")),
                lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(SAMPLE_CELL)),
            ).alias("cells"),
        )
    )


def split_on_repeated_header(grids: DataFrame) -> DataFrame:
    """Cut a table where a second header with units begins.

    A header row names at least two units; the number-less rows right before it
    belong to it.  A cut is made only where numbers came earlier in the part, and
    parts of one row are dropped.  Adds ``part`` and the row number inside it.
    """
    cells = F.col("cells")
    units = F.size(F.filter(cells, lambda c: is_mass_header(c) | is_volume_header(c))) >= 2
    numbers = F.exists(cells, lambda c: parse_number(c).isNotNull())
    flagged = grids.withColumn("numeric", numbers).withColumn(
        "soft", ~numbers & is_significant(cells)
    ).withColumn("units", units)

    # A run of soft rows that ends in (or right before) a unit header moves
    # the cut to the start of the run: number runs by counting the hard rows.
    flagged = running_sum(
        flagged, TABLE, "row_idx", (~F.col("soft")).cast("bigint"), "hard_before"
    ).withColumn("numbers_cast", F.col("numeric").cast("bigint"))
    flagged = running_sum(flagged, TABLE, "row_idx", F.col("numbers_cast"), "numbers_seen")
    marks = flagged.filter("units").select(
        *TABLE,
        F.col("row_idx").alias("mark"),
        (F.col("numbers_seen") - F.col("numbers_cast")).alias("numbers_before"),
        # Hard rows strictly above the header tell which run it continues.
        (F.col("hard_before") - (~F.col("soft")).cast("bigint")).alias("run"),
    )
    runs = flagged.filter("soft").groupBy(*TABLE, F.col("hard_before").alias("run")).agg(
        F.min("row_idx").alias("run_start")
    )
    marked = marks.join(runs, [*TABLE, "run"], "left").withColumn(
        "run_start", F.least(F.coalesce("run_start", F.col("mark")), F.col("mark"))
    )
    # Marks are few; the walk over them keeps the start of the current part.
    per_table = marked.groupBy(*TABLE).agg(
        F.sort_array(F.collect_list(F.struct("mark", "run_start", "numbers_before"))).alias("marks")
    )
    first = grids.groupBy(*TABLE).agg(F.min("row_idx").alias("first_row"))
    begin = F.struct(
        F.col("first_row").cast("bigint").alias("start"),
        F.lit(0).cast("bigint").alias("numbers_at_start"),
        F.array().cast("array<bigint>").alias("last"),
        F.array().cast("array<array<bigint>>").alias("cuts"),
    )

    def walk(acc, m):
        # At least one row of the current part stays above the cut.
        at = F.greatest(m["run_start"], F.least(acc["start"] + 1, m["mark"]))
        full = F.size(acc["last"]) >= CUTS_TOGETHER
        valid = (m["mark"] > F.col("first_row")) & (at > acc["start"]) & (m["numbers_before"] > acc["numbers_at_start"])
        return F.when(
            valid,
            F.struct(
                at.cast("bigint").alias("start"),
                m["numbers_before"].alias("numbers_at_start"),
                # Cuts in batches, as adding to an array copies it.
                F.when(full, F.array(at.cast("bigint"))).otherwise(F.concat(acc["last"], F.array(at.cast("bigint")))).alias("last"),
                F.when(full, F.concat(acc["cuts"], F.array(acc["last"]))).otherwise(acc["cuts"]).alias("cuts"),
            ),
        ).otherwise(acc)

    found = F.aggregate("marks", begin, walk, lambda a: F.concat(F.flatten(a["cuts"]), a["last"]))
    cuts = first.join(per_table, TABLE).select(*TABLE, F.explode(found).alias("cut"))
    # A row's part is the number of cuts up to it: a running sum over rows and cuts, a cut before its row.
    place = F.col("row_idx").cast("bigint") * 2
    events = grids.select(*TABLE, (place + 1).alias("place"), F.lit(0).cast("bigint").alias("cut"), F.struct("title", "row_idx", "cells").alias("r"))
    both = events.unionByName(
        cuts.select(*TABLE, (F.col("cut") * 2).alias("place"), F.lit(1).cast("bigint").alias("cut")), allowMissingColumns=True
    )
    summed = running_sum(both, TABLE, "place", F.col("cut"), "part").filter(F.col("r").isNotNull())
    placed = summed.select(*TABLE, "r.*", F.col("part").cast("int").alias("part"))
    sizes = placed.groupBy(*TABLE, "part").agg(F.count("*").alias("part_rows"), F.min("row_idx").alias("part_start"))
    return (
        join_lookup(placed, sizes, [*TABLE, "part"])
        .filter(F.col("part_rows") > 1)
        .withColumn("part_row", F.col("row_idx") - F.col("part_start"))
        .select(*TABLE, "title", "row_idx", "part", "part_row", "cells")
    )
