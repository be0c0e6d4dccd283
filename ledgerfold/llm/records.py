"""The records that the operators of this folder work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
SPACES = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\x0c\r"  # the same, one by one


def file_texts(grids: DataFrame) -> DataFrame:
    """One text per landed file: ``(file, text)`` of ``(file, table_idx, title, row_idx, cells)``.

    A line per table title and per row, cells parted by a blank, in the order of
    tables and rows.  Null cells and titles leave no trace; a file whose cells
    are all null has an empty text.
    """
    row = F.array_join(F.filter("cells", lambda c: c.isNotNull()), " ")
    lines = grids.select("file", "table_idx", F.col("row_idx").cast("bigint").alias("at"), row.alias("line"))
    titles = grids.filter(F.col("title").isNotNull()).select("file", "table_idx", F.lit(-1).cast("bigint").alias("at"), F.col("title").alias("line")).distinct()
    together = lines.unionByName(titles).groupBy("file")
    ordered = F.sort_array(F.collect_list(F.struct("table_idx", "at", "line")))
    return together.agg(F.array_join(F.filter(F.transform(ordered, lambda x: x["line"]), lambda x: x != ""), "\n").alias("text"))
