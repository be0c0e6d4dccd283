"""Spreadsheet references such as AB12, counted from one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = "^([A-Z]+)([0-9]+)$"


def parse_ref(ref: Column) -> Column:
    """'AB12' as struct(col, row); null when the text is no reference."""
    upper = F.upper(ref)
    letters = F.split(F.regexp_extract(upper, _SHAPE, 1), "")
    column = F.aggregate(
        F.filter(letters, lambda c: c != ""),
        F.lit(0),
        lambda acc, c: (acc * 26 + F.ascii(c) - 64).cast("int"),
    )
    row = F.regexp_extract(upper, _SHAPE, 2).try_cast("bigint")
    return F.when(upper.rlike(_SHAPE), F.struct(column.alias("col"), row.alias("row")))


def column_letter(index: Column) -> Column:
    """28 as 'AB'.  Seven letters are enough for any int column number."""
    start = F.struct(index.cast("bigint").alias("left"), F.lit("").alias("text"))

    def step(acc, _):
        digit = F.pmod(acc["left"] - 1, F.lit(26))
        return F.when(
            acc["left"] > 0,
            F.struct(
                F.floor((acc["left"] - 1) / 26).cast("bigint").alias("left"),
                F.concat(F.char(digit + 65), acc["text"]).alias("text"),
            ),
        ).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda acc: acc["text"])


def make_ref(column: Column, row: Column) -> Column:
    return F.concat(column_letter(column), row.cast("string"))
