"""An order landed in one piece is read by all cores."""

from ledgerfold.operators import grid, norms
from pyspark.sql import functions as F

GRID = "file string, table_idx int, title string, row_idx long, cells array<string>"


def test_rows_of_one_piece_are_dealt_out(spark, monkeypatch):
    rows = [("f", 0, "", 0, ["Наименование", "куб.м в год", "кг в год"])]
    rows += [("f", 0, "", i, ["Бани", "1,5", "2,5"]) for i in range(1, 400)]
    grids = spark.createDataFrame(rows, GRID).coalesce(1)
    seen, extract = [], norms.extract

    def watched(given, layouts):
        seen.append(given.groupBy(F.spark_partition_id()).count().count())
        return extract(given, layouts)

    monkeypatch.setattr(norms, "extract", watched)
    assert norms.read_norms(grids).count() == 399
    layout = spark.createDataFrame([("f", 0, 1, 0, -1, 2, 1)], f"file string, table_idx int, header_row_count int, {', '.join(f'{c} int' for c in norms.COLUMNS)}")
    assert norms.apply_layouts(grids, layout).count() == 399
    assert all(n >= spark.sparkContext.defaultParallelism for n in seen) and len(seen) == 2


def test_blank_cells_of_every_kind_are_not_significant(spark):
    cells = [[], [None], ["", " \t\n"], [" 　", "﻿ "], [None, "x"], ["​"], [" a "]]
    rows = spark.createDataFrame([("f", 0, "", i, c) for i, c in enumerate(cells)], GRID)
    assert [r["row_idx"] for r in rows.filter(grid.is_significant(F.col("cells"))).orderBy("row_idx").collect()] == [4, 5, 6]
