"""Cuts of a table with many headers are met by a running sum, not searched by every row."""

from ledgerfold.operators import grid


def test_many_cuts(spark):
    head = ["Наименование", "куб.м в год", "кг в год"]
    rows = [("f", 0, "", i, head if i % 2 == 0 else ["Бани", "1,5", "2,5"]) for i in range(700)]
    grids = spark.createDataFrame(rows, "file string, table_idx int, title string, row_idx long, cells array<string>")
    parts = grid.split_on_repeated_header(grids)
    assert "filter(cuts" not in parts._jdf.queryExecution().optimizedPlan().toString()
    found = {r["row_idx"]: (r["part"], r["part_row"]) for r in parts.collect()}
    assert found == {i: (i // 2, i % 2) for i in range(700)}
