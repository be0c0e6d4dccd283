"""Registry rows are searched, trimmed and moved no more than needed."""

from pyspark.sql import functions as F

from ledgerfold.operators import registry
from ledgerfold.plans import extracts
from ledgerfold.sources.landing import read_csv_extracts

GRID = "file string, table_idx int, title string, row_idx long, cells array<string>"
SF = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_cube_of_landed_cells_is_the_cube_of_typed_rows(spark):
    head = ["Категория потребителя", "Количество расчетных единиц", "Зона деятельности", "Муниципальное образование"]
    body = [
        ["Бани", "1,5", "Север", "А"], [" Бани ", "2", "Север ", " А"], ["Бани\t", "0", " Север", "А"], ["Б ани", "x", "", None],
        ["Б   ани", "", None, ""], ["", "7", "Север", "А"], [None, "7", "Север", "А"], ["   ", "7", "Север", "А"], ["Бани"], [],
        ["бани", " ", "Север", "А"], ["Бани", " 3 ", "север", "А"],
    ]
    rows = [("a", 0, "", i, c) for i, c in enumerate([head, *body, *body])]
    rows += [("b", 0, "", i, c) for i, c in enumerate([head[:1] + head[2:], ["Бани", "Север", "А"], ["Бани ", "Север", "А"]])]
    grids = spark.createDataFrame(rows, GRID)
    layout = registry.layouts(grids)
    columns = [*registry.CUBE_KEYS, *registry.CUBE_COUNTS, "first_row"]
    expected = registry.cube(registry.typed_rows(grids, layout)).select(columns)
    found = registry.cube_of(grids, layout).select(columns)
    assert sorted(found.collect()) == sorted(expected.collect())
    assert found.dtypes == expected.dtypes
    assert found.filter("file = 'a' AND category = 'Бани' AND zone = 'Север' AND municipality = 'А'").first()["n_rows"] == 6


def test_names_are_trimmed_after_counting(spark):
    grids = extracts.registry_body(spark, SF)
    layout = registry.layouts(grids, top=extracts.registry_heads(spark, SF))
    lines = _plan(registry.cube_of(grids, layout)).split("\n")
    landed = max(n for n, line in enumerate(lines) if "Aggregate" in line)
    trimmed = [n for n, line in enumerate(lines) if "regexp_replace" in line and "{FEFF}]+|" in line]
    assert trimmed and max(trimmed) <= landed  # in the result of the lowest aggregate, or above it


def test_no_text_of_parts_or_places_is_moved_with_lines(spark):
    lines = _plan(extracts.registry_lines(spark, SF)).split("\n")
    at = next(n for n, line in enumerate(lines) if "l_orderkey" in line and "= o_orderkey" in line)
    assert not any(name in line for name in ("p_name", "p_brand", "r_name") for line in lines[at : at + 4])


def test_roles_are_searched_in_the_first_rows_of_csv_alone(spark, tmp_path):
    text = "Категория потребителя,Количество расчетных единиц\n" + "Бани,1\n" * 300
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    grids = read_csv_extracts(spark, str(tmp_path / "a.csv"))
    assert "Join" not in _plan(registry.header_candidates(grids))
    assert registry.cube_of(grids, registry.layouts(grids)).agg(F.sum("n_rows")).first()[0] == 300
