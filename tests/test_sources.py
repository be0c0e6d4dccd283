"""Reading extracts from CSV and sparse cells, and the streaming roll-up."""

from pyspark.sql import functions as F

from ledgerfold.operators import grid, kinds, registry, rules
from ledgerfold.sources.landing import CELL_SCHEMA, read_cells, read_csv_extracts
from ledgerfold.streaming.accumulate import accumulate, current_cube


def test_csv_extracts_keep_file_and_row(spark, tmp_path):
    for name, rows in {"a": ["Категория,Количество расчетных единиц,Зона", "Гостиницы,\"1,5\",Север", "Бани,2,Юг"], "b": ["Зона,Категория", "Север,Кладбища"]}.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(rows), encoding="utf-8")
    grids = read_csv_extracts(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), width=5)
    found = {(r["file"], r["row_idx"]): r["cells"] for r in grids.collect()}
    assert found[("a.csv", 1)] == ["Гостиницы", "1,5", "Север"] and found[("b.csv", 0)] == ["Зона", "Категория"]
    rows = registry.typed_rows(grids, registry.layouts(grids)).collect()
    assert sorted((r["file"], r["excel_row"], r["category"], r["units"]) for r in rows) == [
        ("a.csv", 2, "Гостиницы", 1.5), ("a.csv", 3, "Бани", 2.0), ("b.csv", 2, "Кладбища", None),
    ]


def test_cells_become_rows(spark, tmp_path):
    cells = spark.createDataFrame([("f", 0, 1, 3, "c"), ("f", 0, 1, 1, "a"), ("f", 0, 2, 2, "b"), ("f", 0, 3, 1, "")], CELL_SCHEMA)
    cells.write.parquet(str(tmp_path / "cells"))
    rows = grid.dense_rows(read_cells(spark, str(tmp_path / "cells")))
    assert {r["row_idx"]: r["cells"] for r in rows.collect()} == {1: ["a", "", "c"], 2: ["", "b", ""]}


def test_stream_equals_batch(spark, tmp_path):
    schema = "file string, zone string, municipality string, category string, units double, unreadable boolean, has_units boolean, excel_row long"
    rows = spark.createDataFrame([(f"f{i % 3}", "Z", "", f"c{i % 2}", float(i % 4), False, True, i) for i in range(24)], schema)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accumulate(stream, str(tmp_path / "cube"), str(tmp_path / "checkpoint")).awaitTermination()
    streamed = registry.groups(current_cube(spark, str(tmp_path / "cube")))
    batch = registry.groups(registry.cube(rows))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_kinds_of_files(spark):
    heads = {"a.xlsx": ["Категория", "Расчетная масса, т"], "b.xlsx": ["Категория потребителя", "Адрес"], "c.xlsx": ["Наименование категории", "куб.м"], "реестр.xlsx": ["x"]}
    grids = spark.createDataFrame([(f, 0, "Лист", 0, h) for f, h in heads.items()], "file string, table_idx int, title string, row_idx long, cells array<string>")
    files = grids.select("file").union(spark.createDataFrame([("d.pdf",), ("e.xlsx",)], "file string"))
    found = {r["file"]: r["kind"] for r in kinds.detect_kinds(files, grids).collect()}
    assert found == {"a.xlsx": "template", "b.xlsx": "registry", "c.xlsx": "norms", "реестр.xlsx": "registry", "d.pdf": "norms", "e.xlsx": "unknown"}


def test_last_edit_of_a_rule_counts(spark):
    edits = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "x", False), ("b", 2, None, True)], "key string, edit long, template_key string, reset boolean")
    assert [tuple(r) for r in rules.latest(edits).collect()] == [("a", "y")]
    mapping = spark.createDataFrame([("a", "m", 0.9, "auto", True), ("c", "m", 0.9, "auto", True)], "key string, template_key string, score double, status string, auto boolean")
    laid = {r["key"]: (r["template_key"], r["status"], r["auto"]) for r in rules.overlay_targets(mapping, rules.latest(edits)).collect()}
    assert laid == {"a": ("y", "manual", False), "c": ("m", "auto", True)}
    taken_out = rules.overlay_targets(mapping, edits.filter("key = 'a'").limit(1).withColumn("template_key", F.lit("")))
    assert {r["key"]: r["status"] for r in taken_out.collect()}["a"] == "ignored"


def test_csv_of_any_width_with_blank_lines(spark, tmp_path):
    from ledgerfold.sources.landing import broken_csv_lines, read_csv_extracts

    wide = ",".join(str(k) for k in range(45))
    (tmp_path / "a.csv").write_text('Реестр,,\n\n"Категория, вид","с ""кавычками""",\n' + wide + '\n"не закрыта\n', encoding="utf-8")
    rows = {r["row_idx"]: r["cells"] for r in read_csv_extracts(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {0: ["Реестр"], 1: [], 2: ["Категория, вид", 'с "кавычками"'], 3: [str(k) for k in range(45)], 4: ['"не закрыта']}
    assert [r["line"] for r in broken_csv_lines(spark, str(tmp_path / "a.csv")).collect()] == ['"не закрыта']


def test_formulas_with_odd_blanks_brackets_and_depth(spark):
    from ledgerfold.operators import formula

    norms = spark.createDataFrame([("n1", "площадь [n2]", 2.0, 3.0), ("n2", "прочее", 5.0, 7.0)], "id string, name string, mass double, volume double")
    deep = "(" * 3000 + "[n1]" + ")" * 3000
    rules = spark.createDataFrame([("a", "[ n1 ] + [n2]"), ("b", deep), ("c", "[n1] + [zz]")], "key string, expression string")
    got = {r["key"]: (r["formula_mass"], r["formula_error"]) for r in formula.evaluate_rules(rules, norms).collect()}
    assert got["a"] == (7.0, None) and got["b"] == (2.0, None)
    problems = {r["key"]: r["problem"] for r in formula.validate(rules, norms).collect()}
    assert problems["a"] is None and "zz" in problems["c"]
    texts = {r["key"]: r["expression"] for r in formula.humanize(rules.filter("key = 'a'"), norms).collect()}
    assert texts == {"a": "«площадь [n2]» + «прочее»"}


def test_csv_lines_that_start_with_a_separator(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',a,b\n,,c\n"",d\n,"e,f",g\n,\n', encoding="utf-8")
    rows = {r["row_idx"]: r["cells"] for r in read_csv_extracts(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {0: ["", "a", "b"], 1: ["", "", "c"], 2: ["", "d"], 3: ["", "e,f", "g"], 4: []}
    (tmp_path / "b.csv").write_text("|a\n", encoding="utf-8")
    assert read_csv_extracts(spark, str(tmp_path / "b.csv"), separator="|").first()["cells"] == ["", "a"]
