"""Layouts stored in rule files, files and tables that are left out, extracts of equal names."""

import json

from pyspark.sql import functions as F

from ledgerfold.operators import checks, norms, proposals
from ledgerfold.plans import report
from ledgerfold.sources import rules as rule_files
from ledgerfold.sources.landing import csv_cells, csv_line, read_csv_extracts

GRID = "file string, table_idx int, title string, row_idx long, cells array<string>"
LAYOUT = {"headerRowCount": 1, "nameColumn": 0, "massColumn": 1, "massFactor": 1000.0, "basis": "place"}
LAYOUTS = (
    "file string, table_idx int, header_row_count int, name_column int, unit_column int, mass_column int, volume_column int"
)


def _documents(spark, *documents):
    return spark.createDataFrame([(json.dumps(d, ensure_ascii=False) if not isinstance(d, str) else d,) for d in documents], "text string")


def _order(spark, *files):
    rows = [
        (file, t, "Приложение", i, cells)
        for file, t in files
        for i, cells in enumerate([["Наименование", "кг в год"], ["Бани", "2,5"], ["Кладбища", "4"], ["Рынки", "7"]])
    ]
    return spark.createDataFrame(rows, GRID)


def test_layouts_of_a_rule_file_bare_and_wrapped(spark):
    layout = {"tables": [{"tableIndex": 4, "layout": LAYOUT}, {"tableIndex": 1, "layout": {"nameColumn": 2}}], "source": "помощник"}
    markup = {"sheet": 1, "headerRow": 3, "columns": {"category": 2, "units": -1, "zone": 0}}
    body = {"norms": {}, "normsLayout": layout, "registryMarkup": markup}
    for document in (body, {"version": 1, "rules": body}):
        got = rule_files.parse_rules(_documents(spark, document))
        tables = got["norms_layout"].orderBy("list_pos").collect()
        assert [(t["table_idx"], t["header_row_count"], t["name_column"], t["unit_column"], t["mass_column"], t["mass_factor"], t["basis"]) for t in tables] == [
            (4, 1, 0, -1, 1, 1000.0, "place"), (1, -1, 2, -1, -1, None, None),
        ]
        one = got["registry_markup"].collect()
        assert [(m["table_idx"], m["header_row"], m["category"], m["units"], m["zone"], m["municipality"]) for m in one] == [(1, 3, 2, None, 0, None)]


def test_files_without_layouts_and_broken_ones(spark):
    got = rule_files.parse_rules(_documents(spark, {"registry": {"a": "b"}}, "no json", "", {"registryMarkup": {"sheet": 0}}, {"normsLayout": {"tables": []}}))
    assert got["norms_layout"].count() == 0 and got["registry_markup"].count() == 0
    assert [tuple(r) for r in got["registry"].collect()] == [("a", "b")]
    orders = _order(spark, ("a.docx", 0))
    assert rule_files.bind_norms_layout(got["norms_layout"], orders).count() == 0
    read = proposals.read_by_stored_layout(orders, rule_files.bind_norms_layout(got["norms_layout"], orders))
    assert {(r["name"], r["source"]) for r in read.collect()} == {(n, "detected") for n in ("Бани", "Кладбища", "Рынки")}


def test_both_layouts_survive_writing_and_reading(spark, tmp_path):
    layout = {"tables": [{"tableIndex": 4, "layout": LAYOUT}, {"tableIndex": 1, "layout": LAYOUT}], "source": "помощник"}
    markup = {"sheet": 0, "headerRow": 2, "columns": {"category": 1, "units": 0}, "source": "вручную"}
    first = rule_files.parse_rules(_documents(spark, {"registry": {"a": "b"}, "zones": {"z": ""}, "normsLayout": layout, "registryMarkup": markup}))
    rule_files.write_rules(first["norms"], first["registry"], first["zones"], str(tmp_path / "r"), first["norms_layout"], first["registry_markup"])
    again = rule_files.read_rule_lines(spark, str(tmp_path / "r"))
    for part in first:
        assert sorted(map(str, first[part].collect())) == sorted(map(str, again[part].collect())), part
    rule_files.write_rules(again["norms"], again["registry"], again["zones"], str(tmp_path / "s"), again["norms_layout"].limit(0), again["registry_markup"].limit(0))
    bare = rule_files.read_rule_lines(spark, str(tmp_path / "s"))
    assert bare["norms_layout"].count() == 0 and bare["registry_markup"].count() == 0 and bare["zones"].count() == 1


def test_stored_layout_counts_only_where_it_fits(spark):
    orders = _order(spark, ("fits.docx", 0), ("other.docx", 1), ("both.docx", 0), ("both.docx", 1))
    stored = rule_files.parse_rules(_documents(spark, {"normsLayout": {"tables": [{"tableIndex": 0, "layout": LAYOUT}]}}))["norms_layout"]
    read = proposals.read_by_stored_layout(orders, rule_files.bind_norms_layout(stored, orders)).collect()
    masses = {(r["file"], r["name"], r["source"]): r["mass"] for r in read}
    assert masses[("fits.docx", "Бани", "saved")] == 2500.0 and masses[("other.docx", "Бани", "detected")] == 2.5
    assert {(r["file"], r["source"], r["table_idx"]) for r in read} == {("fits.docx", "saved", 0), ("other.docx", "detected", 1), ("both.docx", "saved", 0)}
    two = rule_files.parse_rules(_documents(spark, {"normsLayout": {"tables": [{"tableIndex": t, "layout": LAYOUT} for t in (0, 1)]}}))["norms_layout"]
    read = proposals.read_by_stored_layout(orders, rule_files.bind_norms_layout(two, orders)).collect()
    assert {(r["file"], r["source"]) for r in read} == {("fits.docx", "detected"), ("other.docx", "detected"), ("both.docx", "saved")}


def test_layouts_that_read_nothing_are_told(spark):
    orders = _order(spark, ("a.docx", 0), ("a.docx", 1), ("a.docx", 2))
    given = spark.createDataFrame(
        [("a.docx", 0, 1, 0, -1, 1, -1), ("a.docx", 1, 9, 0, -1, 1, -1), ("a.docx", 2, 1, -1, -1, 1, -1), ("a.docx", 3, 1, 0, -1, 1, -1), ("b.docx", 0, 1, 0, -1, 1, -1)],
        LAYOUTS,
    )
    entries = norms.apply_layouts(orders, given)
    told = norms.layout_errors(orders, given.unionByName(given), entries)
    assert sorted(map(tuple, told.collect())) == [
        ("a.docx", 1, "nothing-read"), ("a.docx", 2, "nothing-read"), ("a.docx", 3, "no-table"), ("b.docx", 0, "no-table"),
    ]
    issues = checks.input_issues(spark.createDataFrame([("x.csv", "no-header")], "file string, reason string"), told).collect()
    assert {(i["code"], i["level"]) for i in issues} == {("unread-file", "error"), ("norm-layout", "error")}
    assert {i["note"] for i in issues} >= {"x.csv: no-header", "a.docx: 3: no-table"} and len(issues) == 5
    assert checks.input_issues(None, None) is None


def test_extracts_of_equal_names_in_two_folders(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "реестр.csv").write_text(f"Категория,Зона\n{folder},z\n", encoding="utf-8")
    grids = read_csv_extracts(spark, str(tmp_path / "x"), str(tmp_path / "y"), by_path=True)
    assert grids.select("file").distinct().count() == 2
    assert sorted((r["row_idx"], r["cells"][0]) for r in grids.collect()) == [(0, "Категория"), (0, "Категория"), (1, "x"), (1, "y")]


def test_csv_lines_read_back(spark):
    rows = [["a", 'с "кавычками"', "", "x,y"], ["", "b"], [None, "c"], ["один"]]
    frame = spark.createDataFrame([(r,) for r in rows], "cells array<string>").select(csv_cells(csv_line(F.col("cells"))).alias("c"))
    assert [r["c"] for r in frame.collect()] == [["a", 'с "кавычками"', "", "x,y"], ["", "b"], ["", "c"], ["один"]]


def test_figures_of_the_report_have_no_exponent(spark):
    frame = spark.createDataFrame([(1.5,), (100.0,), (0.0,), (123456789.25,), (None,), (-20.0,)], "v double")
    assert [r[0] for r in frame.select(report._plain("v", "double")).collect()] == ["1.5", "100", "0", "123456789.25", "", "-20"]
