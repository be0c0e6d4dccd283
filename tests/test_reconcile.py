"""The whole chain on a small form, and single operators on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import checks, match, measures, norms, proposals, registry, template
from ledgerfold.operators.grid import significant_rows, split_on_repeated_header
from ledgerfold.plans import report
from ledgerfold.plans.extracts import FORM_HEADER, FORM_META
from ledgerfold.plans.reconcile import Inputs, reconcile
from ledgerfold.sources.landing import GRID_SCHEMA, read_grids, report_tables, write_form, write_report
from ledgerfold.sources.rules import parse_rules

ZONE = "Вся территория"
FORM = [("Автомойка", "Квадратный метр"), ("Гостиницы", "Квадратный метр"), ("Индивидуальные жилые дома", "Человек"), ("Кладбища", "Квадратный метр")]
NORMS = [("Автомойка", "0,05227", "5,02154"), ("Гостиницы", "0,17807", "21,20018"), ("Жилые дома", "2,16418", "257,36")]
ROWS = [("Автомойка", "100"), ("Автомойка", "50.5"), ("Автомойка", "0"), ("Гостиницы", "200"), ("Индивидуальные жилые дома", "3"), ("Иная категория", "999")]
TITLE, NORM = "Наименование категории потребителей услуги", "Норматив накопления твердых коммунальных отходов"


def grid(spark, file, rows, table_idx=0, title=""):
    return spark.createDataFrame([(file, table_idx, title, i, [str(c) for c in r]) for i, r in enumerate(rows)], GRID_SCHEMA)


def norm_grid(rows, volume="куб.м в год", mass="кг в год"):
    return [[TITLE, NORM, NORM], [TITLE, volume, mass], *rows]


@pytest.fixture(scope="module")
def run(spark):
    form = [FORM_HEADER, *FORM_META, *[("Омская область", ZONE, "", c, u, *[""] * 6) for c, u in FORM]]
    extract = [("Категория потребителя", "Количество расчетных единиц", "Зона деятельности"), *[(c, u, ZONE) for c, u in ROWS]]
    return reconcile(
        Inputs(grid(spark, "Реестр.xlsx", extract), grid(spark, "form.xlsx", form, title="Общие сведения"), grid(spark, "order.docx", norm_grid(NORMS)))
    )


def test_form_is_read(run):
    rows = run.form_rows.orderBy("idx").collect()
    assert [r["excel_row"] for r in rows] == [4, 5, 6, 7]
    assert [r["category"] for r in rows] == [c for c, _ in FORM]


def test_zero_rows_are_no_sources_and_measures_come_from_exact_sums(run):
    wash = run.results.filter("category = 'Автомойка'").first()
    assert (wash["sources"], wash["units"], wash["zero_sources"], wash["registry_rows"]) == (2, 150.5, 1, 3)
    assert wash["mass"] == pytest.approx(5.02154 * 150.5 / 1000)
    assert wash["volume"] == pytest.approx(0.05227 * 150.5)
    written = report.filled_form(run).filter("category = 'Автомойка'").first()
    assert (written["units"], written["mass"], written["norm_mass"], written["registry_units"]) == (151, 0.76, 5.02154, None)


def test_category_without_data_gives_zeros(run):
    row = report.filled_form(run).filter("category = 'Кладбища'").first()
    assert (row["sources"], row["units"], row["mass"]) == (0, 0, 0)


def test_unmapped_category_is_reported_and_balances_hold(run):
    items = run.unassigned.collect()
    assert [(i["category"], i["reason"]) for i in items] == [("Иная категория", measures.NO_CATEGORY)]
    assert all(c["ok"] for c in run.checks.collect())
    assert run.issues.filter("code = 'unassigned' AND level = 'error'").count() == 1
    assert run.summary.first()["unassigned_groups"] == 1


def test_form_and_report_are_written_again_and_again(run, spark, tmp_path):
    for _ in range(2):
        write_form(run, str(tmp_path / "form"))
    assert spark.read.parquet(str(tmp_path / "form")).count() == len(FORM)
    files = spark.createDataFrame([("Реестр ИОО", "Реестр.xlsx")], "label string, name string")
    write_report(run, files, str(tmp_path / "report"))
    for name in report_tables(run, files):
        assert spark.read.parquet(str(tmp_path / "report" / name)).count() > 0


def test_unassigned_groups_are_merged_over_municipalities(spark):
    groups = spark.createDataFrame(
        [("з1", f"мо {m}", "иная", "Зона №1", m, "Иная категория", n, n, 0, u, True, 1) for m, n, u in
         (("Ровенский район", 11, 492.25), ("Перелюбский район", 9, 783.68), ("Городской округ Саратов", 101, 12803.47))],
        "zone_key string, municipality_key string, category_key string, zone string, municipality string, category string, "
        "n_rows long, sources long, zero_sources long, units double, units_known boolean, n_files long",
    )
    form = spark.createDataFrame([(4, 0, "", "Зона №1", "", "Гостиницы", "")], "excel_row long, idx long, subject string, zone string, municipality string, category string, unit string")
    target = "key string, template_key string"
    assigned = measures.assign_targets(groups, spark.createDataFrame([("з1", "зона 1")], target), spark.createDataFrame([("иная", None)], target), form)
    made_of = measures.parts(assigned)
    items = measures.unassigned(assigned, made_of, measures.targets(made_of), form).collect()
    assert len(items) == 1
    item = items[0]
    assert (item["n_rows"], round(item["units"], 2), item["sources"], item["n_groups"], item["n_municipalities"]) == (121, 14079.4, 121, 3, 3)
    nothing = spark.createDataFrame([], "key string, mode string, norm_mass double, norm_volume double, norm_error string")
    rows = measures.results(form, measures.targets(made_of), nothing)
    assert all(c["ok"] for c in checks.checks(checks.balance(groups, rows, measures.unassigned(assigned, made_of, measures.targets(made_of), form))).collect())


def test_registry_header_in_any_order(spark):
    found = registry.detect_columns(grid(spark, "a", [("Зона деятельности", "Количество расчетных единиц", "Категория потребителя"), (ZONE, 1, "Автомойка")])).first()
    assert (found["category"], found["units"], found["zone"], found["header_row"]) == (2, 1, 0, 0)


def test_extract_without_units_is_marked(spark):
    rows = grid(spark, "a", [("Муниципальное образование", "Категория потребителя", "Зона деятельности"), ("Округ", "Гостиницы", "Север")])
    layout = registry.layouts(rows)
    cube = registry.cube(registry.typed_rows(rows, layout))
    totals = registry.totals(cube, layout).first()
    assert (totals["has_units"], totals["rows_without_units"], totals["total_rows"]) == (False, 1, 1)
    group = registry.groups(cube).first()
    assert (group["sources"], group["units_known"], group["municipality"]) == (1, False, "Округ")


def test_candidates_respect_the_unit(spark):
    pool = spark.createDataFrame(
        [("a", "Жилые дома", "person", 0), ("b", "Жилые помещения в многоквартирных домах", "person", 1), ("c", "Гаражи, парковки закрытого типа", "sqm", 2)],
        "id string, name string, basis string, pos long",
    )
    names = spark.createDataFrame([("x", "Индивидуальные жилые дома", "person"), ("y", "Жилые дома", "sqm")], "key string, name string, basis string")
    found = match.rank_candidates(names, pool).collect()
    best = {r["key"]: r for r in found if r["rank"] == 1}
    assert best["x"]["id"] == "a"
    y = {r["id"]: r for r in found if r["key"] == "y"}
    assert y["a"]["basis_mismatch"] and y["a"]["score"] == pytest.approx(0.6)


def test_candidates_in_blocks_equal_brute_force(spark, monkeypatch):
    words = ["red", "blue", "green", "small", "large", "gear", "bolt", "ring", "plate", "anvil"]
    entries = [(f"p{i}", f"{words[i % 7]} {words[(i * 3) % 10]} {words[(i // 3) % 10]}", None, i) for i in range(60)]
    pool = spark.createDataFrame(entries, "id string, name string, basis string, pos long")
    names = spark.createDataFrame([(w, f"{w} {v}", None) for w, v in zip(words, words[3:] + words[:3])], "key string, name string, basis string")
    whole = {(r["key"], r["rank"]): (r["id"], round(r["score"], 9)) for r in match.rank_candidates(names, pool).collect()}
    monkeypatch.setattr(match, "POOL_BLOCK", 7)
    monkeypatch.setattr(match, "BROADCAST_POOL", 0)
    split = {(r["key"], r["rank"]): (r["id"], round(r["score"], 9)) for r in match.rank_candidates(names, pool).collect()}
    assert whole == split and len(whole) == 50
    from ledgerfold.functions.text import similarity

    pairs = names.alias("n").join(pool.alias("p"), F.lit(True)).select("n.key", "p.id", "p.name", "p.pos", similarity(F.col("n.name"), F.col("p.name")).alias("s"))
    for key in words:
        ranked = sorted((r for r in pairs.filter(F.col("key") == key).collect()), key=lambda r: (-r["s"], r["name"], r["pos"]))[:5]
        assert [whole[(key, k + 1)] for k in range(5)] == [(r["id"], round(r["s"], 9)) for r in ranked]


def test_form_categories_are_collected(spark):
    rows = spark.createDataFrame(
        [(0, "Автомойка", "", "Зона 1"), (1, "Автомойка", "Квадратный метр", "Зона 2"), (2, "Гостиницы", "Человек", "Зона 1")],
        "idx long, category string, unit string, zone string",
    )
    found = {r["category_key"]: r for r in template.template_categories(rows).collect()}
    assert (found["автомойка"]["n_rows"], found["автомойка"]["basis"], found["автомойка"]["n_zones"]) == (2, "sqm", 2)


def test_tonnes_and_units_columns(spark):
    tonnes = norms.read_norms(grid(spark, "a", norm_grid([("Гостиницы", "0,17807", "0,02120018")], mass="т в год"))).first()
    assert round(tonnes["mass"], 5) == 21.20018
    table = [[TITLE, "Расчетная единица", NORM, NORM], [TITLE, "Расчетная единица", "куб.м в год", "кг в год"], ["Жилые дома", "на 1 человека", "2,16418", "257,36"]]
    assert norms.read_norms(grid(spark, "b", table)).first()["basis"] == "person"


def test_table_whose_first_row_is_data(spark):
    found = norms.read_norms(grid(spark, "a", [("Гостиницы большие", "1,5 м3", "2 кг"), ("Кладбища", "2,5 м3", "3 кг"), ("Бани и сауны", "3,5 м3", "4 кг")])).collect()
    assert sorted((r["name"], r["mass"], r["volume"]) for r in found) == [("Бани и сауны", 4.0, 3.5), ("Кладбища", 3.0, 2.5)]


def test_repeated_header_splits_a_table(spark):
    rows = [["Наименование", "Расчетная единица", "куб.м в год", "кг в год"], ["Жилые дома", "на 1 человека", "2,16418", "257,36"],
            ["Наименование", "", "куб.м на 1 кв. метр в год", "т на 1 кв. метр в год"], ["Гостиницы", "", "0,17807", "0,02120"]]
    parts = split_on_repeated_header(grid(spark, "a", rows))
    assert parts.select("part").distinct().count() == 2
    tables = parts.select("file", F.col("part").alias("table_idx"), "title", F.col("part_row").alias("row_idx"), "cells")
    found = {r["name"]: r["mass"] for r in norms.read_norms(tables).collect()}
    assert found == {"Жилые дома": 257.36, "Гостиницы": 21.2}
    single = grid(spark, "b", [["Наименование", "куб.м в год", "кг в год"], ["Жилые дома", "2,1", "257,36"], ["Гостиницы", "0,1", "21,2"]])
    assert split_on_repeated_header(single).select("part").distinct().count() == 1


HOUSING = [[TITLE, "Расчетная единица", NORM, NORM], [TITLE, "Расчетная единица", "куб.м в год", "кг в год"],
           ["Жилые помещения в многоквартирных домах", "на 1 человека", "1,8555", "219,34"], ["Жилые дома", "на 1 человека", "2,16418", "257,36"]]
OTHER = norm_grid([("Автомойка", "0,05227", "5,02154"), ("Гостиницы", "0,17807", "21,20018"), ("Кладбища", "0,00291", "0,29775")], "куб.м на 1 кв. метр в год", "кг на 1 кв. метр в год")
PROPOSAL = "file string, table_idx int, item int, header_row_count int, name_column int, unit_column int, mass_column int, volume_column int, mass_unit string, volume_unit string, basis string"


@pytest.mark.parametrize(
    "changed, ok, problem, n",
    [
        ({}, True, None, 5),
        ({"mass_column": 7}, False, "no-mass-column", None),
        ({"mass_column": 0}, False, "mass-is-name", None),
        ({"mass_unit": "пудов в год"}, True, None, 5),
        ({"mass_unit": "т"}, False, "mass-unit-differs", None),
        ({"header_row_count": 99}, False, "header-too-deep", None),
        ({"table_idx": 1}, False, "table-twice", None),
        ({"table_idx": 9}, False, "no-table", None),
    ],
)
def test_norm_proposals(spark, changed, ok, problem, n):
    tables = grid(spark, "a", [["Список изменяющих документов"]]).unionByName(grid(spark, "a", HOUSING, 1, "Приложение 1")).unionByName(grid(spark, "a", OTHER, 2, "Приложение 2"))
    other = {"table_idx": 2, "item": 1, "header_row_count": 2, "name_column": 0, "unit_column": -1, "mass_column": 2, "volume_column": 1, "mass_unit": "кг", "volume_unit": "куб.м", "basis": "sqm", **changed}
    rows = [("a", 1, 0, 2, 0, 1, 3, 2, "кг в год", "куб.м в год", "person"), ("a", *[other[c] for c in PROPOSAL.replace(" int", "").replace(" string", "").split(", ")[1:]])]
    verdict, entries = proposals.validate_norm_proposals(tables, spark.createDataFrame(rows, PROPOSAL))
    found = verdict.first()
    assert (found["ok"], found["n"]) == (ok, n)
    assert ok or problem in found["problems"]
    if ok:
        read = {r["name"]: r for r in entries.collect()}
        assert (read["Автомойка"]["mass"], read["Автомойка"]["basis"], read["Жилые дома"]["basis"]) == (5.02154, "sqm", "person")


@pytest.mark.parametrize(
    "changed, problem",
    [({}, None), ({"category": 1, "units": 0}, "numeric-categories"), ({"zone": 9}, "no-column"), ({"zone": 0}, "column-twice"), ({"sheet": -1}, "no-sheet-proposed")],
)
def test_registry_proposals(spark, changed, problem):
    rows = grid(spark, "a", [("Категория потребителя", "Количество расчетных единиц", "Зона деятельности"), ("Гостиницы", "120", "Север")])
    given = {"sheet": 0, "header_row": 0, "category": 0, "units": 1, "zone": 2, "municipality": -1, "unit_name": -1, **changed}
    frame = spark.createDataFrame([("a", *given.values())], "file string, " + ", ".join(f"{c} int" for c in given))
    found = proposals.validate_registry_proposals(rows, frame).first()
    assert found["ok"] == (problem is None)
    assert problem is None or problem in found["problems"]
    if problem is None:
        assert (found["n_rows"], found["has_units"], found["n_category"]) == (1, True, 1)


def test_rules_stand_bare_or_wrapped(spark):
    texts = ['{"version":1,"rules":{"registry":{"a":"b"}}}', '{"zones":{"z":null},"norms":{"n":{"mode":"manual","manualMass":2}}}']
    parsed = parse_rules(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert [tuple(r) for r in parsed["registry"].collect()] == [("a", "b")]
    assert [tuple(r) for r in parsed["zones"].collect()] == [("z", None)]
    assert parsed["norms"].first()["manual_mass"] == 2.0


def test_extracts_are_read_together(spark, tmp_path):
    for name in ("a", "b"):
        grid(spark, name, [("Категория", "Зона"), ("Гостиницы", "Север")]).write.parquet(str(tmp_path / name))
    rows = read_grids(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    layout = registry.layouts(rows)
    assert registry.file_stats(registry.cube(registry.typed_rows(rows, layout)), layout).count() == 2


def test_files_without_rows_or_header_are_told(spark):
    header = ("Категория потребителя", "Зона деятельности")
    rows = grid(spark, "full", [header, ("Гостиницы", "Север")]).unionByName(grid(spark, "bare", [header])).unionByName(grid(spark, "none", [("x", "y"), ("1", "2")]))
    layout = registry.layouts(rows)
    cube = registry.cube(registry.typed_rows(rows, layout))
    stats = {r["file"]: (r["n_rows"], r["has_units"], r["warnings_total"]) for r in registry.file_stats(cube, layout).collect()}
    assert stats == {"full": (1, False, 0), "bare": (0, False, 0)}
    assert [tuple(r) for r in registry.unread_files(rows, layout).collect()] == [("none", "no-header", 2)]
    only = grid(spark, "bare", [header])
    assert not registry.totals(registry.cube(registry.typed_rows(only, registry.layouts(only))), registry.layouts(only)).first()["has_units"]


def test_blank_rows_do_not_count(spark):
    rows = significant_rows(grid(spark, "a", [("x",), (" ", ""), ("y",)])).orderBy("sig_idx").collect()
    assert [(r["row_idx"], r["sig_idx"]) for r in rows] == [(0, 0), (2, 1)]
