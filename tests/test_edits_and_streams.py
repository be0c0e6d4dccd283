"""Edits laid over a finished run, and registry rows that come in batches."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerfold.plans import queries_rules
from ledgerfold.operators import registry
from ledgerfold.plans.edits import Edited, Edits
from ledgerfold.plans.extracts import FORM_HEADER, FORM_META
from ledgerfold.plans.reconcile import Inputs, reconcile
from ledgerfold.plans.report import filled_form
from ledgerfold.sources.landing import GRID_SCHEMA
from ledgerfold.streaming.accumulate import compact, current_cube
from ledgerfold.streaming.reconciled import forms, reconcile_stream

ZONES = ("Север", "Юг")
FORM = [("Автомойка", "Квадратный метр"), ("Гостиницы", "Квадратный метр"), ("Кладбища", "Квадратный метр")]
NORMS = [("Автомойка", "0,05", "5,5"), ("Гостиницы", "0,25", "20"), ("Кладбища", "0,5", "2")]
ROWS = [("Автомойка", "100", "Север"), ("Автомойка", "50", "Юг"), ("Гостиницы", "200", "Север"), ("Иное", "7", "Юг"), ("АВТОМОЙКА ", "1", "Север"), ("Кладбища", "3", "Юг")]
NAME, NORM = "Наименование категории потребителей услуги", "Норматив накопления твердых коммунальных отходов"
NORM_RULE = "key string, mode string, entry_name string, expression string, manual_mass double, manual_volume double"
TARGET = "key string, template_key string"
LOG = ", edit int, reset boolean"


def grid(spark, file, rows, title=""):
    return spark.createDataFrame([(file, 0, title, i, [str(c) for c in r]) for i, r in enumerate(rows)], GRID_SCHEMA)


def inputs(spark, **rules):
    form = [FORM_HEADER, *FORM_META, *[("Омская область", z, "", c, u, *[""] * 6) for z in ZONES for c, u in FORM]]
    extract = [("Категория потребителя", "Количество расчетных единиц", "Зона деятельности"), *ROWS]
    order = [[NAME, NORM, NORM], [NAME, "куб.м в год", "кг в год"], *NORMS]
    return Inputs(grid(spark, "r.xlsx", extract), grid(spark, "form.xlsx", form, "Общие сведения"), grid(spark, "order.docx", order), **rules)


@pytest.fixture(scope="module")
def run(spark):
    return reconcile(inputs(spark))


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def norm_log(spark, *edits):
    return spark.createDataFrame(list(edits), NORM_RULE + LOG)


def target_log(spark, *edits):
    return spark.createDataFrame(list(edits), TARGET + LOG)


def test_edits_equal_a_run_with_the_rules(spark, run):
    manual = ("гостиницы", "manual", None, None, 1.5, 2.5)
    edited = Edited(
        run,
        Edits(
            norms=norm_log(spark, ("гостиницы", "none", None, None, None, None, 1, False), (*manual, 2, False)),
            categories=target_log(spark, ("иное", "кладбища", 1, False)),
            zones=target_log(spark, ("юг", "север", 1, False)),
        ),
    )
    whole = reconcile(
        inputs(
            spark,
            norm_rules=spark.createDataFrame([manual], NORM_RULE),
            category_rules=spark.createDataFrame([("иное", "кладбища")], TARGET),
            zone_rules=spark.createDataFrame([("юг", "север")], TARGET),
        )
    )
    columns = whole.results.columns
    assert rows_of(edited.results.select(columns)) == rows_of(whole.results)
    assert rows_of(edited.unassigned) == rows_of(whole.unassigned)
    assert rows_of(edited.category_mapping) == rows_of(whole.category_mapping)


def test_only_reached_rows_are_worked_out_again(spark, run):
    moved = Edited(run, Edits(categories=target_log(spark, ("иное", "кладбища", 1, False))))
    assert moved.reached_groups.select("category_key").collect() == [("иное",)]
    assert [tuple(r) for r in moved.reached_rows.select("zone_key", "category_key").collect()] == [("юг", "кладбища")]
    assert moved.results.filter("zone_key = 'юг' AND category_key = 'кладбища'").first()["units"] == 10
    priced = Edited(run, Edits(norms=norm_log(spark, ("автомойка", "manual", None, None, 1000.0, 1.0, 1, False))))
    assert priced.reached_groups.isEmpty()
    assert {(r["zone_key"], r["mass"]) for r in priced.results.filter("category_key = 'автомойка'").collect()} == {("север", 101.0), ("юг", 50.0)}


def test_edits_over_edits_and_resets_lead_back(spark, run):
    out = Edited(run, Edits(categories=target_log(spark, ("гостиницы", "", 1, False)), zones=target_log(spark, ("юг", "", 1, False))))
    assert out.results.agg(F.sum("units")).first()[0] == 101
    back = Edited(out, Edits(categories=target_log(spark, ("гостиницы", None, 2, True)), zones=target_log(spark, ("юг", None, 2, True))))
    assert rows_of(back.results.select(run.results.columns)) == rows_of(run.results)
    assert rows_of(Edited(run, Edits()).results.select(run.results.columns)) == rows_of(run.results)


def test_unknown_and_empty_edits_change_nothing(spark, run):
    edits = Edits(norms=norm_log(spark), categories=target_log(spark, ("нет такой", "кладбища", 1, False)), zones=target_log(spark))
    edited = Edited(run, edits)
    assert edited.reached_rows.isEmpty()
    assert rows_of(edited.results.select(run.results.columns)) == rows_of(run.results)


def test_stream_fills_the_form_and_compacts(spark, run, tmp_path):
    rows = registry.typed_rows(run.inputs.registry, run.registry_layout)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    reconcile_stream(stream, reconcile(inputs(spark)), str(tmp_path), every=2).awaitTermination()
    filled = forms(spark, str(tmp_path))
    assert sorted(filled) == [0, 1, 2]
    assert rows_of(filled[2]) == rows_of(filled_form(run))
    table = f"{tmp_path}/cube"
    assert os.listdir(f"{table}/changes") == ["batch=2"] and os.listdir(f"{table}/base") == ["version=1"]
    fields = run.cube.columns
    assert rows_of(current_cube(spark, table).select(fields)) == rows_of(run.cube)

    compact(spark, table, 2)
    assert os.listdir(f"{table}/changes") == [] and sorted(os.listdir(f"{table}/base")) == ["version=1", "version=2"]
    assert rows_of(current_cube(spark, table).select(fields)) == rows_of(run.cube)
    # a batch told again after its compaction, and a base that was left half written
    run.cube.limit(0).write.parquet(f"{table}/changes/batch=2")
    os.makedirs(f"{table}/base/version=3")
    compact(spark, table, 2)
    assert rows_of(current_cube(spark, table).select(fields)) == rows_of(run.cube)


def test_a_table_without_batches_is_told(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        current_cube(spark, f"{tmp_path}/none")


def test_later_batches_match_new_names_only(spark, run):
    first = reconcile(inputs(spark)).over(run.cube.filter("category <> 'Иное'"))
    known = first.category_candidates.select("key", F.lit("known").alias("name"), "rank", "id", "basis", "score", "raw_score", "basis_mismatch")
    first.category_candidates = known.select(first.category_candidates.columns)
    then = first.over(run.cube)
    assert {r["key"] for r in then.category_candidates.filter("name = 'known'").collect()} == {"автомойка", "гостиницы", "кладбища"}
    assert {r["key"] for r in then.category_candidates.filter("name <> 'known'").collect()} == {"иное"}


def test_rows_of_a_stream_are_worked_out_once(spark, tmp_path):
    """Asking for the number of partitions ran what stands before the last shuffle a second time."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 600, 1, 2).mapInArrow(counted, "id bigint").repartition("id")
    stream = queries_rules._in_thirds(rows, str(tmp_path / "in"))
    sizes = []
    query = stream.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count())).option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert seen.value == 600 and len(sizes) == 3 and sum(sizes) == 600
