"""Checks that the filled form agrees with the registry and the rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.text import round_half_up
from ledgerfold.functions.units import unit_basis
from ledgerfold.operators.measures import KG_PER_TONNE
from ledgerfold.operators.relational import join_lookup

# --- fixed values: tolerances, levels and titles --------------------------------
TOLERANCE, DENSITY_TOLERANCE, BALANCE_TOLERANCE = 0.011, 0.02, 1e-6
ROUNDING = 1e-12  # of a total: sums of doubles added in another order differ by less
ISSUES = {
    "balance": ("error", "Расхождение с реестром"),
    "unassigned": ("error", "Данные реестра не попали в файл"),
    "duplicate": ("warning", "Повторяющаяся строка шаблона"),
    "formula": ("error", "Ошибка в формуле норматива"),
    "no-norm": ("error", "Нет норматива при наличии данных"),
    "half-norm": ("warning", "Норматив задан частично"),
    "unconfirmed": ("warning", "Сопоставление не подтверждено"),
    "basis": ("warning", "Разные расчётные единицы"),
    "arithmetic": ("error", "Ошибка расчёта"),
    "density": ("warning", "Плотность не сходится с массой и объёмом"),
    "no-units": ("error", "В реестре нет количества расчётных единиц"),
    "zero-sources": ("info", "Источники с нулевым количеством единиц"),
    # files and tables left out, where a single run would stop
    "unread-file": ("error", "Файл реестра не прочитан"),
    "norm-layout": ("error", "По разметке не прочитана таблица нормативов"),
}
UNITS_BALANCE = "Баланс расчётных единиц"
SOURCES_BALANCE = "Баланс количества источников"
SEVERITY = {"error": 0, "warning": 1, "info": 2}

_FIELDS = {
    "excel_row": "bigint",
    "zone": "string",
    "municipality": "string",
    "category": "string",
    "note": "string",
    "n_rows": "bigint",
    "units": "double",
    "sources": "bigint",
    "actual": "double",
    "expected": "double",
}


def _issue(code: str, **values: Column) -> Column:
    level, title = ISSUES[code]
    order = list(ISSUES).index(code)
    given = [F.coalesce(values[f]).cast(t).alias(f) if f in values else F.lit(None).cast(t).alias(f) for f, t in _FIELDS.items()]
    return F.struct(
        F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(title).alias("title"), F.lit(order).alias("stage"), *given
    )


def _one(frame: DataFrame, issue: Column) -> DataFrame:
    return frame.select(issue.alias("i")).select("i.*")


def balance(groups: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """Units and sources in the registry, in the form and outside it (one row)."""

    def sums(frame: DataFrame, side: str) -> DataFrame:
        return frame.agg(
            F.lit(side).alias("side"),
            # added as decimals: the same in any order of rows
            F.coalesce(F.sum(F.col("units").cast("decimal(38,9)")).cast("double"), F.lit(0.0)).alias("units"),
            F.coalesce(F.sum("sources"), F.lit(0)).alias("sources"),
        )

    sides = sums(groups, "registry").unionByName(sums(rows, "form")).unionByName(sums(items, "outside"))
    return sides.agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(measure))).alias(f"{side}_{measure}")
            for side in ("registry", "form", "outside")
            for measure in ("units", "sources")
        ]
    )


def _units_agree(difference: Column) -> Column:
    """Within the tolerance, and within what doubles of the registry's size can tell."""
    return F.abs(difference) < F.lit(BALANCE_TOLERANCE) + F.abs(F.col("registry_units")) * ROUNDING


def _deltas() -> tuple[Column, Column]:
    units = round_half_up(F.col("registry_units") - F.col("form_units") - F.col("outside_units"), 6)
    return units, F.col("registry_sources") - F.col("form_sources") - F.col("outside_sources")


def checks(totals: DataFrame) -> DataFrame:
    units, sources = _deltas()
    of_units = F.struct(
        F.lit(UNITS_BALANCE).alias("name"),
        round_half_up(F.col("registry_units"), 2).alias("expected"),
        round_half_up(F.col("form_units") + F.col("outside_units"), 2).alias("actual"),
        _units_agree(units).alias("ok"),
    )
    of_sources = F.struct(
        F.lit(SOURCES_BALANCE).alias("name"),
        F.col("registry_sources").cast("double").alias("expected"),
        (F.col("form_sources") + F.col("outside_sources")).cast("double").alias("actual"),
        (sources == 0).alias("ok"),
    )
    return totals.select(F.explode(F.array(of_units, of_sources)).alias("c")).select("c.*")


def balance_issues(totals: DataFrame) -> DataFrame:
    units, sources = _deltas()
    off = totals.filter(~_units_agree(units) | (sources != 0))
    issue = _issue(
        "balance",
        expected=F.col("registry_units"),
        actual=F.col("form_units") + F.col("outside_units"),
        sources=F.col("registry_sources"),
    )
    return _one(off, issue)


def unassigned_issues(items: DataFrame) -> DataFrame:
    issue = _issue(
        "unassigned",
        zone=F.col("zone"),
        municipality=F.col("municipality"),
        category=F.col("category"),
        note=F.col("reason"),
        n_rows=F.col("n_rows"),
        units=F.col("units"),
        sources=F.col("sources"),
    )
    return _one(items, issue)


def row_issues(rows: DataFrame, mapping: DataFrame, norms: DataFrame) -> DataFrame:
    """All checks of single form rows in one pass over the results."""
    entries = norms.select(F.col("id").alias("entry_id"), F.col("name").alias("entry_name"), F.col("basis").alias("entry_basis"))
    chosen = mapping.join(entries, "entry_id", "left").select(
        F.col("key").alias("category_key"),
        F.col("mode").alias("m_mode"),
        F.col("status").alias("m_status"),
        F.col("auto").alias("m_auto"),
        F.col("score").alias("m_score"),
        F.col("entry_id").alias("m_entry"),
        F.coalesce("entry_name", "entry_id").alias("m_entry_name"),
        F.col("entry_basis").alias("m_basis"),
    )
    rows = join_lookup(rows, chosen, ["category_key"], "left")
    where = {c: F.col(c) for c in ("excel_row", "zone", "municipality", "category")}
    units = F.col("units")
    has_data = (units > 0) | (F.col("sources") > 0)
    no_mass, no_volume = F.col("norm_mass").isNull(), F.col("norm_volume").isNull()

    def zero_if_null(value: Column, digits: int) -> Column:
        return F.coalesce(round_half_up(value, digits), F.lit(0.0))

    mass, volume = zero_if_null(F.col("mass"), 2), zero_if_null(F.col("volume"), 2)
    want_mass = zero_if_null(F.col("norm_mass") * units / KG_PER_TONNE, 2)
    want_volume = zero_if_null(F.col("norm_volume") * units, 2)
    density = zero_if_null(F.col("density"), 2)
    want_density = zero_if_null(F.try_divide(mass, volume), 2)
    counted = ~(no_mass & no_volume) & (units > 0)
    form_basis = unit_basis(F.col("unit"))
    wrong_basis = (
        (F.col("m_mode") == "single")
        & form_basis.isNotNull()
        & (F.coalesce("m_basis", F.lit("other")) != "other")
        & (F.col("m_basis") != form_basis)
    )
    found = F.array(
        F.when(F.col("duplicate"), _issue("duplicate", **where)),
        F.when(F.col("norm_error").isNotNull(), _issue("formula", note=F.col("norm_error"), **where)),
        F.when(no_mass & no_volume & has_data, _issue("no-norm", units=units, **where)),
        F.when(no_mass != no_volume, _issue("half-norm", note=F.when(no_mass, "volume").otherwise("mass"), **where)),
        F.when(
            F.col("m_auto") & (F.col("m_status") == "weak") & F.col("m_entry").isNotNull(),
            _issue("unconfirmed", note=F.col("m_entry_name"), actual=F.col("m_score"), **where),
        ),
        F.when(wrong_basis, _issue("basis", note=F.col("m_basis"), **where)),
        F.when(
            counted & ((F.abs(mass - want_mass) > TOLERANCE) | (F.abs(volume - want_volume) > TOLERANCE)),
            _issue("arithmetic", actual=mass, expected=want_mass, **where),
        ),
        F.when(
            counted & (volume > 0) & (F.abs(density - want_density) > DENSITY_TOLERANCE),
            _issue("density", actual=density, expected=want_density, **where),
        ),
    )
    return rows.select(F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i")).select("i.*")


def registry_issues(totals: DataFrame) -> DataFrame:
    no_units = _one(totals.filter(~F.col("has_units")), _issue("no-units", n_rows=F.col("total_rows")))
    zeros = _one(totals.filter("zero_rows > 0"), _issue("zero-sources", n_rows=F.col("zero_rows")))
    return no_units.unionByName(zeros)


def input_issues(unread: DataFrame | None, layout_errors: DataFrame | None) -> DataFrame | None:
    """Files of the registry and tables of the order that were left out."""
    found = []
    if unread is not None:
        found.append(_one(unread, _issue("unread-file", note=F.concat_ws(": ", "file", "reason"))))
    if layout_errors is not None:
        note = F.concat_ws(": ", "file", F.col("table_idx").cast("string"), "reason")
        found.append(_one(layout_errors, _issue("norm-layout", note=note)))
    return reduce(DataFrame.unionByName, found) if found else None


def all_issues(
    balance_totals: DataFrame,
    items: DataFrame,
    rows: DataFrame,
    mapping: DataFrame,
    norms: DataFrame,
    totals: DataFrame,
    unread: DataFrame | None = None,
    layout_errors: DataFrame | None = None,
) -> DataFrame:
    of_inputs = input_issues(unread, layout_errors)
    found = (
        balance_issues(balance_totals)
        .unionByName(unassigned_issues(items))
        .unionByName(row_issues(rows, mapping, norms))
        .unionByName(registry_issues(totals))
    )
    return found if of_inputs is None else found.unionByName(of_inputs)


def by_severity(issues: DataFrame) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("level") == level, n) for level, n in SEVERITY.items()])
    return issues.orderBy(rank, "stage", "excel_row", F.desc("units"))


def summary(rows: DataFrame, items: DataFrame, issues: DataFrame, totals: DataFrame, categories: DataFrame) -> DataFrame:
    """Figures of the run (one row); the mean density is that of the rounded sums."""
    has_data = (F.col("units") > 0) | (F.col("sources") > 0)
    of_rows = rows.agg(
        F.count("*").alias("template_rows"),
        F.count_if(has_data).alias("rows_with_data"),
        F.count_if(~has_data).alias("rows_empty"),
        F.count_if(F.col("norm_mass").isNull() & F.col("norm_volume").isNull()).alias("rows_without_norm"),
        F.coalesce(F.sum("sources"), F.lit(0)).alias("total_sources"),
        F.coalesce(F.sum("units"), F.lit(0.0)).alias("units"),
        F.coalesce(F.sum(round_half_up(F.col("mass"), 2)), F.lit(0.0)).alias("mass"),
        F.coalesce(F.sum(round_half_up(F.col("volume"), 2)), F.lit(0.0)).alias("volume"),
    )
    # One-row frames are read as scalar subqueries, so nothing is crossed.
    one = lambda frame, value: frame.agg(value.alias("v")).scalar()
    figure = lambda column: totals.select(column).scalar()
    return of_rows.select(
        "template_rows",
        "rows_with_data",
        "rows_empty",
        "rows_without_norm",
        figure("total_rows").alias("registry_rows"),
        figure("zero_rows").alias("registry_zero_rows"),
        one(categories, F.count("*")).alias("registry_categories"),
        "total_sources",
        round_half_up(F.col("units"), 2).alias("total_units"),
        round_half_up(F.col("mass"), 2).alias("total_mass"),
        round_half_up(F.col("volume"), 2).alias("total_volume"),
        round_half_up(F.try_divide("mass", "volume"), 3).alias("average_density"),
        one(items, F.coalesce(F.sum("n_groups"), F.lit(0))).alias("unassigned_groups"),
        one(issues, F.count_if(F.col("level") == "error")).alias("errors"),
        one(issues, F.count_if(F.col("level") == "warning")).alias("warnings"),
    )
