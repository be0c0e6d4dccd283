"""Code-to-label lookups used by the report tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerfold.functions.units import BASIS_LABELS

# --- fixed values: report labels --------------------------------------------
STATUS_LABELS = {
    "exact": "Точное совпадение",
    "auto": "Сопоставлено автоматически",
    "weak": "Похоже, требует проверки",
    "none": "Не найдено",
    "manual": "Задано вручную",
    "formula": "Формула",
    "ignored": "Исключено вручную",
}
MODE_LABELS = {
    "single": "Прямое соответствие",
    "formula": "Формула",
    "manual": "Значения вручную",
    "none": "Не сопоставлено",
    "ignored": "Исключено",
}
LEVEL_LABELS = {"error": "Ошибка", "warning": "Предупреждение", "info": "Информация"}


def _lookup(labels: dict[str, str], code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    return F.try_element_at(table, F.coalesce(code, F.lit("")))


def basis_label(code: Column) -> Column:
    return F.coalesce(_lookup(BASIS_LABELS, code), code)


def status_label(code: Column) -> Column:
    return _lookup(STATUS_LABELS, code)


def mode_label(code: Column) -> Column:
    return F.coalesce(_lookup(MODE_LABELS, code), F.lit(MODE_LABELS["none"]))


def level_label(code: Column) -> Column:
    return F.coalesce(_lookup(LEVEL_LABELS, code), code)


def percent(score: Column) -> Column:
    """Whole percents for display; an unknown score shows nothing."""
    return F.when(score.isNotNull(), F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit(" %"))).otherwise("")
