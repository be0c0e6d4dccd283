"""Units of measure: what a norm is counted per, and conversion factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerfold.functions.text import WS, let, normalize, strip

# --- fixed values: word beginnings and whole words of each kind of unit -----
PERSON_OR_PLACE = (
    "человек", "чел", "проживающ", "жител", "учащ", "воспитанник", "сотрудник",
    "работник", "посадочн", "койк", "мест", "участник", "член", "абонент", "посетител",
)
BED, PLACE = ("койк",), ("мест",)
HUMAN = ("человек", "чел")
SQUARE_WORDS = ("м2", "кв", "квадратный", "квадратных", "квадратном")
SQUARE = ("квадратн",)
AREA, METRE = ("площад",), ("метр", "м2", "м")
RUNNING = ("погонн",)
PLOT_WORDS, PLOT = ("участок", "участка", "участке", "участки", "участков"), ("надел",)
KILOGRAM_WORDS, KILOGRAM = ("кг",), ("килограмм",)
TONNE_WORDS, TONNE = ("т",), ("тонн",)
GRAM_WORDS, GRAM = ("г",), ("грамм",)
CUBIC_WORDS, CUBIC = ("куб", "м3", "кубм"), ("кубическ", "кубометр")
LITRE_WORDS, LITRE = ("л",), ("литр",)
CUBIC_SIGN = "м\\s*[3³]"

# --- fixed values: labels of the kinds of unit ------------------------------
BASIS_LABELS = {
    "person": "на 1 человека",
    "place": "на 1 место",
    "sqm": "на 1 м²",
    "linear": "на 1 пог. м",
    "plot": "на 1 участок",
    "other": "иная",
}


def _word(key: Column, options: tuple[str, ...]) -> Column:
    return key.rlike("(?:^| )(?:%s)(?: |$)" % "|".join(options))


def _begins(key: Column, options: tuple[str, ...]) -> Column:
    return key.rlike("(?:^| )(?:%s)" % "|".join(options))


def _basis_of_key(key: Column) -> Column:
    is_place = _begins(key, BED) | (_begins(key, PLACE) & ~_begins(key, HUMAN))
    return (
        F.when(key == "", F.lit(None).cast("string"))
        .when(_begins(key, PERSON_OR_PLACE), F.when(is_place, F.lit("place")).otherwise(F.lit("person")))
        .when(_word(key, SQUARE_WORDS) | _begins(key, SQUARE), F.lit("sqm"))
        .when(_begins(key, AREA) & _begins(key, METRE), F.lit("sqm"))
        .when(_begins(key, RUNNING), F.lit("linear"))
        .when(_word(key, PLOT_WORDS) | _begins(key, PLOT), F.lit("plot"))
        .otherwise(F.lit("other"))
    )


def _mass_of_key(key: Column) -> Column:
    return (
        F.when(_word(key, KILOGRAM_WORDS) | _begins(key, KILOGRAM), F.lit(1.0))
        .when(_word(key, TONNE_WORDS) | _begins(key, TONNE), F.lit(1000.0))
        .when(_word(key, GRAM_WORDS) | _begins(key, GRAM), F.lit(0.001))
    )


def _volume_of_key(key: Column) -> Column:
    return (
        F.when(_word(key, CUBIC_WORDS) | _begins(key, CUBIC), F.lit(1.0))
        .when(_word(key, LITRE_WORDS) | _begins(key, LITRE), F.lit(0.001))
    )


def _signed_cubic(header: Column) -> Column:
    return F.lower(F.coalesce(header, F.lit(""))).rlike(CUBIC_SIGN)


def unit_basis(value: Column) -> Column:
    """person / place / sqm / linear / plot / other, or null for empty text."""
    return let(normalize(value), _basis_of_key)


def mass_factor(header: Column) -> Column:
    """Factor to kilograms, null when the text names no unit of mass."""
    return let(normalize(header), _mass_of_key)


def volume_factor(header: Column) -> Column:
    """Factor to cubic metres, null when the text names no unit of volume."""
    return F.when(_signed_cubic(header), F.lit(1.0)).otherwise(let(normalize(header), _volume_of_key))


def is_volume_header(header: Column) -> Column:
    return volume_factor(header).isNotNull()


def is_mass_header(header: Column) -> Column:
    return mass_factor(header).isNotNull() & volume_factor(header).isNull()


# A measure starts with its number; only ordinary spaces group the digits.
_LEADING_NUMBER = rf"""^(?:{WS}|[("'«])*([+-]?\d[\d ]*(?:[.,]\d+)?)"""
# A slash parts the dimension from what it is counted per.  The words need a
# Latin letter or digit right before them, as a word boundary there is ASCII.
_PER = rf"{WS}*(?:/|(?<=[A-Za-z0-9_])[нз]а{WS}+1(?![A-Za-z0-9_])){WS}*"


def is_measure(value: Column) -> Column:
    """Whether a cell reads as a measure (its number leads the text)."""
    return strip(value).rlike(_LEADING_NUMBER)


def _with_sides(number: Column, tail: Column, sides: Column) -> Column:
    per = F.coalesce(F.get(sides, 1), F.lit(""))
    dimension = F.coalesce(F.get(sides, 0), F.lit(""))
    factors = F.struct(mass_factor(dimension).alias("mass"), volume_factor(dimension).alias("volume"))
    return let(
        factors,
        lambda f: F.struct(
            number.alias("value"),
            F.when(f["volume"].isNotNull(), F.lit("volume")).when(f["mass"].isNotNull(), F.lit("mass")).alias("kind"),
            F.coalesce(f["volume"], f["mass"]).alias("factor"),
            F.nullif(unit_basis(F.when(per != "", per).otherwise(tail)), F.lit("other")).alias("basis"),
            strip(tail).alias("unit_text"),
        ),
    )


def parse_measure(value: Column) -> Column:
    """'2,073 м3/1 человека' as struct(value, kind, factor, basis, unit_text)."""

    def of_number(raw: Column, number: Column) -> Column:
        measure = let(
            F.regexp_replace(raw, _LEADING_NUMBER, ""),
            lambda tail: let(F.split(tail, _PER, -1), lambda sides: _with_sides(number, tail, sides)),
        )
        return F.when(F.abs(number) < F.lit(float("inf")), measure)

    def of_text(raw: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(raw, _LEADING_NUMBER, 1), " ", "")
        number = F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")
        return F.when(raw.rlike(_LEADING_NUMBER), let(number, lambda n: of_number(raw, n)))

    return let(strip(value), of_text)
