"""Goldens of the scalar functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import cellrefs, labels, text, units
from ledgerfold.operators import formula


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalize(spark):
    assert value(spark, text.normalize(F.lit("Мастерские по ремонту обуви, ключей, часов и пр."))) == (
        "мастерские по ремонту обуви ключей часов и пр"
    )
    assert value(spark, text.normalize(F.lit("Ёлочный  базар"))) == "елочный базар"
    assert value(spark, text.normalize(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(
    "cell, number",
    [
        ("0,08457", 0.08457), ("1 234,5", 1234.5), ("7,22619 <*>", 7.22619), ("кг на 1 кв. метр в год", None),
        ("куб.м в год", None), ("", None), ("—", None), ("12.", 12.0), (".5", 0.5), ("1e3", 1000.0), ("5d", None),
        ("1e999", None), ("1 234", 1234.0), ("1,2,3", None), ("-7", -7.0), (None, None),
    ],
)
def test_parse_number(spark, cell, number):
    assert value(spark, text.parse_number(F.lit(cell).cast("string"))) == number


def test_tokens_drop_endings_and_stop_words(spark):
    first = value(spark, text.tokens(F.lit("Организации, оказывающие ритуальные услуги")))
    assert first == value(spark, text.tokens(F.lit("Организация, оказывающая ритуальные услуги")))


@pytest.mark.parametrize(
    "a, b, least, most",
    [
        ("Автомойка", "Автомойка", 1, 1),
        ("Организация, оказывающая ритуальные услуги", "Организации, оказывающие ритуальные услуги", 0.95, 1),
        ("Мастерские по ремонту обуви, ключей, часов и пр.", "Мастерские по ремонту обуви, ключей, часов и прочие", 0.95, 1),
        ("Жилые помещения в многоквартирном доме", "Жилые помещения в многоквартирных домах", 0.85, 1),
        ("Автомойка", "Кладбища", 0, 0.3),
        ("", "Кладбища", 0, 0),
    ],
)
def test_similarity(spark, a, b, least, most):
    assert least <= value(spark, text.similarity(F.lit(a), F.lit(b))) <= most


def test_units(spark):
    mass = lambda t: value(spark, units.mass_factor(F.lit(t)))
    volume = lambda t: value(spark, units.volume_factor(F.lit(t)))
    assert (mass("Норматив накопления ТКО кг в год"), mass("Норматив накопления ТКО, т в год"), mass("куб.м в год")) == (1, 1000, None)
    assert (volume("куб.м на 1 кв. метр в год"), volume("м³ в год"), volume("кг на 1 кв. метр в год")) == (1, 1, None)
    assert value(spark, units.is_mass_header(F.lit("кг на 1 кв. метр в год")))
    assert not value(spark, units.is_mass_header(F.lit("куб.м в год")))
    basis = lambda t: value(spark, units.unit_basis(F.lit(t)))
    assert [basis(t) for t in ("Человек", "на 1 человека", "Квадратный метр", "кг на 1 кв. метр в год", "")] == [
        "person", "person", "sqm", "sqm", None,
    ]


@pytest.mark.parametrize(
    "cell, number, kind, factor, basis",
    [
        ("2,073 м3/1 проживающего человека в год", 2.073, "volume", 1, "person"),
        ("0,247027 тонн/1 проживающего человека в год", 0.247027, "mass", 1000, "person"),
        ("0,341 м3/1 место в год", 0.341, "volume", 1, "place"),
        ("0,319 м3/1 м2 общей площади в год", 0.319, "volume", 1, "sqm"),
        ("0,012 м3/1 метр общей площади в год", 0.012, "volume", 1, "sqm"),
        ("2,360 м3/1 участник (член) в год", 2.36, "volume", 1, "person"),
        ("0,08457", 0.08457, None, None, None),
    ],
)
def test_parse_measure(spark, cell, number, kind, factor, basis):
    m = value(spark, units.parse_measure(F.lit(cell)))
    assert (m["value"], m["kind"], m["factor"], m["basis"]) == (number, kind, factor, basis)


@pytest.mark.parametrize("cell", ["куб.м на 1 кв. метр в год", "кг в год", "-", "", "Норматив накопления твердых отходов"])
def test_headers_are_no_measures(spark, cell):
    assert value(spark, units.parse_measure(F.lit(cell))) is None


def test_rounding(spark):
    rounded = lambda x, d: value(spark, text.round_half_up(F.lit(x).cast("double"), d))
    assert (rounded(1.005, 2), rounded(2.675, 2), rounded(1051527.6, 0), rounded(-2.5, 0), rounded(None, 2)) == (
        1.01, 2.68, 1051528, -3, None,
    )


def test_line_and_word_joining(spark):
    lines = lambda *parts: value(spark, text.join_lines(F.array(*map(F.lit, parts))))
    assert lines("торгово-", "развлекательные комплексы") == "торгово-развлекательные комплексы"
    assert lines("культурно -", "развлекательные") == "культурно - развлекательные"
    assert lines("Жилые помещения в", "многоквартирных домах") == "Жилые помещения в многоквартирных домах"
    words = lambda *parts: value(spark, text.join_words(F.array(*map(F.lit, parts))))
    assert words("Кафе", ",", "бары", ",", "столовые") == "Кафе, бары, столовые"
    assert words("магазины", "(", "оптика", ")") == "магазины (оптика)"


def test_cell_references(spark):
    assert tuple(value(spark, cellrefs.parse_ref(F.lit("ab12")))) == (28, 12)
    assert value(spark, cellrefs.column_letter(F.lit(28))) == "AB"
    assert value(spark, cellrefs.make_ref(F.lit(703), F.lit(5))) == "AAA5"
    assert value(spark, cellrefs.parse_ref(F.lit("1a"))) is None


def test_labels(spark):
    assert value(spark, labels.basis_label(F.lit("sqm"))) == "на 1 м²"
    assert value(spark, labels.mode_label(F.lit(None).cast("string"))) == "Не сопоставлено"
    assert value(spark, labels.percent(F.lit(0.855))) == "86 %"


@pytest.mark.parametrize(
    "expression, result",
    [
        ("[n1] + [n2]", 14), ("[n1] - [n2]", 6), ("0,5*[n1]", 5), ("([n1] + [n2]) / 2", 7), ("[n1] + [n3]", None),
        ("2 - 3 - 4", -5), ("-2*-3", 6), ("8 / 2 / 2", 2), ("2+3*4", 14),
    ],
)
def test_formula_values(spark, expression, result):
    assert evaluated(spark, [expression], {"n1": 10.0, "n2": 4.0, "n3": None}) == [(result, None)]


@pytest.mark.parametrize(
    "expression, error",
    [
        ("[n1] +", formula.BREAKS_OFF), ("[n1] / 0", formula.ZERO_DIVISION), ("5 / [n3]", formula.ZERO_DIVISION),
        ("alert(1)", "Непонятный символ в позиции 1: «a»"), ("", formula.EMPTY), ("(1", formula.UNCLOSED),
        ("1 2 3", "Лишний фрагмент: «2 3»"), ("*1", "Не число: «*»"),
    ],
)
def test_formula_errors(spark, expression, error):
    assert evaluated(spark, [expression], {"n1": 10.0, "n3": None}) == [(None, error)]


def climbed(text, known):
    """Precedence climbing, one formula at a time: value and error."""
    rest, at, missing = [], 0, False
    shape, priority = re.compile(r"\s*" + formula.TOKEN), {"+": 1, "-": 1, "*": 2, "/": 2}
    while (text or "")[at:].strip():
        match = shape.match(text, at)
        if match is None:
            return None, formula.UNKNOWN_SIGN % (at + 1, text[at])
        rest.insert(0, match.group(1))
        at = match.end()
    if not rest:
        return None, formula.EMPTY

    def operand():
        nonlocal missing
        if not rest:
            raise ValueError(formula.BREAKS_OFF)
        token = rest.pop()
        if token in "+-":
            return operand() if token == "+" else -operand()
        if token == "(":
            inside = level(1)
            if not rest or rest.pop() != ")":
                raise ValueError(formula.UNCLOSED)
            return inside
        if token[0] == "[":
            value = known.get(token[1:-1].strip())
            missing = missing or value is None
            return value or 0.0
        if not token[0].isdigit():
            raise ValueError(formula.NO_NUMBER % token)
        return float(token.replace(",", "."))

    def level(least):
        value = operand()
        while rest and priority.get(rest[-1], 0) >= least:
            sign = rest.pop()
            right = level(priority[sign] + 1)
            if sign == "/" and right == 0:
                raise ValueError(formula.ZERO_DIVISION)
            value = {"+": value + right, "-": value - right, "*": value * right, "/": value / (right or 1)}[sign]
        return value

    try:
        value = level(1)
    except ValueError as problem:
        return None, str(problem)
    return (None, formula.EXTRA % " ".join(rest[::-1])) if rest else (None if missing else value, None)


def evaluated(spark, texts, known):
    """The same by the library, in the order of ``texts``."""
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, expression string")
    ids, values = F.array(*[F.lit(k) for k in known]), F.array(*[F.lit(v).cast("double") for v in known.values()])
    told = rows.select("k", formula.evaluate(F.col("expression"), ids, values).alias("e")).orderBy("k").collect()
    return [(r["e"]["value"], r["e"]["error"]) for r in told]


def test_random_formulas_equal_precedence_climbing(spark):
    dice, known = random.Random(4), {"a": 3.0, "b": 0.25, "gone": None}
    pieces = ["1", "2,5", "0", "(", ")", "+", "-", "*", "/", "[a]", "[ b ]", "[zz]", "[gone]", " ", "10", "(", ")"]

    def formed(depth):
        kind = dice.random()
        if depth == 0 or kind < 0.3:
            return dice.choice(["1", "2,5", "0", "[a]", "[b]", "[zz]"])
        if kind < 0.6:
            return f"({formed(depth - 1)})" if kind < 0.5 else dice.choice("+-") + formed(depth - 1)
        return formed(depth - 1) + dice.choice(["+", "-", "*", "/", " + ", "*-"]) + formed(depth - 1)

    texts = [None, "", " ", "1 & 2", "&", "1 [a", "[]", "7)", "(1", "2--3", "-(-2)*3", "(" * 200 + "1" + ")" * 200, "-" * 101 + "1", "+".join(["1"] * 300)]
    texts += ["".join(dice.choices(pieces, k=dice.randint(1, 9))) for _ in range(1500)] + [formed(3) for _ in range(700)]
    assert evaluated(spark, texts, known) == [climbed(t, known) for t in texts]


def test_formula_rules(spark):
    norms = spark.createDataFrame([("n1", "Гостиницы", 2.0, None)], "id string, name string, mass double, volume double")
    rules = spark.createDataFrame([("a", "[n1] + 2"), ("b", "[n9]"), ("c", "1/0")], "key string, expression string")
    problems = {r["key"]: r["problem"] for r in formula.validate(rules, norms).collect()}
    assert problems == {"a": None, "b": "Неизвестные нормативы: n9", "c": formula.ZERO_DIVISION}
    shown = {r["key"]: r["expression"] for r in formula.humanize(rules, norms).collect()}
    assert shown["a"] == "«Гостиницы» + 2"
    values = {r["key"]: (r["formula_mass"], r["formula_volume"]) for r in formula.evaluate_rules(rules, norms).collect()}
    assert values == {"a": (4.0, None), "b": (None, None), "c": (None, None)}


def test_numbers_read_alike_in_sql_and_columns(spark):
    from ledgerfold.functions.registered import register

    register(spark)
    cells = ["1 234,5", "1e999", "12", "-3,5 <*>", "1.", ".5", "", None, "12d", "1e3", "1 2,3*", "a", " 1,2", "+7"]
    rows = spark.createDataFrame([(c,) for c in cells], "x string")
    both = rows.select(F.expr("read_number(x)").alias("a"), text.parse_number(F.col("x")).alias("b")).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both]
