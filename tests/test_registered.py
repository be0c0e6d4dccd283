"""Functions called by name from SQL equal those built as columns."""

from pyspark.sql import functions as F

from ledgerfold.functions import text, units
from ledgerfold.functions.registered import register

NAMES = [
    ("Гостиницы и отели", "гостиница"), ("Детские сады", "Детский сад (ясли)"), ("Бани", "Бани"), ("", "Бани"), (None, None),
    ("магазин продовольственный", "промтоварный магазин"), ("Ёлочные базары", "елочный базар"), ("и", "на"), ("рынки", "кладбища"),
]
UNITS = ["на 1 человека", "1 койко-место", "кв. метр общей площади", "погонный метр", "участок", "пудов", "", None, "место", "м2"]


def test_sql_functions_equal_columns(spark):
    assert {"stem", "unit_basis", "similarity"} <= set(register(spark))
    names = spark.createDataFrame(NAMES, "a string, b string")
    for r in names.select(F.expr("similarity(a, b)").alias("s"), text.similarity(F.col("a"), F.col("b")).alias("t"), "a").collect():
        assert abs(r["s"] - r["t"]) < 1e-12, r
    words = names.select(F.expr("stem(a)").alias("s"), text.stem(F.col("a")).alias("t")).collect()
    assert all(r["s"] == r["t"] for r in words)
    kinds = spark.createDataFrame([(u,) for u in UNITS], "u string").select(F.expr("unit_basis(u)").alias("s"), units.unit_basis(F.col("u")).alias("t"))
    assert all(r["s"] == r["t"] for r in kinds.collect())
