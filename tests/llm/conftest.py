import pytest
from pyspark.sql import functions as F


@pytest.fixture
def landed(spark):
    """Files ``(file, text)`` with further columns whose names operators use inside."""

    def make(rows, kind="bigint", dealt=3):
        frame = spark.createDataFrame(list(rows), f"file {kind}, text string").repartition(dealt)
        clashing = ("copy", "band", "label", "id", "at", "n", "found", "score", "raw", "words", "lines", "component", "node", "line_no", "kept")
        return frame.select("*", *[F.lit(name).alias(name) for name in clashing])

    return make
