"""The whole reconciliation, worked out anew after every batch of registry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.plans.reconcile import Reconciliation
from ledgerfold.plans.report import filled_form
from ledgerfold.session import cut, written_folders
from ledgerfold.streaming.accumulate import COMPACT_EVERY, accumulate, current_cube


def reconcile_stream(rows: DataFrame, run: Reconciliation, folder: str, every: int = COMPACT_EVERY, **trigger) -> StreamingQuery:
    """Fill the form of ``run`` after every batch of typed registry rows.

    ``run`` brings form, norms and rules; its own registry isn't read.  A batch
    scans the cube, not the rows of earlier batches, and matches only names that
    no batch before had.  Forms stand in ``form/batch=N`` of the folder; a repeated
    batch writes its form again, and after a restart the first batch matches all names.
    """
    table = f"{folder}/cube"
    last = run

    def fill(spark: SparkSession, batch: int) -> None:
        nonlocal last
        last = last.over(cut(current_cube(spark, table, batch)))
        filled_form(last).write.mode("overwrite").parquet(f"{folder}/form/batch={batch}")

    return accumulate(rows, table, f"{folder}/checkpoint", every, fill, **trigger)


def forms(spark: SparkSession, folder: str) -> dict[int, DataFrame]:
    """Complete forms by the number of their batch."""
    return {n: spark.read.parquet(path) for n, path in written_folders(spark, f"{folder}/form", "batch").items()}
