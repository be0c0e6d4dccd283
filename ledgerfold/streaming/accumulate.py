"""Extracts that arrive one after the other: the registry cube kept up to date.

The cube is a table merged on reading: ``base/version=N`` holds every line as of
batch N, ``changes/batch=N`` the lines that a later batch changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.operators import registry
from ledgerfold.session import drop_folder, written_folders

KEYS = ["file", "zone", "municipality", "category"]
COMPACT_EVERY = 16


def accumulate(
    rows: DataFrame,
    table: str,
    checkpoint: str,
    every: int = COMPACT_EVERY,
    then: Callable[[SparkSession, int], None] | None = None,
    **trigger,
) -> StreamingQuery:
    """Keep the cube of a stream of typed rows in a table that is merged on reading.

    The state is one line of numbers per file and spelling.  There is no event
    time and so no watermark; a batch writes the lines it changed, and a repeated
    batch overwrites its own folder.  After ``every`` batches changes are folded
    into the base, so reading costs at most that many small tables.  ``then`` is
    called after every batch, with the session and the number of the batch.
    """

    def store(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        changed.write.mode("overwrite").parquet(f"{table}/changes/batch={batch}")
        if (batch + 1) % every == 0:
            compact(spark, table, batch)
        if then is not None:
            then(spark, batch)

    return (
        registry.cube(rows)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _versions(spark: SparkSession, table: str) -> tuple[dict[int, str], dict[int, str]]:
    return written_folders(spark, f"{table}/base", "version"), written_folders(spark, f"{table}/changes", "batch")


def current_cube(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame:
    """The cube as of the last batch (or ``upto``): the newest line per file and spelling."""
    bases, changes = _versions(spark, table)
    bases = {n: path for n, path in bases.items() if upto is None or n <= upto}
    base = max(bases, default=-1)
    later = [path for n, path in changes.items() if n > base and (upto is None or n <= upto)]
    parts = [spark.read.parquet(bases[base])] if bases else []
    if later:
        parts.append(spark.read.option("basePath", f"{table}/changes").parquet(*later).withColumn("batch", F.col("batch").cast("long")))
    if not parts:
        raise ValueError(f"no batch was accumulated in {table}")
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fields = [c for c in lines.columns if c not in (*KEYS, "batch")]
    newest = lines.groupBy(*KEYS).agg(F.max(F.struct("batch", *fields)).alias("n"))
    return newest.select(*KEYS, *[F.col(f"n.{c}").alias(c) for c in fields])


def compact(spark: SparkSession, table: str, batch: int) -> None:
    """Fold the changes up to ``batch`` into a new base and drop what it replaces.

    A base counts once it is complete; only then are the changes in it dropped,
    so a lost driver leaves a readable table.  The base before stays until the
    next compaction, for readers that have begun.
    """
    bases, _ = _versions(spark, table)
    if batch not in bases:
        whole = current_cube(spark, table, batch).withColumn("batch", F.lit(batch).cast("long"))
        whole.write.mode("overwrite").parquet(f"{table}/base/version={batch}")
    bases, changes = _versions(spark, table)
    for path in [*[p for n, p in changes.items() if n <= batch], *[bases[n] for n in sorted(bases) if n < batch][:-1]]:
        drop_folder(spark, path)
