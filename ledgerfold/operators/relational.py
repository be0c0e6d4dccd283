"""Small relational helpers that keep hot keys and large sides under control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.session import cut

CHUNK = 8192
SHARES = 8  # of a split of a source, for work on many rows made of each of its rows


def spread(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Shuffle by ``keys`` over all cores at hand.

    For steps that compute much on few bytes: a stated number of partitions is
    kept, where adaptive execution would fold small partitions together.
    """
    spark = frame.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return frame.repartition(wanted, *keys)


def kept_together(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows of a source dealt out by ``keys``, some to each split of the source.

    What is made of a row later needs no shuffle by the keys and more columns, and
    a task's share stays the same however large the source.
    """
    spark = frame.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return frame.repartition(max(least, SHARES * frame.rdd.getNumPartitions()), *keys)


def dealt_out(frame: DataFrame) -> DataFrame:
    """Rows of a source with fewer splits than cores, dealt out to all of them.

    For heavy work per row on a source that was landed in one piece; a source of
    many splits is left as it is and nothing is shuffled.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def in_ranges(frame: DataFrame, keys: list[str], order: list[str], mark: str) -> DataFrame:
    """Rows dealt into ranges of about equal size along (keys, order), numbered by ``mark``.

    However sparse or crowded the order, and however large a key, a range is one
    task's work.  The rows are written: the bounds of ranges are sampled, and must
    not be drawn anew when the part of a lost executor is worked out again.
    """
    spark = frame.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return cut(frame.repartitionByRange(wanted, *keys, *order).withColumn(mark, F.spark_partition_id()))


def as_of(
    points: DataFrame, bounds: DataFrame, keys: list[str], value: str, at: str, above: bool = False
) -> DataFrame:
    """Points with the bounds beside them, as structs ``before`` and ``after``.

    ``after`` is the first bound of the same keys at or above the point's ``value``
    (only above it, if ``above``), ``before`` the last one short of that; either
    may be null, both are for points without keys, value or bounds.  ``bounds`` has
    ``idx``, which orders equal ones.  Points and bounds are merged into one sorted
    union, cut into ranges; a key that spans several ranges carries its bounds over
    their ends, by a table of at most two rows per range.
    """
    mine = points.select(
        *keys, F.col(value).alias("__at"), F.lit(int(above)).alias("__turn"),
        F.struct(*[c for c in points.columns if c not in keys]).alias("__point"),
    )
    theirs = bounds.dropna(subset=[*keys, at]).select(
        *keys, F.col(at).alias("__at"), F.lit(int(not above)).alias("__turn"),
        F.struct(*[c for c in bounds.columns if c not in keys]).alias("__bound"),
    )
    merged = in_ranges(mine.unionByName(theirs, allowMissingColumns=True), keys, ["__at", "__turn"], "__part")

    spans = merged.groupBy(*keys).agg(F.min("__part").alias("__lo"), F.max("__part").alias("__hi")).filter("__lo < __hi")
    place = F.when(F.col("__bound").isNotNull(), F.struct("__at", "__bound.idx"))
    ends = (
        merged.join(F.broadcast(spans.select(*keys)), keys, "left_semi")
        .groupBy(*keys, "__part")
        .agg(F.min_by("__bound", place).alias("__first"), F.max_by("__bound", place).alias("__last"))
    )
    parts = Window.partitionBy(*keys).orderBy("__part")
    backwards = Window.partitionBy(*keys).orderBy(F.desc("__part"))
    others = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "__part",
        F.last("__last", ignorenulls=True).over(others(parts)).alias("__earlier"),
        F.last("__first", ignorenulls=True).over(others(backwards)).alias("__later"),
    )

    names = ", ".join(f"`{c}`" for c in [*keys, "__part"])
    order = Window.partitionBy(*keys, "__part").orderBy("__at", "__turn", "__bound.idx")
    beside = merged.withColumns(
        {
            "__before": F.last("__bound", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "__after": F.expr(f"lead(__bound) IGNORE NULLS OVER (PARTITION BY {names} ORDER BY __at, __turn, __bound.idx)"),
        }
    )
    told = beside.filter("__point IS NOT NULL").join(F.broadcast(carried), [*keys, "__part"], "left")
    known = F.col("__at").isNotNull()
    return told.select(
        *keys, "__point.*",
        F.when(known, F.coalesce("__before", "__earlier")).alias("before"),
        F.when(known, F.coalesce("__after", "__later")).alias("after"),
    )


def join_lookup(
    big: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", written: bool = False
) -> DataFrame:
    """Join a large frame with a lookup that has one row per key.

    The lookup is written out first (unless it is read from a written table
    already, as ``written`` says).  Its real size then decides: below the
    session's broadcast threshold the large side is not moved at all; above it
    both sides are shuffled and adaptive execution splits a key that holds a
    big share of the rows.
    """
    return big.join(lookup if written else cut(lookup), keys, how)


def running_sum(
    frame: DataFrame, keys: list[str], order: str, value: Column, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Inclusive running sum along ``order`` (a whole number) within ``keys``.

    Done in two levels: a partition of ``keys`` is cut into chunks of the order
    value, chunk totals are accumulated, and rows are summed inside their own
    chunk.  A key holding most of the rows is thus spread over many tasks.
    """
    cut = frame.withColumn("__chunk", F.floor(F.col(order) / chunk).cast("bigint")).withColumn("__v", value)
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy(*keys, "__chunk")
        .agg(F.sum("__v").alias("__total"))
        .withColumn("__base", F.coalesce(F.sum("__total").over(earlier), F.lit(0)))
        .drop("__total")
    )
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("__inner", F.sum("__v").over(inside))
        .join(totals, [*keys, "__chunk"])
        .withColumn(out, F.col("__base") + F.col("__inner"))
        .drop("__chunk", "__v", "__inner", "__base")
    )


def running_position(frame: DataFrame, keys: list[str], order: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Zero-based dense position along ``order`` within ``keys``, in two levels."""
    counted = running_sum(frame, keys, order, F.lit(1).cast("bigint"), out, chunk)
    return counted.withColumn(out, F.col(out) - 1)


def upper_median(value: str, where: str | None = None) -> Column:
    """Element floor(n/2) of the sorted values; mergeable, so it combines map-side."""
    kept = f" FILTER (WHERE {where})" if where else ""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC){kept}")


def upper_median_of_group(value: str, keys: list[str]) -> Column:
    """The same of the rows with equal keys, beside each of them; nulls are left out."""
    names = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC) OVER (PARTITION BY {names})")


def index_where(array: Column, test) -> Column:
    """Zero-based index of the first element passing ``test``, or null."""
    position = F.array_position(F.transform(array, lambda x: F.coalesce(test(x), F.lit(False))), True)
    return F.when(position > 0, (position - 1).cast("int"))
