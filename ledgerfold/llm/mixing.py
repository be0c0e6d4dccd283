"""Mixing registry rows of several municipalities to target shares by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.session import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all units
MOST = 2  # times a row, and times a municipality
PRECISION = 1e-9
CHUNK = 20_000  # rows of one municipality and size that are ranked together


def _exact(value: Column) -> Column:
    """A sum that is the same in any order of rows."""
    return F.coalesce(F.sum(F.round(value, 9).cast("decimal(38,9)")).cast("double"), F.lit(0.0))


def _numbered(frame: DataFrame, *order: Column) -> DataFrame:
    """Add ``at``, the place in the given order over the whole frame, from 0."""
    ranged = cut(frame.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = ranged.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__in", inside).join(offsets, "__part").withColumn("at", (F.col("__base") + F.col("__in") - 1).cast("bigint")).drop("__part", "__n", "__base", "__in")


def municipality_targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``(at, municipality, municipality_units, n, target)`` of ``(municipality, units)``.

    Municipalities by code point, null last, take the weights by turns and part
    ``share`` of all units among them; one that would get more than twice its
    units stops there and the rest is parted again.
    """
    sizes = rows.groupBy("municipality").agg(F.sum("units").cast("bigint").alias("municipality_units"), F.count("*").alias("n"))
    ranked = _numbered(sizes, F.col("municipality").asc_nulls_last())
    turns = F.array(*[F.lit(int(w)) for w in weights])
    weighed = cut(ranked.withColumn("weight", F.get(turns, F.col("at") % len(weights))))
    limit = MOST * F.col("municipality_units")
    total = weighed.agg(F.sum("municipality_units"), F.sum("weight")).first()
    wanted, level = share * float(total[0] or 0), 0.0
    new = wanted / total[1] if total[1] else 0.0
    while new > level:  # rises with every municipality that stops, then stays
        level = new
        over = limit < F.col("weight") * level
        r = weighed.agg(F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        new = (wanted - float(r[0] or 0)) / float(r[1]) if r[1] else level
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(level))
    return cut(weighed.select("at", "municipality", "municipality_units", "n", target.alias("target")))


def _rate(tilt: Column) -> Column:
    """Exponentially tilted rate of a row, held at ``MOST``."""
    return F.when(F.col("full"), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(tilt * F.col("x"), F.lit(50.0)))))


def _tilts(classes: DataFrame, targets: DataFrame, rounds: int = 60) -> DataFrame:
    """``(at, tilt)``: the dual variable of every municipality's constraint, by Newton's method.

    The dual of least relative entropy under one total per municipality is
    convex; its gradient is the units taken less the target.  Steps leave the
    bracket of signs seen so far only to be replaced by its middle.  A round is
    one aggregate over rows of equal municipality and units and one small table.
    """
    big = F.lit(1e6)
    start = F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.greatest(F.col("municipality_units"), F.lit(1)))
    settled = (F.col("municipality_units") == 0) | (F.col("target") >= MOST * F.col("municipality_units"))
    state = cut(targets.select("at", "target", start.alias("tilt"), (-big).alias("low"), big.alias("high"), settled.alias("done")))
    for _ in range(rounds):
        rate = _rate(F.col("tilt"))
        units = F.col("n") * F.col("units") * rate
        sums = (
            classes.join(state.filter(~F.col("done")).select("at", "tilt"), "at")
            .groupBy("at")
            .agg(_exact(units).alias("f"), _exact(F.when(rate < MOST, units * F.col("x"))).alias("slope"))
        )
        gap = F.log(F.greatest(F.col("f"), F.lit(1e-300)) / F.greatest(F.col("target"), F.lit(1e-9)))
        low = F.when(gap < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.least("high", "tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap * F.col("f") / F.when(F.col("slope") > 0, F.col("slope"))
        bound = F.when((F.col("low") > -big) & (F.col("high") < big), (F.col("low") + F.col("high")) / 2).otherwise(F.col("tilt") - F.signum("gap") * (1 + F.abs("tilt")))
        moved = (
            state.join(sums, "at", "left")
            .withColumn("gap", gap)
            .withColumns({"low": low, "high": high})
            .withColumn("step", step)
            .withColumn("next", F.when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise(bound))
        )
        ended = F.col("done") | (F.abs("gap") < PRECISION) | (F.col("high") - F.col("low") < 1e-13)
        state = cut(moved.select("at", "target", F.when(ended, F.col("tilt")).otherwise(F.col("next")).alias("tilt"), "low", "high", ended.alias("done")))
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("at", "tilt")


def _copies(classes: DataFrame, passes: int = 6) -> DataFrame:
    """Whole copies ``taken`` for each class of rows, near ``n * rate`` and near the target in sum.

    Fractions are rounded along the sizes of a municipality, so that what one
    class loses the next gains; passes over what is still missing (or too much)
    then take the largest size that fits in it.
    """
    along = Window.partitionBy("at").orderBy(F.desc("units"))
    room = MOST * F.col("n")
    whole = F.least(room, F.floor(F.col("n") * F.col("rate") + 1e-9))
    part = F.round(F.greatest(F.lit(0.0), F.col("n") * F.col("rate") - F.col("whole")), 9).cast("decimal(38,9)")
    carried = F.floor(F.sum("part").over(along) + F.lit(0.5)).cast("bigint")
    rounded = classes.withColumn("whole", whole.cast("bigint")).withColumn("part", part).withColumn("carried", carried)
    extra = F.col("carried") - F.coalesce(F.lag("carried").over(along), F.lit(0))
    taken = cut(rounded.withColumn("taken", F.least(room, F.col("whole") + extra).cast("bigint")).drop("whole", "part", "carried"))
    for _ in range(passes):
        missing = taken.groupBy("at").agg((F.max("target") - F.sum(F.col("taken") * F.col("units"))).alias("missing"))
        free = F.when(F.col("missing") > 0, room - F.col("taken")).otherwise(F.col("taken"))
        fits = (F.col("units") > 0) & (free > 0) & (F.abs("missing") * 2 > F.col("units"))
        times = F.greatest(F.lit(1), F.least(free, F.floor(F.abs("missing") / F.col("units")))).cast("bigint")
        whole_fit = F.col("units") <= F.abs("missing")
        best = (
            taken.join(missing, "at")
            .filter(fits)
            .groupBy("at")
            # the largest that fits; else the smallest that still lessens what is missing
            .agg(F.max(F.struct(whole_fit.alias("whole"), F.when(whole_fit, F.col("units")).otherwise(-F.col("units")).alias("rank"), "units", (times * F.signum("missing")).cast("bigint").alias("more"))).alias("b"))
            .select("at", F.col("b.units").alias("units"), F.col("b.more").alias("more"))
        )
        best = cut(best)
        if best.isEmpty():
            break
        taken = cut(taken.join(best, ["at", "units"], "left").withColumn("taken", F.col("taken") + F.coalesce("more", F.lit(0))).drop("more"))
    return taken


def balance_rows(rows: DataFrame, key: str = "file", weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """How often each registry row goes into a mix of municipalities.

    ``rows`` is ``(<key>, municipality, units)``; ``key`` names a column that
    tells rows apart, a struct of ``file`` and ``excel_row`` for a registry.
    Returns ``(<key>, units, municipality_units, target, rate, copies,
    units_taken)``, one row per row.  Of all rates whose units meet the targets
    (see ``municipality_targets``) those of least relative entropy are an
    exponential of the row's units, held at two; they are rounded to 0, 1 or 2
    copies so that a municipality's units stay near its target.

    Null or negative units count as 0, and take 0; a null municipality is one of
    its own, the last; repeated rows are rows; an empty table gives an empty one;
    further columns are left out and may have any name.  Reruns agree: sums are
    decimal, and rows of one size are ranked by the hash of their key, in chunks,
    so that no municipality and no size is ever sorted in one place.
    """
    kept = rows.select(F.col(key).alias("__key"), "municipality", F.greatest(F.coalesce("units", F.lit(0)), F.lit(0)).cast("bigint").alias("units"))
    rows = cut(kept.withColumn("draw", F.xxhash64("__key")))
    targets = municipality_targets(rows, weights, share)
    same = rows["municipality"].eqNullSafe(targets["municipality"])
    placed = rows.join(targets, same).select("__key", "units", "draw", targets["at"])
    scaled = targets.withColumn("mean", F.greatest(F.lit(1.0), F.col("municipality_units") / F.col("n")))
    counted = placed.groupBy("at", "units").agg(F.count("*").alias("n"))
    classes = cut(
        counted.join(scaled.drop("n", "municipality"), "at")
        .withColumn("x", F.col("units") / F.col("mean"))
        .withColumn("full", F.col("target") >= MOST * F.col("municipality_units"))
    )
    tilted = classes.join(_tilts(classes, targets), "at").withColumn("rate", _rate(F.col("tilt")))
    shared = _copies(tilted.select("at", "units", "n", "target", "municipality_units", "rate"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK))
    known = placed.join(shared, ["at", "units"]).withColumn("chunk", F.pmod("draw", chunks).cast("int"))
    known = cut(known)
    per_chunk = known.groupBy("at", "units", "chunk").agg(F.count("*").alias("in_chunk"))
    earlier = Window.partitionBy("at", "units").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select("at", "units", "chunk", F.coalesce(F.sum("in_chunk").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("at", "units", "chunk").orderBy("draw", "__key"))
    ranked = known.withColumn("rank", rank).join(offsets, ["at", "units", "chunk"])
    extra = F.when(F.col("before") + F.col("rank") <= F.col("taken") % F.col("n"), 1).otherwise(0)
    copies = (F.floor(F.col("taken") / F.col("n")) + extra).cast("int")
    return ranked.select(
        F.col("__key").alias(key), "units", "municipality_units", "target", "rate", copies.alias("copies"), (copies * F.col("units")).cast("bigint").alias("units_taken")
    )
