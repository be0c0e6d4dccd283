"""Mixing registry rows of municipalities to target shares."""

import random

from pyspark.sql import functions as F

from ledgerfold.llm import mixing


def _targets(sizes):
    """Targets by hand: (municipality, units) pairs in code point order, null last."""
    names = sorted((m for m in sizes if m is not None)) + [None] * (None in sizes)
    weight = {m: (3, 1, 2)[k % 3] for k, m in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[m] for m in open_)
        over = {m for m in open_ if 2 * sizes[m] < weight[m] * level}
        if not over:
            target |= {m: weight[m] * level for m in open_}
            break
        for m in over:
            target[m] = 2.0 * sizes[m]
            left -= target[m]
        open_ -= over
    return target


def _registry(spark, rows):
    frame = spark.createDataFrame(rows, "file string, excel_row int, municipality string, units bigint").repartition(3)
    return frame.select(F.struct("file", "excel_row").alias("place"), "municipality", "units", *[F.lit(0).alias(c) for c in ("target", "n", "at", "tilt", "rate", "draw")])


def test_targets_are_met_and_rows_bounded(spark):
    dice = random.Random(5)
    names = ["Абакан", "Черногорск", "Саяногорск", "abc", None]
    rows = [(f"{dice.randrange(4)}.xlsx", k, dice.choices(names, (9, 2, 2, 1, 1))[0], int(dice.paretovariate(1.2) * 20)) for k in range(1500)]
    rows += [("hot.xlsx", k, "Абакан", 50) for k in range(800)]  # one size that a third of rows share
    sizes = {m: sum(r[3] for r in rows if r[2] == m) for m in names}
    got = mixing.balance_rows(_registry(spark, rows), key="place").collect()
    assert len(got) == len(rows)
    of = {(r[0], r[1]): r for r in rows}
    taken, told, expected = dict.fromkeys(names, 0), {}, _targets(sizes)
    for r in got:
        row = of[tuple(r["place"])]
        assert (r["units"], r["municipality_units"]) == (row[3], sizes[row[2]])
        assert r["units_taken"] == r["copies"] * r["units"] and 0 <= r["copies"] <= 2
        taken[row[2]] += r["units_taken"]
        told[row[2]] = r["target"]
    for m in names:
        assert abs(told[m] - expected[m]) < 1e-6 * expected[m]
        assert abs(taken[m] - expected[m]) <= max(20, 0.002 * expected[m]), m
    again = mixing.balance_rows(_registry(spark, rows[::-1]), key="place").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rates_tilt_exponentially(spark):
    import math

    rows = [("a.xlsx", k, m, u) for k, (m, u) in enumerate([("y", 200), ("y", 400), ("y", 800), ("y", 1600), ("x", 1000), ("z", 10)] * 20)]
    rates = {(r["municipality_units"], r["units"]): r["rate"] for r in mixing.balance_rows(_registry(spark, rows), key="place").collect()}
    x = {u: rate for (total, u), rate in rates.items() if total == 60_000}
    free = [u for u in (200, 400, 800, 1600) if x[u] < 2]
    tilts = [math.log(x[u]) / u for u in free]
    assert max(tilts) - min(tilts) < 1e-9


def test_odd_rows(spark):
    rows = [("a", 1, "m", None), ("a", 2, "m", -5), ("a", 3, None, 7), ("a", 3, None, 7), (None, None, "m", 4), ("a", 4, "empty", 0)]
    got = mixing.balance_rows(_registry(spark, rows), key="place").collect()
    assert len(got) == 6
    assert sorted(r["units"] for r in got) == [0, 0, 0, 4, 7, 7]
    assert all(r["units_taken"] <= 2 * r["units"] for r in got)
    assert mixing.balance_rows(_registry(spark, []), key="place").count() == 0
