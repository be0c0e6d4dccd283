"""Checking layouts that somebody proposes before they are used.

Proposals arrive as rows; who wrote them does not matter.  Each check gives rows
of problems; a proposal without any is read again and checked by its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions.text import parse_number, strip
from ledgerfold.functions.units import mass_factor, volume_factor
from ledgerfold.operators import norms, registry
from ledgerfold.operators.grid import TABLE, significant_rows
from ledgerfold.operators.relational import join_lookup
from ledgerfold.session import cut

# --- fixed values: accepted bases, roles, limits and codes of problems ------------
BASES = ("person", "sqm", "place", "other")
ROLES = ("category", "units", "zone", "municipality", "unit_name")
PROBE_ROWS, LEAST_ENTRIES = 200, 2
SAMPLE_ROWS, SAMPLE_COLUMNS = 6, 14


def _problems(*checks: tuple[Column, str]) -> Column:
    """Codes of the checks that hold, as an array."""
    return F.filter(F.array(*[F.when(test, F.lit(code)) for test, code in checks]), lambda p: p.isNotNull())


def check_norm_tables(grids: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposed layouts of norm tables with their factors and their problems.

    ``proposals`` has ``file, table_idx, item`` (its place in the proposal), the
    layout columns, ``mass_unit, volume_unit`` and ``basis``.  The unit in the
    header of the file goes before the claimed one; a contradiction is a problem.
    """
    rows = significant_rows(grids)
    sizes = rows.groupBy(*TABLE).agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("width"))
    placed = cut(proposals.join(sizes, TABLE, "left"))
    width, head = F.col("width"), F.col("header_row_count")
    name, mass, volume = (F.col(f"{c}_column") for c in ("name", "mass", "volume"))
    outside = lambda c: (c < 0) | (c >= width)
    checked = placed.withColumn(
        "problems",
        F.when(F.col("n_rows").isNull(), F.array(F.lit("no-table"))).otherwise(
            _problems(
                ((head < 1) | (head >= F.col("n_rows")), "header-too-deep"),
                (outside(name), "no-name-column"),
                ((mass != -1) & outside(mass), "no-mass-column"),
                ((volume != -1) & outside(volume), "no-volume-column"),
                ((mass == -1) & (volume == -1), "no-value-column"),
                ((mass != -1) & (mass == name), "mass-is-name"),
                ((volume != -1) & (volume == name), "volume-is-name"),
                ((mass != -1) & (mass == volume), "mass-is-volume"),
            )
        ),
    )
    # Headers are read once per distinct header depth, in the form item → texts.
    sound = checked.filter(F.size("problems") == 0)
    depths = sound.groupBy(*TABLE).agg(F.max("header_row_count").alias("header_row_count"))
    tiers = join_lookup(rows.select(*TABLE, "sig_idx", "cells"), depths, TABLE).filter(
        F.col("sig_idx") < F.col("header_row_count")
    )
    texts = (
        tiers.select(*TABLE, "sig_idx", F.posexplode("cells").alias("col_idx", "cell"))
        .join(sound.select(*TABLE, "item", head.alias("depth")), TABLE)
        .filter(F.col("sig_idx") < F.col("depth"))
        .withColumn("cell", strip(F.col("cell")))
        .filter(F.col("cell") != "")
        .groupBy(*TABLE, "item", "col_idx", "cell")
        .agg(F.min("sig_idx").alias("tier"))
        .groupBy(*TABLE, "item", "col_idx")
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct("tier", "cell")))["cell"], " ").alias("header"))
    )
    texts = cut(texts)
    for role in ("mass", "volume"):
        named = texts.select(*TABLE, "item", F.col("col_idx").alias(f"{role}_column"), F.col("header").alias(f"{role}_header"))
        checked = checked.join(named, [*TABLE, "item", f"{role}_column"], "left")

    def factors(role: str, factor) -> tuple[Column, Column]:
        return factor(F.coalesce(f"{role}_header", F.lit(""))), factor(F.coalesce(f"{role}_unit", F.lit("")))

    (file_mass, told_mass), (file_volume, told_volume) = factors("mass", mass_factor), factors("volume", volume_factor)
    checked = checked.withColumns(
        {"file_mass": file_mass, "told_mass": told_mass, "file_volume": file_volume, "told_volume": told_volume}
    )
    unit_problems = _problems(
        ((mass != -1) & F.col("file_mass").isNull() & F.col("told_mass").isNull(), "unknown-mass-unit"),
        ((mass != -1) & (F.col("file_mass") != F.col("told_mass")), "mass-unit-differs"),
        ((volume != -1) & F.col("file_volume").isNull() & F.col("told_volume").isNull(), "unknown-volume-unit"),
        ((volume != -1) & (F.col("file_volume") != F.col("told_volume")), "volume-unit-differs"),
    )
    unit = F.col("unit_column")
    return checked.select(
        *TABLE,
        "item",
        "header_row_count",
        "name_column",
        F.when((unit >= 0) & (unit < width), unit).otherwise(-1).alias("unit_column"),
        "mass_column",
        "volume_column",
        F.when(mass != -1, F.coalesce("file_mass", "told_mass")).alias("mass_factor"),
        F.when(volume != -1, F.coalesce("file_volume", "told_volume")).alias("volume_factor"),
        F.when(F.col("basis").isin(*BASES), F.col("basis")).alias("basis"),
        F.when(F.size("problems") > 0, F.col("problems")).otherwise(unit_problems).alias("problems"),
    )


def validate_norm_proposals(grids: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdict per file and the entries the accepted proposals read.

    A proposal is all of a file's rows.  It must name no table twice, every table
    must yield entries, promised masses and volumes must be there, and at least
    two entries must result.
    """
    checked = cut(check_norm_tables(grids, proposals))
    bad = checked.select("file", F.explode("problems").alias("problem"))
    twice = (
        checked.join(bad.select("file").distinct(), "file", "left_anti")
        .groupBy(*TABLE)
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("file", F.lit("table-twice").alias("problem"))
    )
    first = cut(bad.unionByName(twice).distinct())
    sound = checked.join(first.select("file").distinct(), "file", "left_anti")
    entries = cut(norms.apply_layouts(grids, sound.withColumn("list_pos", F.col("item")).drop("problems", "item")))
    counts = norms.table_counts(entries)
    per_table = sound.join(counts, TABLE, "left")
    empty = per_table.filter(F.col("n").isNull()).select("file", F.lit("nothing-read").alias("problem"))
    per_file = per_table.groupBy("file").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("with_mass"), F.lit(0)).alias("with_mass"),
        F.coalesce(F.sum("with_volume"), F.lit(0)).alias("with_volume"),
        F.bool_or(F.col("mass_column") != -1).alias("wants_mass"),
        F.bool_or(F.col("volume_column") != -1).alias("wants_volume"),
        F.count_if(F.col("n").isNull()).alias("unread"),
    )
    read = per_file.filter("unread = 0").select(
        "file",
        F.explode(
            _problems(
                (F.col("wants_mass") & (F.col("with_mass") == 0), "no-mass-numbers"),
                (F.col("wants_volume") & (F.col("with_volume") == 0), "no-volume-numbers"),
                (F.col("n") < LEAST_ENTRIES, "too-few-entries"),
            )
        ).alias("problem"),
    )
    found = first.unionByName(empty.distinct()).unionByName(read)
    told = found.groupBy("file").agg(F.sort_array(F.collect_set("problem")).alias("problems"))
    files = proposals.select("file").distinct()
    verdict = (
        files.join(told, "file", "left")
        .join(per_file.select("file", "n", "with_mass", "with_volume"), "file", "left")
        .select(
            "file",
            F.col("problems").isNull().alias("ok"),
            F.coalesce("problems", F.array().cast("array<string>")).alias("problems"),
            *[F.when(F.col("problems").isNull(), F.col(c)).alias(c) for c in ("n", "with_mass", "with_volume")],
        )
    )
    return verdict, entries.join(found.select("file").distinct(), "file", "left_anti")


def accept_norms(current: DataFrame, verdict: DataFrame, preview: DataFrame) -> DataFrame:
    """Files whose proposal may be applied by itself: valid, and losing no name."""
    before = current.select("file", "name").distinct()
    lost = before.join(verdict.filter("ok").select("file"), "file").join(
        preview.select("file", "name").distinct(), ["file", "name"], "left_anti"
    )
    losses = lost.groupBy("file").agg(F.count("*").alias("n_lost"))
    return verdict.join(losses, "file", "left").select(
        "file", "ok", F.coalesce("n_lost", F.lit(0)).alias("n_lost"), (F.col("ok") & F.col("n_lost").isNull()).alias("apply")
    )


def reapply_saved(detected: DataFrame, saved: DataFrame) -> DataFrame:
    """Entries by a saved layout where it still yields at least two, else by detection."""
    useful = saved.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ENTRIES).select("file")
    kept = detected.join(useful, "file", "left_anti").withColumn("source", F.lit("detected"))
    return saved.join(useful, "file", "left_semi").withColumn("source", F.lit("saved")).unionByName(kept)


def read_by_stored_layout(grids: DataFrame, layouts: DataFrame) -> DataFrame:
    """Norms of each file by its stored layout where that still fits, else by detection.

    A layout fits no more if a table that it names is missing or gives nothing,
    or if the whole file gives fewer than two entries.  ``source`` tells which
    reading counts; files without a stored layout are read by detection.
    """
    by_layout = cut(norms.apply_layouts(grids, layouts))
    broken = norms.layout_errors(grids, layouts, by_layout).select("file").distinct()
    return reapply_saved(norms.read_norms(grids), by_layout.join(broken, "file", "left_anti"))


def validate_registry_proposals(grids: DataFrame, proposals: DataFrame) -> DataFrame:
    """Verdict per extract on a proposed sheet, header row and columns (-1 = absent).

    The columns must exist in the sampled header, be named once each and include
    the category; the file is then read by them, and in the first two hundred
    rows categories must not be numbers and some units must be positive.
    """
    top = grids.filter(F.col("row_idx") < SAMPLE_ROWS + 2).filter(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    ordered = F.sort_array(F.collect_list(F.struct("row_idx", F.size("cells").alias("n"))))
    sampled = top.groupBy(*TABLE).agg(F.slice(ordered, 1, SAMPLE_ROWS).alias("sampled"))
    sample = sampled.select(
        *TABLE,
        F.size("sampled").cast("bigint").alias("sample_rows"),
        F.least(F.array_max(F.transform("sampled", lambda r: r["n"])), F.lit(SAMPLE_COLUMNS)).alias("width"),
    )
    sheet = proposals.withColumn("table_idx", F.col("sheet")).join(sample, TABLE, "left")
    columns = F.array(*[F.col(r) for r in ROLES])
    named = F.filter(columns, lambda c: (c >= 0) & (c < F.col("width")))
    form = F.when(F.col("sheet") == -1, F.array(F.lit("no-sheet-proposed"))).when(
        F.col("width").isNull(), F.array(F.lit("no-sheet"))
    ).otherwise(
        _problems(
            ((F.col("header_row") < 0) | (F.col("header_row") >= F.col("sample_rows")), "no-header-row"),
            (F.exists(columns, lambda c: (c < -1) | (c >= F.col("width"))), "no-column"),
            ((F.col("category") < 0) | (F.col("category") >= F.col("width")), "no-category"),
            (F.size(F.array_distinct(named)) < F.size(named), "column-twice"),
        )
    )
    checked = cut(sheet.withColumn("problems", form))
    sound = checked.filter(F.size("problems") == 0).select(
        *TABLE, F.col("header_row").cast("bigint").alias("header_row"), *[F.when(F.col(r) >= 0, F.col(r)).alias(r) for r in ROLES]
    )
    sound = cut(sound)
    rows = registry.typed_rows(grids, sound)
    facts = registry.cube_of(grids, sound).groupBy("file").agg(
        F.sum("n_rows").alias("n_rows"),
        (F.sum("n_without_column") == 0).alias("has_units"),
        *[F.count_distinct(F.when(F.col(c) != "", F.col(c))).alias(f"n_{c}") for c in ("category", "zone", "municipality")],
    )
    # The probe is cut map-side: a task passes on at most two hundred rows of a file.
    order = Window.partitionBy("file").orderBy("excel_row", "category")
    probe = (
        rows.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= PROBE_ROWS)
        .groupBy("file")
        .agg(
            F.count("*").alias("probed"),
            F.count_if(parse_number(F.col("category")).isNotNull()).alias("numeric"),
            F.count_if(F.col("units") > 0).alias("positive"),
        )
    )
    judged = checked.join(facts, "file", "left").join(probe, "file", "left")
    content = F.when(F.col("n_rows").isNull(), F.array(F.lit("nothing-read"))).otherwise(
        _problems(
            (F.col("numeric") > F.col("probed") / 2, "numeric-categories"),
            ((F.col("units") >= 0) & (F.col("positive") == 0), "no-positive-units"),
        )
    )
    problems = F.when(F.size("problems") > 0, F.col("problems")).otherwise(content)
    judged = judged.withColumn("problems", problems).withColumn("ok", F.size("problems") == 0)
    summary = ["n_rows", "has_units", "n_category", "n_zone", "n_municipality"]
    return judged.select("file", "ok", F.sort_array("problems").alias("problems"), *[F.when(F.col("ok"), F.col(c)).alias(c) for c in summary])


def apply_registry_layout(grids: DataFrame, layout: DataFrame, detected: DataFrame) -> DataFrame:
    """One accepted layout for every extract; files it reads nothing from keep theirs.

    ``layout`` is one row ``(table_idx, header_row, category, …)``; ``detected``
    comes from ``registry.layouts``.  Returns a layout per file.
    """
    columns = ["table_idx", *registry.LAYOUT]
    one = layout.select(F.first(F.struct(*columns)).alias("one")).scalar()
    given = cut(detected.select("file").distinct().withColumn("one", one).select("file", "one.*"))
    category = F.get("cells", F.col("category"))
    reads = (
        grids.join(given.select(*TABLE, "header_row", "category"), TABLE)
        .filter((F.col("row_idx") > F.col("header_row")) & F.coalesce(category, F.lit("")).rlike(registry.NOT_BLANK))
        .select("file")
        .distinct()
    )
    reads = cut(reads)
    taken = given.join(reads, "file", "left_semi").withColumn("layout_source", F.lit("proposed"))
    kept = detected.join(reads, "file", "left_anti").select("file", *columns, "layout_source")
    return cut(taken.select("file", *columns, "layout_source").unionByName(kept))
