"""Lines that repeat, exactly or nearly, over all files: one of each group stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import words as W
from ledgerfold.llm.near_copies import SEEN, groups_of, sent_once
from ledgerfold.llm.records import BLANKS
from ledgerfold.session import cut, ship

GRAM = 6
AT_ONCE = 1 << 17  # characters of lines that are hashed at once, so that their hashes stay in a core's cache
BANDS, PER_BAND = 12, 4
_DICE = np.random.default_rng(8)
_FACTORS = _DICE.integers(1, 1 << 31, BANDS * PER_BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _DICE.integers(0, 1 << 32, BANDS * PER_BAND, dtype=np.uint32)


def _line_grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of all lines, and how many each line has.

    A line shorter than ``GRAM`` is one gram; none is empty.
    """
    codes, lengths = W.code_points(lines)
    ends, short = np.cumsum(lengths), lengths < GRAM
    begins = np.ones(len(codes), bool)
    for k in range(1, GRAM):
        begins[ends[lengths > k] - k] = False
    hashes = np.empty(len(codes), np.uint64)
    hashes[: max(0, len(codes) - GRAM + 1)] = W.gram_hashes(codes, GRAM)
    for k in np.flatnonzero(short).tolist():
        own = codes[ends[k] - lengths[k] : ends[k]]
        hashes[ends[k] - lengths[k]] = W.gram_hashes(own, len(own))[0]
    return hashes[begins], np.where(short, 1, lengths - GRAM + 1)


def _bands(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and the last bytes of the minima that they are made of, a row per line."""
    grams, counts = _line_grams(lines)
    short, starts = (grams >> np.uint64(32)).astype(np.uint32), np.cumsum(counts) - counts
    keys, moved = np.empty((len(lines), BANDS), np.uint64), np.empty_like(short)
    signed = np.empty((len(lines), BANDS * PER_BAND), np.uint8)
    for band in range(BANDS):
        key = np.full(len(lines), band, np.uint64)
        for k in range(band * PER_BAND, (band + 1) * PER_BAND):
            np.multiply(short, _FACTORS[k], out=moved)
            moved += _SHIFTS[k]
            least = np.minimum.reduceat(moved, starts)
            signed[:, k] = least & np.uint32(0xFF)
            key = W.mixed(key * np.uint64(0x9E3779B97F4A7C15) + least.astype(np.uint64))
        keys[:, band] = key
    return keys.view(np.int64), signed


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with band keys and signatures in place of their text; none where a task has made those of the line before."""
    seen: set = set()
    for batch in batches:
        copies, fresh = batch.column("copy").to_pylist(), np.zeros(batch.num_rows, bool)
        for k, copy in enumerate(copies):
            if copy not in seen:
                seen.add(copy)
                fresh[k] = True
        if len(seen) > SEEN:
            seen.clear()
        lines = batch.column("text").filter(pa.array(fresh)).to_pylist()
        made = [_bands(lines[a:b]) for a, b in W.slices(lines, AT_ONCE)]
        keys, signed = ([m[k].ravel() for m in made] for k in (0, 1))
        offsets = np.concatenate([[0], np.cumsum(fresh * BANDS)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *keys])), mask=pa.array(~fresh))
        blocks = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BANDS * PER_BAND), len(lines), [None, pa.py_buffer(b"".join(x.tobytes() for x in signed))])
        where = pa.array(np.cumsum(fresh) - 1, mask=~fresh)
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, blocks.take(where).cast(pa.binary())], names=[*names, "bands", "signed"])


def line_grams(lines: list[str]) -> list[np.ndarray]:
    """Hashes of each line's character n-grams."""
    out: list[np.ndarray] = []
    for a, b in W.slices(lines, AT_ONCE):
        grams, counts = _line_grams(lines[a:b])
        out += np.split(grams, np.cumsum(counts)[:-1])
    return out


def _with_bands(lines: DataFrame) -> DataFrame:
    """``lines`` ``(..., copy, text)``, written with ``bands`` and ``signed`` in place of ``text``: null where a task has told them before."""
    ship(lines.sparkSession)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema if f.name != "text")
    return cut(lines.mapInArrow(_banded, f"{shape}, bands array<bigint>, signed binary"))


def line_groups(lines: DataFrame, banded: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` of lines ``(copy, text)`` that have near copies.

    ``copy`` is the hash of the line, ``text`` the line itself; a line may come often.
    Lines are near copies when their sets of six-character shingles share at
    least 80 per cent of their union.  ``banded`` is ``_with_bands`` of the same lines, if that is there.
    """
    banded = banded or _with_bands(lines)
    told = banded.filter(F.col("bands").isNotNull()).select("copy", "bands", "signed")
    return groups_of(told, lambda wanted: sent_once(lines, wanted, "copy bigint, text string"), line_grams, "bigint")


def drop_line_copies(files: DataFrame, key: str = "file") -> DataFrame:
    """Files without lines that an earlier line repeats, exactly or nearly.

    ``files`` is ``(file, text)``; lines are parted by line feeds.  Of every group
    that similarity of 0.8 connects (see ``line_groups``) the first line stays:
    the one with the smallest ``file`` (null last), then the smallest line number
    (from 0).  Returns ``(file, n_lines, removed, text)``: numbers of the removed
    lines, ascending, and the text of the lines that stay.

    Blank lines are no copies of each other and stay.  A null text has no lines
    and stays null; rows that repeat both file and text are one file and get the
    same answer.  One row per row of ``files``; further columns are left out.  A
    line is known by a 64-bit hash.
    """
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    whole = files.select(F.col(key).alias("file"), "text").withColumns({"id": F.xxhash64("file", "text"), "n_lines": n_lines.cast("bigint")})
    split = whole.select("file", "id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = split.filter(F.ltrim("line", F.lit(BLANKS)) != "").select("file", "id", "line_no", F.xxhash64("line").alias("copy"), F.col("line").alias("text"))
    where = _with_bands(lines)
    labels = line_groups(lines.select("copy", "text"), where)
    counts = where.groupBy("copy").agg(F.count("*").alias("n")).join(labels, F.col("copy") == F.col("node"), "left")
    repeated = counts.filter((F.col("n") > 1) | F.col("node").isNotNull()).select("copy", F.coalesce("component", "copy").alias("label"))
    rows = cut(where.select("file", "id", "line_no", "copy").join(repeated, "copy").drop("copy"))
    firsts = rows.groupBy("label").agg(F.min(F.struct(F.col("file").isNull().alias("last"), "file", "line_no", "id")).alias("stays"))
    gone = (
        rows.join(firsts, "label")
        .filter((F.col("line_no") != F.col("stays.line_no")) | (F.col("id") != F.col("stays.id")))
        .groupBy("id")
        .agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    )
    told = whole.join(gone, "id", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, k: ~F.array_contains("removed", k)), "\n")
    return told.select(F.col("file").alias(key), "n_lines", "removed", kept.alias("text"))
