"""Files that hold items of a benchmark, found by the q-gram lemma and verified by alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import words as W
from ledgerfold.session import ship

GRAM = 9
BUDGET = 8  # edits per hundred characters of an item
LEAST_BAND = 64  # diagonals
BLOCK_CHARS = 4_000_000  # characters of items that a worker holds at once
FILTER_BITS = 22


def plain(text: str | None) -> str:
    """Lower case, white space runs as one blank."""
    return " ".join((text or "").replace("\0", " ").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Items:
    """An index of the q-grams of items: from a hash to items and places in them."""

    def __init__(self, items: list[tuple[object, str]]):
        named = [(name, p) for name, text in items if (p := plain(text))]
        self.short = [(name, p) for name, p in named if len(p) < GRAM]
        self.long = [(name, p, _codes(p)) for name, p in named if len(p) >= GRAM]
        size = np.array([len(c) for _, _, c in self.long], np.int64)
        # the lemma must leave one shared q-gram at least
        self.budget = np.minimum(size * BUDGET // 100, (size - GRAM) // GRAM)
        self.least = size - GRAM + 1 - GRAM * self.budget
        self.band = np.maximum(LEAST_BAND, 1 << np.ceil(np.log2(self.budget + 1)).astype(np.int64)) if len(size) else size
        hashes = [W.gram_hashes(c, GRAM) for _, _, c in self.long]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[flat >> np.uint64(64 - FILTER_BITS)] = True


def _hits(items: Items, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every shared q-gram of a text with an item: the item, and the diagonal it lies on."""
    hashes = W.gram_hashes(codes, GRAM)
    at = np.flatnonzero(items.filter[hashes >> np.uint64(64 - FILTER_BITS)])
    found = np.searchsorted(items.grams, hashes[at])
    found[found == len(items.grams)] = 0
    same = items.grams[found] == hashes[at]
    at, found = at[same], found[same]
    times = items.times[found]
    entry = np.repeat(items.first[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
    return items.item[entry], np.repeat(at, times) - items.place[entry]


def _regions(items: Items, codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Items and bands of diagonals (by first diagonal) that share enough q-grams.

    Bands of an item overlap by its budget, so that every stretch of budget plus
    one diagonals lies within one of them.
    """
    item, diagonal = _hits(items, codes)
    if not len(item):
        return
    low = -int(items.band.max()) * (int(max(len(c) for _, _, c in items.long)) // int(items.band.min()) + 2)
    band = items.band[item]
    step = (diagonal - low) // band
    again = ((diagonal - low) % band < items.budget[item]) & (step > 0)
    wide = int(step.max()) + 1
    keys = np.concatenate([item * wide + step, item[again] * wide + step[again] - 1])
    keys, counts = np.unique(keys, return_counts=True)
    for key in keys[counts >= items.least[keys // wide]].tolist():
        k, at = divmod(key, wide)
        yield k, int(at * items.band[k] + low)


def aligned(item: np.ndarray, text: np.ndarray, first: int, wide: int, budget: int) -> tuple[int, int] | None:
    """Least edits between an item and any stretch of a text near some diagonals.

    Banded alignment: row by row of the item, over ``wide`` diagonals from
    ``first``.  Returns the edits and the end in the text, or None beyond
    ``budget``.
    """
    far = len(item) + len(text) + 1
    padded = np.concatenate([np.full(max(0, -first), 1 << 31, np.uint32), text, np.full(max(0, first + wide + len(item) - len(text)), 1 << 31, np.uint32)])
    base = max(0, -first) + first
    places = first + np.arange(wide)
    row = np.where((places >= 0) & (places <= len(text)), 0, far)
    along = np.arange(wide)
    for i in range(len(item)):
        over = row + (padded[base + i : base + i + wide] != item[i])  # a letter of each
        skipped = np.append(row[1:] + 1, far)  # a letter of the item alone
        row = np.minimum(over, skipped)
        row = np.minimum.accumulate(row - along) + along  # letters of the text alone
        outside = (places + i + 1 < 0) | (places + i + 1 > len(text))
        row[outside] = far
        if row.min() > budget:
            return None
    best = int(row.argmin())
    return (int(row[best]), first + best + len(item)) if row[best] <= budget else None


def _found_in(items: Items, texts: list[str]) -> list[list[tuple[object, int, int]]]:
    """Per text: items held, edits, and the end of the place."""
    found: list[dict] = [{} for _ in texts]
    joined = "\0".join(texts)
    codes = _codes(joined)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if len(items.long) and len(codes) >= GRAM:
        for k, first in _regions(items, codes):
            name, text, item = items.long[k]
            wide = int(items.band[k] + 2 * items.budget[k] + 1)
            start = first - int(items.budget[k])
            for n in range(int(np.searchsorted(ends, max(start, 0), "right")), min(len(texts), int(np.searchsorted(ends, start + wide + len(item), "right")) + 1)):
                begin = int(ends[n]) - len(texts[n]) - 1
                if len(texts[n]) < len(item) - items.budget[k] or found[n].get(name, (1,))[0] == 0:
                    continue
                low = max(0, start - begin)
                exact = texts[n].find(text, low, max(0, start - begin + wide + len(item)))
                if exact >= 0:
                    found[n][name] = (0, exact + len(item))
                    continue
                near = aligned(item, codes[begin : begin + len(texts[n])], start - begin, wide, int(items.budget[k]))
                if near and near < found[n].get(name, (far_off,)):
                    found[n][name] = near
    for name, text in items.short:
        for n, whole in enumerate(texts):
            at = f" {whole} ".find(f" {text} ")
            if at >= 0:
                found[n][name] = (0, at + len(text))
    return [[(name, *v) for name, v in sorted(f.items(), key=lambda x: str(x[0]))] for f in found]


far_off = 1 << 60


def find_items(files: DataFrame, items: DataFrame, key: str = "file", keep: bool = False) -> DataFrame:
    """Benchmark items that each file's whole text holds, word for word or nearly.

    ``files`` is ``(file, text)``, ``items`` ``(item, text)``.  Returns ``(file,
    found, clean)``: ``found`` is an array of ``(item, edits, end)``, ``end`` a
    place in the text with lower case and single blanks; ``clean`` says it is
    empty.  An item counts as held when a stretch of the text is within 8 edits
    per 100 characters of the whole item (fewer for items below 30 characters;
    items under nine characters must stand between blanks unchanged).

    A stretch within the budget of e edits shares at least m - q + 1 - q e of the
    item's q-grams on e + 1 neighbouring diagonals.  So shared q-grams are counted
    in overlapping bands of diagonals, and the bands that reach the bound are
    aligned.  Nothing is moved: items go to the workers in blocks of bounded size,
    and files meet one block after the other.

    One row per row of ``files``, repeated files included.  Null or blank texts
    hold nothing and null or blank items are held by nothing; of items with one
    name each is looked for and the best place is told.  Empty ``items`` leave
    every file clean.  Further columns are left out; with ``keep`` the text stays.
    """
    spark = files.sparkSession
    ship(spark)
    kind, named = files.schema[key].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    found_type = f"array<struct<item:{named},edits:int,end:bigint>>"
    shape = f"`{key}` {kind}, text string, found {found_type}"
    current = files.select(key, "text", F.array().cast(found_type).alias("found"))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).select("item", "text").collect()
        known = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in rows])

        last = block == blocks - 1 and not keep  # after it the texts are done with

        def search(batches: Iterator[pa.RecordBatch], known=known, last=last) -> Iterator[pa.RecordBatch]:
            index = Items(known.value)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                out = batch.column("found").to_pylist()
                for a, b in W.slices(texts):
                    for n, more in enumerate(_found_in(index, [plain(t) for t in texts[a:b]]), a):
                        out[n] = [*out[n], *({"item": i, "edits": e, "end": at} for i, e, at in more)]
                done = pa.RecordBatch.from_arrays([batch.columns[0], batch.column("text"), pa.array(out, batch.column("found").type)], names=batch.schema.names)
                yield done.select([0, 2]) if last else done

        current = current.mapInArrow(search, shape.replace(", text string", "", 1) if last else shape)
    return current.select(key, *(["text"] if keep else []), "found", (F.size("found") == 0).alias("clean"))
