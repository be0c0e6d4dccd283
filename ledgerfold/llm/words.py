"""Vectorised helpers that run inside tasks: word tables, n-gram hashes, sums by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow as pa

SLICE = 1 << 21  # characters handled at once


class WordTable:
    """Values of words, worked out once per word and then looked up.

    ``work_out`` gives arrays, one row per new word.  When the table holds
    ``limit`` words the later ones are forgotten and the first third, among which
    the frequent ones are, stays; so memory is bounded, and results never depend
    on it.
    """

    def __init__(self, work_out: Callable[[list], tuple[np.ndarray, ...]], limit: int = 200_000):
        self.work_out, self.limit = work_out, limit
        self.at: dict = {}
        self.columns: list[np.ndarray] = []

    def rows(self, words: list) -> np.ndarray:
        """Row number of every word; ``columns`` has the values of the rows."""
        if len(self.at) > self.limit:
            self.at = {w: row for w, row in self.at.items() if row < self.limit // 3}
        rows = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            missed = [words[i] for i in unknown.tolist()]
            fresh = list(dict.fromkeys(missed))
            start = len(self.at)
            self.at.update(zip(fresh, range(start, start + len(fresh))))
            self._store(start, self.work_out(fresh))
            rows[unknown] = np.fromiter(map(self.at.__getitem__, missed), np.int64, len(unknown))
        return rows

    def _store(self, start: int, values: tuple[np.ndarray, ...]) -> None:
        if not self.columns:
            self.columns = [np.empty((0, *v.shape[1:]), v.dtype) for v in values]
        for k, v in enumerate(values):
            end = start + len(v)
            if end > len(self.columns[k]):
                grown = np.empty((max(end, 2 * len(self.columns[k])), *v.shape[1:]), v.dtype)
                grown[:start] = self.columns[k][:start]
                self.columns[k] = grown
            self.columns[k][start:end] = v


def slices(texts: list[str | None], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` (or ``SLICE``) characters each, one row at least."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > (most or SLICE):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def parts_of(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts with at most ``most`` bytes of text each, one row at least; nothing is copied."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        room = most + (ends[start - 1] if start else 0)
        end = max(start + 1, int(np.searchsorted(ends, room, "right")))
        yield batch.slice(start, end - start)
        start = end


def row_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``lengths`` values; an empty run sums to 0."""
    out = np.zeros((len(lengths), *values.shape[1:]), values.dtype)
    full = lengths > 0
    if full.any():
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes that start at each place (n places fewer than codes, plus one)."""
    total = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += codes[k : k + len(total)]
        total += np.uint64(1)
    return mixed(total + np.uint64(n))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and each word's length."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.fromiter(map(len, words), np.int64, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def inside(lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start places of the n-grams that lie within one word, and their words' numbers."""
    counts = np.maximum(lengths - n + 1, 0)
    word = np.repeat(np.arange(len(lengths)), counts)
    first = np.repeat(np.cumsum(lengths) - lengths, counts)
    return first + np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts), word


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
