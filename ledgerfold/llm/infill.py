"""Fill-in-middle order of file texts, by rotating blocks inside one byte array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.session import ship

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(text: bytes) -> np.ndarray:
    """Where units end: each word with the white space before it, and white space at the end."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text)) if len(text) else ends


def n_chars(text: bytes | memoryview) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def _reverse(array: np.ndarray, start: int, stop: int) -> None:
    half = (stop - start) // 2
    left, right = array[start : start + half], array[stop - half : stop][::-1]
    left[:], right[:] = right.copy(), left.copy()


def rotate(array: np.ndarray, start: int, middle: int, stop: int) -> None:
    """Exchange the blocks ``start:middle`` and ``middle:stop`` in place, by three reversals."""
    _reverse(array, start, middle)
    _reverse(array, middle, stop)
    _reverse(array, start, stop)


def arranged(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text cut at two bytes, with sentinels put in and its blocks in the order of ``form``."""
    out = bytearray(text)
    # from the last to the first, so that the places before stay as they are
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        out[at:at] = sentinel
    array = np.frombuffer(out, np.uint8)
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    if form == "psm":
        rotate(array, middle, suffix, len(out))
    else:  # spm: the suffix before everything else
        rotate(array, 0, suffix, len(out))
    return out


def restored(output: bytes, form: str) -> bytes:
    """The text that ``arranged`` made ``output`` of: the same rotations undone, sentinels taken out."""
    if form == "plain":
        return output
    out = bytearray(output)
    if form == "psm":
        suffix, middle = out.index(SUFFIX), out.index(MIDDLE)
        rotate(np.frombuffer(out, np.uint8), suffix, middle, len(out))
    else:
        rotate(np.frombuffer(out, np.uint8), 0, out.index(PREFIX), len(out))
    for sentinel in SENTINELS:
        at = out.index(sentinel)
        out[at : at + len(sentinel)] = b""
    return bytes(out)


def _bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary())


def _turned(rate: int, spm_rate: int, shape: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, draws = _bytes(batch.column("text")), batch.column("draws")
        counts, forms, before, between, outputs = [], [], [], [], []
        for k in range(batch.num_rows):
            text = texts[k].as_py() or b""
            h1, h2, h3, h4 = (int(draws[k].as_py()[at : at + 8], 16) for at in (0, 8, 16, 24))
            ends = unit_ends(text)
            n = len(ends)
            counts.append(n)
            if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
                forms.append("plain"), before.append(None), between.append(None), outputs.append(text)
                continue
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            first, second = (int(ends[x - 1]) if x else 0 for x in (low, high))
            forms.append("spm" if h4 % 100 < spm_rate else "psm")
            before.append(n_chars(text[:first])), between.append(n_chars(text[first:second]))
            outputs.append(bytes(arranged(text, first, second, forms[-1])))
        values = [pa.array(x, f.type) for x, f in zip((counts, forms, before, between), list(shape)[1:5])]
        yield pa.RecordBatch.from_arrays([batch.column("file"), *values, pa.array(outputs, pa.binary()).cast(pa.string())], names=shape.names)


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        outputs, forms = _bytes(batch.column("output")), batch.column("form").to_pylist()
        texts = [None if o is None else restored(o, form) for o, form in zip((outputs[k].as_py() for k in range(batch.num_rows)), forms)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "text"])


def draws_of(file: Column, seed: int) -> Column:
    """Hex digits that a file's cuts and form are drawn from; a null file counts as an empty name."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(file.cast("string"), F.lit(""))), 256)


def infill_files(files: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """Texts of landed files reordered, so that a model learns to fill in their middle.

    ``files`` is ``(file, text)``.  Returns ``(file, n, form, prefix_chars,
    middle_chars, output)``, one row per row.  A text's ``n`` units are its words,
    each with the white space before it, and white space at its end.  Two cuts
    between units, drawn from the hash of ``seed`` and ``file``, make prefix,
    middle and suffix, any of which may be empty.  ``form`` is ``psm``
    (``<P>`` prefix ``<S>`` suffix ``<M>`` middle), ``spm`` (``<S>`` suffix
    ``<P>`` prefix ``<M>`` middle) or ``plain`` (the text as it is); ``rate`` per
    cent of the texts are not plain, and ``spm_rate`` per cent of those are spm.

    A null text counts as empty; an empty text and one that holds a sentinel are
    plain, with null lengths.  Repeated rows get the same answer each, a null
    ``file`` draws like an empty name, and further columns are left out.  A task
    holds a batch of texts, and one more copy of the text at hand.
    """
    ship(files.sparkSession)
    kind = files.schema["file"].dataType.simpleString()
    drawn = files.select("file", "text", draws_of(F.col("file"), seed).alias("draws"))
    shape = pa.schema([("file", pa.null()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    out = f"file {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return drawn.mapInArrow(lambda b: _turned(rate, spm_rate, shape, b), out)


def restore_files(turned: DataFrame) -> DataFrame:
    """The texts that ``infill_files`` reordered, to the byte: its rows with a column ``text``.

    Only ``output`` and ``form`` are looked at; a null output gives a null text.
    Further columns are kept.
    """
    ship(turned.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turned.schema)
    return turned.mapInArrow(_back, f"{kinds}, text string")
