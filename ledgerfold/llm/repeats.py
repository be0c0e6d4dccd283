"""Long repeats over all files: sampled suffixes, sorted, and their interval tree."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import words as W
from ledgerfold.llm.near_copies import SEEN, bit_map, sent_once
from ledgerfold.session import cut, ship

LEAST = 400  # bytes
GRAM = 64  # bytes that mark a sampled suffix; a power of two
CHUNK = 1 << 20  # windows of one text that are looked at together
HELD = 4000  # surroundings that are sent on together
CROWD = 50_000  # suffixes with one gram that a task holds at once
_BASE = 0x9E3779B97F4A7C15


# --- sampling: the least gram of every window of LEAST bytes -----------------------
def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place, put together by halves."""
    h, span, power = raw.astype(np.uint64) + np.uint64(1), 1, _BASE
    while span < gram:
        h = h[:-span] * np.uint64(power) + h[span:]
        span, power = 2 * span, power * power & (1 << 64) - 1
    return W.mixed(h)


def anchors(raw: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some window of ``least`` bytes.

    A window holds ``least - gram + 1`` grams; the first of its least ones is
    taken.  The choice looks at the window alone, so a string of ``least`` bytes
    has its anchor at the same place wherever it stands.
    """
    wide = least - gram + 1
    places, hashes = [], []
    for start in range(0, len(raw) - least + 1, CHUNK):
        h = _gram_hashes(raw[start : start + CHUNK + least - 1], gram)
        n = len(h) - wide + 1
        keys = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        full = np.full(-(-len(h) // wide) * wide, np.uint64((1 << 64) - 1))
        full[: len(h)] = keys
        rows = full.reshape(-1, wide)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least_key = np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n])
        changed = np.flatnonzero(np.concatenate([[True], least_key[1:] != least_key[:-1]]))
        at = np.unique((least_key[changed] & np.uint64((1 << 24) - 1)).astype(np.int64))
        places.append(at + start)
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _contexts(raw: bytes, at: np.ndarray, least: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """Start and end of what surrounds each anchor, and its hash."""
    import xxhash

    for place in at.tolist():
        start, end = max(0, place - (least - gram)), min(len(raw), place + least)
        yield start, end, xxhash.xxh3_64_intdigest(raw[start:end], place - start)


def _raw_texts(column: pa.Array) -> Iterator[bytes]:
    """Texts one by one; a batch is never copied as a whole."""
    return (x.as_py() or b"" for x in column)


def _anchored(least: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lengths, places, grams, contexts = [], [], [], [], []
        for id_, raw in zip(batch.column("copy").to_pylist(), _raw_texts(batch.column("raw"))):
            at, hashes = anchors(np.frombuffer(raw, np.uint8), least, gram)
            ids.append(np.full(len(at), id_, np.int64))
            lengths.append(np.full(len(at), len(raw), np.int64))
            places.append(at)
            grams.append(hashes.view(np.int64))
            contexts.append(np.fromiter((c for _, _, c in _contexts(raw, at, least, gram)), np.uint64, len(at)).view(np.int64))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, lengths, places, grams, contexts)], names=["copy", "n_bytes", "at", "gram", "context"])


# --- the interval tree of sorted suffixes -------------------------------------------
def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differing = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differing.bit_length() + 7) // 8


class _Interval:
    """Suffixes under one node: by what stands on their other side, and the ones still unmatched."""

    __slots__ = ("all", "open")

    def __init__(self, member: int):
        self.all, self.open = [member], [member]


def deepest(suffixes: list[bytes], others: list[bytes], least: int) -> list[int]:
    """For each suffix the longest prefix that it shares with a fit partner, else 0.

    ``others`` is what stands on the other side of each place, nearest byte
    first.  Two places fit when their shared prefix and what they share on the
    other side come to ``least`` bytes.  The sorted suffixes and the prefixes
    that neighbours share are scanned with a stack of intervals; an interval that
    closes joins its parent, deepest first, so the first partner found is the
    best.  An interval whose members all share enough on the other side matches
    as a whole; only where the other sides differ are neighbours sought there.
    """
    n = len(suffixes)
    by_other = sorted(range(n), key=others.__getitem__)
    rank = [0] * n
    for k, member in enumerate(by_other):
        rank[member] = k
    side = [others[m] for m in by_other]  # by rank; intervals hold ranks
    found = [0] * n
    order = sorted(range(n), key=suffixes.__getitem__)

    def joined(big: _Interval, small: _Interval, depth: int) -> _Interval:
        if len(big.all) < len(small.all):
            big, small = small, big
        need = least - depth
        first, last = min(big.all[0], small.all[0]), max(big.all[-1], small.all[-1])
        if shared_prefix(side[first], side[last]) >= need:  # no diversity: all fit each other
            for member in (*big.open, *small.open):
                found[member] = depth
            big.open.clear()
            small.open.clear()
        else:
            unmatched = []
            still = set(small.open)
            for member in small.all:
                at = bisect_left(big.all, member)
                near = [big.all[k] for k in (at - 1, at) if 0 <= k < len(big.all)]
                if max(shared_prefix(side[member], side[k]) for k in near) < need:
                    if member in still:
                        unmatched.append(member)
                    continue
                if member in still:
                    found[member] = depth
                at = bisect_left(big.open, member)
                low = at
                while low > 0 and shared_prefix(side[member], side[big.open[low - 1]]) >= need:
                    low -= 1
                    found[big.open[low]] = depth
                high = at
                while high < len(big.open) and shared_prefix(side[member], side[big.open[high]]) >= need:
                    found[big.open[high]] = depth
                    high += 1
                del big.open[low:high]
            small.open = unmatched
        for member in small.all:
            insort(big.all, member)
        for member in small.open:
            insort(big.open, member)
        return big

    stack: list[tuple[int, _Interval]] = []  # depth shared with what comes after, members so far
    for k, member in enumerate(order):
        below = shared_prefix(suffixes[member], suffixes[order[k + 1]]) if k + 1 < n else 0
        current = _Interval(rank[member])
        while stack and stack[-1][0] > below:
            depth, earlier = stack.pop()
            current = joined(earlier, current, depth)
        if stack and stack[-1][0] == below and below:
            depth, earlier = stack.pop()
            current = joined(earlier, current, depth)
        if not below:
            stack.clear()
        else:
            stack.append((below, current))
    return [found[rank[m]] for m in range(n)]


def extents(places: list[tuple[bytes, bytes]], least: int) -> list[tuple[int, int]]:
    """How far left and right of each place repeats reach: ``places`` are (left, right) texts.

    All windows that repeat hold the anchor between them, so they cover one
    stretch: from the farthest left to the farthest right of any fit partner.
    """
    lefts, rights = [left[::-1] for left, _ in places], [right for _, right in places]
    return list(zip(deepest(lefts, rights, least), deepest(rights, lefts, least)))


def _walked(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extents of the contexts of one gram after the other; rows come sorted by gram."""
    now, held, out = None, {}, []

    def close() -> None:
        if len(held) > 1:
            for context, (left, right) in zip(held, extents(list(held.values()), least)):
                if right:  # left is 0 too where a repeat begins at its anchor
                    out.append((now, context, left, right))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[], [], [], []]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["gram", "context", "left", "right"])
        out.clear()
        return made

    for batch in batches:
        for gram, context, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            if gram != now:
                close()
                now, held = gram, {}
            held.setdefault(context, (left, right))
        yield batch_of()
    close()
    yield batch_of()


def _windows(least: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of ``least`` bytes around an anchor, by hash: for grams too crowded for one task."""
    import xxhash

    for batch in batches:
        for mark, context, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            whole = left + right
            reach = range(max(gram, least - len(left)), min(least, len(right)) + 1)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(whole[len(left) + r - least : len(left) + r]) for r in reach), np.uint64, len(reach)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(reach), mark, np.int64)), pa.array(np.full(len(reach), context, np.int64)), pa.array(np.array(reach, np.int64)), pa.array(hashes)],
                names=["gram", "context", "right", "window"],
            )


# --- the operator ---------------------------------------------------------------------
def _surroundings(texts: DataFrame, wanted: DataFrame, least: int, gram: int) -> DataFrame:
    """``(gram, context, left, right)`` of wanted anchors, a few more, some of them twice.

    Texts are sampled once more rather than moved; a bit map tells the anchors.
    """
    bits_of, bits = bit_map(wanted, "context", hashed=True)
    known = texts.sparkSession.sparkContext.broadcast(bits_of)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["gram", "context", "left", "right"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            rows = []
            for raw in _raw_texts(batch.column("raw")):
                if len(rows) > HELD:
                    yield made(rows)
                    rows.clear()
                at, hashes = anchors(np.frombuffer(raw, np.uint8), least, gram)
                for place, mark, (start, end, context) in zip(at.tolist(), hashes.view(np.int64).tolist(), _contexts(raw, at, least, gram)):
                    signed = context - (1 << 64) if context >> 63 else context
                    bit = signed % (1 << bits)
                    if int(known.value[bit >> 6]) >> (bit & 63) & 1 and signed not in seen:
                        seen.add(signed)
                        rows.append((mark, signed, raw[start:place], raw[place:end]))
            if len(seen) > SEEN:
                seen.clear()
            yield made(rows)

    return texts.select("raw").mapInArrow(cut_out, "gram bigint, context bigint, left binary, right binary")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, gone, runs, shas, rests = [], [], [], [], []
        for id_, raw, spans in zip(batch.column("copy").to_pylist(), _raw_texts(batch.column("raw")), batch.column("spans").to_pylist()):
            rest, end, n, removed = [], 0, 0, 0
            for s in sorted((s["start"], s["stop"]) for s in spans):
                if s[1] <= end:
                    continue
                if s[0] > end or not n:
                    rest.append(raw[end : s[0]])
                    n += 1
                removed += s[1] - max(s[0], end)
                end = s[1]
            left = b"".join([*rest, raw[end:]])
            ids.append(id_)
            gone.append(removed)
            runs.append(n)
            shas.append(hashlib.sha256(left).hexdigest())
            rests.append(left)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string()), pa.array(rests, pa.binary())],
            names=["copy", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def repeat_groups(files: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``(copy, n_bytes, start, stop)``: stretches of texts that strings of ``least`` bytes repeat.

    ``files`` is ``(copy, raw)``: a text's bytes and their 64-bit hash.  Suffixes
    are sampled so that equal strings of ``least`` bytes have a sampled suffix at
    the same place; equal surroundings are counted, and of those that differ the
    suffixes of one gram are sorted and walked as a tree of intervals, from either
    side.  A gram with more than ``crowd`` different surroundings is never held by
    one task: all its windows are counted by hash instead, to the same result.
    """
    sampled = cut(files.mapInArrow(lambda b: _anchored(least, gram, b), "copy bigint, n_bytes bigint, at bigint, gram bigint, context bigint"))
    kinds = sampled.groupBy("gram", "context").agg(F.count("*").alias("n"))
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.max("n").alias("most"))
    several = cut(several.filter("kinds > 1 or most > 1").select("gram", "kinds"))
    kinds = cut(kinds.join(several, "gram"))
    around = _surroundings(files, kinds.filter("kinds > 1"), least, gram)
    crowded = cut(several.filter(F.col("kinds") > crowd).select("gram"))
    sides = [("left", "right")]
    calm = around
    if not crowded.isEmpty():
        calm = around.join(crowded, "gram", "left_anti")
        held = around.join(crowded, "gram", "left_semi")
        windows = held.mapInArrow(lambda b: _windows(least, gram, b), "gram bigint, context bigint, right bigint, window bigint")
        alike = windows.groupBy("gram", "right", "window").agg(F.min("context").alias("a"), F.max("context").alias("b")).filter("a <> b")
        reached = windows.join(alike.select("gram", "right", "window"), ["gram", "right", "window"])
        sides.append(reached.groupBy("gram", "context").agg((least - F.min("right")).alias("left"), F.max("right").alias("right")))
    walked = calm.repartition("gram").sortWithinPartitions("gram", "right").mapInArrow(lambda b: _walked(least, b), "gram bigint, context bigint, left bigint, right bigint")
    for more in sides[1:]:
        walked = walked.unionByName(more)
    same = kinds.filter("n > 1").select("gram", "context", F.lit(least).cast("bigint").alias("left"), F.lit(least).cast("bigint").alias("right"))
    found = walked.unionByName(same).groupBy("gram", "context").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    left = F.least("left", "at", F.lit(least - gram))
    right = F.least("right", F.col("n_bytes") - F.col("at"))
    reached = sampled.join(cut(found), ["gram", "context"]).filter(left + right >= least)
    return reached.select("copy", "n_bytes", (F.col("at") - left).alias("start"), (F.col("at") + right).alias("stop")).distinct()


def remove_repeats(files: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD, key: str = "file") -> DataFrame:
    """Files without the bytes of long repeats.

    ``files`` is ``(file, text)``.  Every byte goes that a string of ``least``
    bytes covers which also starts at another place of any text, the same text
    included; strings never reach over the end of a text, and what repeats is told
    from the texts as given.  Returns ``(file, n_bytes, n_removed, n_spans,
    kept_sha256, kept)``: bytes of the text in UTF-8, bytes and runs removed, and
    the remaining bytes put together with their hash.

    A null text is empty; nothing goes from texts shorter than ``least``.  Rows
    that repeat a text lose all of it, if it is long enough.  One row per row of
    ``files``, in any number and with any ``file``, null too; further columns are
    left out.  ``gram`` is a power of two below ``least``.
    """
    ship(files.sparkSession)
    text = F.coalesce("text", F.lit(""))
    base = files.select(F.col(key).alias("file"), F.xxhash64(text).alias("copy"), text.cast("binary").alias("raw"))
    texts = base.select("copy", "raw").filter(F.octet_length("raw") >= least)
    spans = repeat_groups(texts, least, gram, crowd).groupBy("copy").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = cut(spans)
    moved = sent_once(texts, spans.select("copy"), "copy bigint, raw binary")
    less = moved.join(spans, "copy").mapInArrow(_removed, "copy bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    told = base.withColumns({"n_bytes": F.octet_length("raw").cast("bigint"), "sha": F.sha2("raw", 256)}).join(less, "copy", "left")
    none = F.lit(0).cast("bigint")
    return told.select(
        F.col("file").alias(key), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("kept", "raw").alias("kept"),
    )
