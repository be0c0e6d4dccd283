"""Near copies of files by min-max hashing of word pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import words as W
from ledgerfold.llm.components import connected
from ledgerfold.session import cut, ship

LEAST = 80  # per cent of the union that two sets must share
BANDS, PER_BAND = 24, 2  # permutations per band; each gives a minimum and a maximum
BLOCK = 512  # members of a bucket that are compared with as many others at once
SAME = 1 << 30  # side of members that are compared with their own block
MARGIN = 0.3  # below the threshold, of signatures of WIDTH values; of two million simulated links at it none fell short by more than 0.22
WIDTH = 96
_DICE = np.random.default_rng(20)
_FACTORS = _DICE.integers(1, 1 << 31, BANDS * PER_BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _DICE.integers(0, 1 << 32, BANDS * PER_BAND, dtype=np.uint32)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` words in a row; of all words where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(W.gram_hashes(W.word_hashes(words), min(width, len(words))))


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the hashes under each permutation, side by side."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    least, most = None, None
    for start in range(0, len(short), 1 << 15):
        moved = _FACTORS[:, None] * short[None, start : start + (1 << 15)] + _SHIFTS[:, None]
        low, high = moved.min(axis=1), moved.max(axis=1)
        least = low if least is None else np.minimum(least, low)
        most = high if most is None else np.maximum(most, high)
    return np.stack([least, most], axis=1)


def signatures(found: list[np.ndarray]) -> pa.Array:
    """The last byte of every value of the signatures, a row per set.

    Values that are the same agree in it, and one in 256 of the others: two rows
    never seem less near than the signatures are, and take a quarter of the room.
    """
    out = np.empty((len(found), BANDS * PER_BAND, 2), np.uint8)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths)
    for a, b in _runs(lengths, 1 << 16):
        short = (np.concatenate(found[a:b]) >> np.uint64(32)).astype(np.uint32)
        starts = (ends - lengths)[a:b] - (ends - lengths)[a]
        for k in range(BANDS * PER_BAND):
            moved = short * _FACTORS[k] + _SHIFTS[k]
            out[a:b, k, 0] = np.minimum.reduceat(moved, starts) & np.uint32(0xFF)
            out[a:b, k, 1] = np.maximum.reduceat(moved, starts) & np.uint32(0xFF)
    return pa.array([x.tobytes() for x in out], pa.binary())


def _runs(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` values at most, one row at least."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        room = most + (ends[start - 1] if start else 0)
        end = max(start + 1, int(np.searchsorted(ends, room, "right")))
        yield start, end
        start = end


def band_keys(signed: np.ndarray) -> np.ndarray:
    wide = signed.reshape(BANDS, 2 * PER_BAND).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(wide.shape[1]):
        key = W.mixed(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, k])
    return key.view(np.int64)


def _banded(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, signed = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text, width)
            sizes.append(len(found))
            whole = signature(found) if len(found) else None
            keys.append(band_keys(whole) if len(found) else np.empty(0, np.int64))
            signed.append((whole & np.uint32(0xFF)).astype(np.uint8).tobytes() if len(found) else None)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32), pa.array(np.concatenate(keys or [np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("copy"), pa.array(sizes, pa.int64()), lists, pa.array(signed, pa.binary())], names=["file", "copy", "n_shingles", "bands", "signed"])


def _signed_texts(grams_of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("copy"), signatures(grams_of(batch.column("text").to_pylist()))], names=["copy", "signed"])


def similar(shared, first, second):
    """Whether ``shared`` of two sets of the given sizes reach the threshold."""
    return 100 * shared >= LEAST * (first + second - shared)


class _Forest:
    """Union-find over the members of one block."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(x, k) for k, x in enumerate(labels)]

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k


NEAR_AT_ONCE = 1 << 15  # pairs of signatures that are compared at once
ROWS_OUT = 5_000  # rows of a batch that a worker sends


def _blocks(batches: Iterator[pa.RecordBatch], payload) -> Iterator[tuple[tuple, list[list]]]:
    """Columns side, copy, label and payload of rows sorted by block pair, one pair of blocks in memory at a time."""
    now, held = None, None
    for batch in batches:
        at = np.stack([batch.column(c).to_numpy() for c in ("band", "low", "high")], axis=1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)] if len(at) else [0]
        columns = [*(batch.column(c).to_pylist() for c in ("side", "copy", "label")), payload(batch)]
        for a, b in zip(cuts, cuts[1:]):
            part = [c[a:b] for c in columns]
            if now == (new := tuple(at[a].tolist())):
                held = [x + y for x, y in zip(held, part)]
                continue
            if held:
                yield now, held
            now, held = new, part
    if held:
        yield now, held


def _signed(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("signed").to_pylist()


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column("text").to_pylist()


def _texts_and_signed(batch: pa.RecordBatch) -> list[tuple[str, bytes | None]]:
    return list(zip(_texts(batch), _signed(batch) if "signed" in batch.schema.names else [None] * batch.num_rows))


def _rows_of(signed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signed), np.uint8).reshape(len(signed), -1)


def _numbered(labels: list) -> np.ndarray:
    first: dict = {}
    return np.array([first.setdefault(x, len(first)) for x in labels])


def _seem_near(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether rows of signatures agree on so much that their sets may be near copies; shorter ones, which tell less, on less."""
    margin = MARGIN * max(1, WIDTH / first.shape[1]) ** 0.5
    return (first == second).mean(axis=1) >= LEAST / 100 - margin


def _seeming(shape: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a head and a member whose signatures seem near."""
    for batch in batches:
        if batch.num_rows:
            first, second = (_rows_of(batch.column(c).to_pylist()) for c in ("own", "signed"))
            yield batch.filter(pa.array(_seem_near(first, second))).select(shape.names)


def _near(signed: np.ndarray, side: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members, by the first, that are of two labels, may be compared, and seem near."""
    n = len(signed)
    for start in range(0, n, step := max(1, NEAR_AT_ONCE // n)):
        own = slice(start, start + step)
        open_ = (label[own, None] != label) & ((side[own, None] != side) | (side[own, None] == SAME))
        first, second = np.nonzero(np.triu(open_, start + 1))
        for a in range(0, len(first), NEAR_AT_ONCE):
            one, other = first[a : a + NEAR_AT_ONCE] + start, second[a : a + NEAR_AT_ONCE]
            seem = _seem_near(signed[one], signed[other])
            yield one[seem], other[seem]


def _gathered(rows: list[list], shape: pa.Schema, least: int) -> Iterator[pa.RecordBatch]:
    """Rows so far as one batch, once there are ``least``; few large batches cost less than one per bucket."""
    if len(rows) >= least:
        yield W.as_batch(shape, *([list(c) for c in zip(*rows)] or [[] for _ in shape]))
        rows.clear()


def _active(shape: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block pair the members that seem near to one of another label."""
    out: list = []
    for at, (sides, copies, labels, signed) in _blocks(batches, _signed):
        kept = np.zeros(len(sides), bool)
        for first, second in _near(_rows_of(signed), np.array(sides), _numbered(labels)):
            kept[first] = kept[second] = True
        out += [(*at, sides[k], copies[k], labels[k], signed[k])[: len(shape)] for k in np.flatnonzero(kept).tolist()]
        yield from _gathered(out, shape, ROWS_OUT)
    yield from _gathered(out, shape, 1)


def _links_of_blocks(grams_of, shape: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between members that no earlier link of the block pair joins, one per join."""
    out: list = []
    for _, (sides, copies, labels, held) in _blocks(batches, _texts_and_signed):
        sets = [distinct(x) for x in grams_of([text for text, _ in held])]
        signed = [x for _, x in held] if held[0][1] is not None else signatures(sets).to_pylist()
        label = _numbered(labels)
        forest = _Forest(label.tolist())
        for first, second in _near(_rows_of(signed), np.array(sides), label):
            for k, m in zip(first.tolist(), second.tolist()):
                a, b = forest.root(k), forest.root(m)
                if a != b and alike(sets[k], sets[m]):
                    forest.up[max(a, b)] = min(a, b)
                    out.append((copies[k], copies[m]))
        yield from _gathered(out, shape, ROWS_OUT)
    yield from _gathered(out, shape, 1)


def alike(first: np.ndarray, second: np.ndarray) -> bool:
    """Whether two sets are near copies; sizes that can't be are told without looking further."""
    low, high = sorted((len(first), len(second)))
    if 100 * low < LEAST * high:
        return False
    at = np.minimum(first.searchsorted(second), len(first) - 1)
    return similar(int(np.count_nonzero(first[at] == second)), low, high)


def distinct(found: np.ndarray) -> np.ndarray:
    """The values, sorted, each once: ``np.unique`` without its checks, which cost more than the sort of a line."""
    found = np.sort(found)
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def _links_to_heads(grams_of, shape: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between a bucket's first member and others; rows of a head come together, its own first."""
    now, own, links = None, None, []
    for batch in batches:
        heads, members, sides = (batch.column(c).to_pylist() for c in ("head", "copy", "side"))
        texts = _texts(batch)
        for a, b in W.slices(texts, 1 << 18):
            for k, found in enumerate(grams_of(texts[a:b]), a):
                found = distinct(found)
                if sides[k] == 0:
                    now, own = heads[k], found
                elif now == heads[k] and alike(own, found):
                    links.append((heads[k], members[k]))
        yield from _gathered(links, shape, ROWS_OUT)
    yield from _gathered(links, shape, 1)


def _rest_of_links(members: DataFrame, labels: DataFrame, bodies, grams_of, key_type: str, signed: DataFrame | None = None) -> DataFrame:
    """Links inside buckets whose members are not yet of one component.

    Members of such a bucket are dealt into blocks, those of its largest component
    apart from the rest, and blocks are compared pair by pair inside tasks, but
    never two of the largest component: by signatures first, which leaves the members that seem
    near to one of another component, and those on full sets.  What comes out
    joins components, it isn't all pairs.  Buckets with the same members, told by
    two hashes over them, are compared once.  ``bodies`` is ``(copy, text)``, or
    gives it for the members asked for; ``signed`` is ``(copy, signed)``, if that is there.
    """
    named = members.join(labels, F.col("copy") == F.col("node"), "left").select("band", "copy", F.coalesce("component", "copy").alias("label"))
    marks = [F.bit_xor(F.xxhash64("copy", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    shares = named.groupBy("band", "label").agg(F.count("*").alias("n"), *marks)
    marks = [F.bit_xor(f"mark{k}").alias(f"mark{k}") for k in (1, 2)]
    largest = shares.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), *marks)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    once = largest.filter(F.col("n") > F.col("top.n")).groupBy("n", "mark1", "mark2").agg(F.min(F.struct("band", "top")).alias("least"))
    open_ = once.select("least.*", "n").select(
        "band", F.col("top.label").alias("top"), blocks(F.col("top.n")).alias("tops"), blocks(F.col("n") - F.col("top.n")).alias("rests")
    )
    # members of the largest component have blocks below zero and meet the others only
    of_top = F.col("label") == F.col("top")
    block = F.when(of_top, -1 - F.pmod(F.xxhash64("copy"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("copy"), F.col("rests"))).cast("int")
    dealt = cut(named.join(open_, "band").withColumn("block", block))
    rests = F.sequence(F.lit(0), F.col("rests") - 1)
    met = dealt.withColumn("other", F.explode(F.when(of_top, rests).otherwise(F.concat(F.sequence(-F.col("tops"), F.lit(-1)), rests))))
    pairs = met.select(
        "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("block") == F.col("other"), SAME).otherwise(F.col("block")).alias("side"), "copy", "label",
    )
    together = lambda rows: rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "copy")
    kind = _KINDS[key_type]
    shape = pa.schema([("band", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("side", pa.int32()), ("copy", kind), ("label", kind), ("signed", pa.binary())])
    if signed is None:
        asked = bodies.select("copy", "text").join(dealt.select("copy").distinct(), "copy", "left_semi")
        signed = asked.mapInArrow(lambda b: _signed_texts(grams_of, b), f"copy {key_type}, signed binary")
    placed = together(pairs.join(signed, "copy"))
    active = cut(placed.mapInArrow(lambda b: _active(shape, b), f"band bigint, low int, high int, side int, copy {key_type}, label {key_type}, signed binary"))
    bodies = bodies(active.select("copy").distinct()) if callable(bodies) else bodies
    whole = together(active.join(bodies.select("copy", "text"), "copy"))
    ends = pa.schema([("a", kind), ("b", kind)])
    return whole.mapInArrow(lambda b: _links_of_blocks(grams_of, ends, b), f"a {key_type}, b {key_type}")


_KINDS = {"bigint": pa.int64(), "binary": pa.binary()}
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 30  # bits of a map for a key; powers of two at least and at most
MAP_WORDS = 1 << 12  # words of 64 bits in a row of the map
SEEN = 500_000  # members that a task remembers to send on once


def place(name: str, bits: int, hashed: bool = False) -> Column:
    """Bit of a key; one that is a 64-bit hash already is taken as it is."""
    return F.pmod(F.col(name) if hashed else F.xxhash64(name), F.lit(1 << bits))


def bit_map(keys: DataFrame, name: str, hashed: bool = False) -> tuple[np.ndarray, int]:
    """A bit map of the keys in column ``name`` and the power of two of its bits.

    Its size follows the number of keys, up to 128 MB; it is put together by the
    tasks in rows of 32 KB, so that the driver only lays them side by side.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(BITS_EACH * max(keys.count(), 1))))))
    placed = keys.select(place(name, bits, hashed).alias("at"))
    words = placed.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    chunked = words.withColumn("chunk", F.floor(F.col("word") / MAP_WORDS)).repartition("chunk").sortWithinPartitions("chunk")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["chunk", "bits"])

        for batch in batches:
            for chunk, word, some in zip(*(batch.column(c).to_pylist() for c in ("chunk", "word", "bits"))):
                if chunk != now:
                    if now is not None:
                        yield out()
                    now, held = chunk, np.zeros(MAP_WORDS, np.int64)
                held[word % MAP_WORDS] = some
        if now is not None:
            yield out()

    whole = np.zeros(max(MAP_WORDS, 1 << (bits - 6)), np.int64)
    for r in chunked.mapInArrow(rows, "chunk bigint, bits binary").collect():  # one job; an iterator would be one per partition
        whole[r["chunk"] * MAP_WORDS : (r["chunk"] + 1) * MAP_WORDS] = np.frombuffer(r["bits"], np.int64)
    return whole.view(np.uint64), bits


def _hit(known: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (known[at >> 6] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def held_back(rows: DataFrame, wanted: DataFrame, name: str, shape: str) -> DataFrame:
    """Rows whose key ``name`` is among ``wanted``, and few others: a bit map drops most before a join."""
    bits_of, bits = bit_map(wanted, name)
    known = rows.sparkSession.sparkContext.broadcast(bits_of)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _hit(known.value, batch.column("__at").to_numpy())
            yield batch.filter(pa.array(hit)).select(batch.schema.names[:-1])

    return rows.filter(F.col(name).isNotNull()).withColumn("__at", place(name, bits)).mapInArrow(passing, shape)


def _in_buckets(banded: DataFrame, heads: DataFrame, key_type: str) -> DataFrame:
    """``(copy, band)`` of ``(copy, bands)`` for the buckets of ``heads``, and few others."""
    bits_of, bits = bit_map(heads, "band", hashed=True)
    known = banded.sparkSession.sparkContext.broadcast(bits_of)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bands")
            keys = lists.flatten()
            hit = _hit(known.value, keys.to_numpy(zero_copy_only=False) & np.int64((1 << bits) - 1))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("copy").take(pa.array(owner[hit])), keys.filter(pa.array(hit))], names=["copy", "band"])

    return banded.select("copy", "bands").mapInArrow(passing, f"copy {key_type}, band bigint")


def sent_once(rows: DataFrame, wanted: DataFrame, shape: str) -> DataFrame:
    """One row each of ``rows`` ``(copy, ...)`` for the members ``wanted``, and few others moved.

    A bit map goes to the workers and holds most others back before the shuffle;
    the join after it is exact.
    """
    bits_of, bits = bit_map(wanted, "copy")
    known = rows.sparkSession.sparkContext.broadcast(bits_of)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            hit = _hit(known.value, batch.column("__at").to_numpy())
            batch = batch.filter(pa.array(hit)).select(batch.schema.names[:-1])
            keys, fresh = batch.column("copy").to_pylist(), []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    fresh.append(k)
            if len(seen) > SEEN:
                seen.clear()
            yield batch.take(pa.array(fresh, pa.int64()))

    moved = rows.filter(F.col("copy").isNotNull()).withColumn("__at", place("copy", bits)).mapInArrow(once, shape)
    return moved.join(wanted, "copy", "left_semi").dropDuplicates(["copy"])


def groups_of(banded: DataFrame, texts_of, grams_of, key_type: str = "binary") -> DataFrame:
    """``(node, component)`` of members that share buckets: ``banded`` is ``(copy, bands, signed)``, with
    band keys that are hashes and signatures in bytes.

    Repeated rows are one.  ``texts_of`` gives ``(copy, text)`` for the members asked for and ``grams_of``
    the shingles of a list of texts.  Texts are moved, not shingles, which take
    eight times their room.  The first member of every bucket is found by a
    map-side aggregate; the others whose signatures seem near are compared with it
    on full sets, those of one head in blocks; most members share a bucket by
    chance, the more so the larger the input, and no text of theirs is moved.  Where the others are of several components after that, they
    are compared in pairs of blocks, without the first, which has met all.
    """
    kind = _KINDS[key_type]
    heads = banded.select("copy", F.explode("bands").alias("band")).groupBy("band").agg(F.min("copy").alias("head"), F.max("copy").alias("last"))
    heads = cut(heads.filter("head <> last").select("band", "head"))
    met = _in_buckets(banded, heads, key_type).join(heads, "band")
    members = cut(met.select("band", "head", "copy").distinct())
    pairs = cut(members.filter("copy <> head").select("head", "copy").distinct())
    wanted = cut(pairs.select(F.explode(F.array("head", "copy")).alias("copy")).distinct())
    signed = cut(sent_once(banded.select("copy", "signed"), wanted, f"copy {key_type}, signed binary"))
    own = signed.select(F.col("copy").alias("head"), F.col("signed").alias("own"))
    ends = pa.schema([("head", kind), ("copy", kind)])
    pairs = cut(pairs.join(signed, "copy").join(own, "head").mapInArrow(lambda b: _seeming(ends, b), f"head {key_type}, copy {key_type}"))
    bodies = cut(texts_of(pairs.select(F.explode(F.array("head", "copy")).alias("copy")).distinct()))
    sizes = pairs.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(sizes, "head").withColumn("block", F.pmod(F.xxhash64("copy"), F.col("blocks")).cast("int"))
    own = sizes.select("head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("head").alias("copy"))
    rows = dealt.select("head", "block", F.lit(1).alias("side"), "copy").unionByName(own).join(bodies, "copy")
    together = rows.repartition("head", "block").sortWithinPartitions("head", "block", "side").select("head", "copy", "side", "text")
    ends = pa.schema([("a", kind), ("b", kind)])
    links = cut(together.mapInArrow(lambda b: _links_to_heads(grams_of, ends, b), f"a {key_type}, b {key_type}"))
    labels = connected(links)
    rest = cut(_rest_of_links(members.filter("copy <> head").select("band", "copy"), labels, texts_of, grams_of, key_type, signed))
    if rest.isEmpty():
        return labels
    return connected(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))


def copy_of(text: str) -> Column:
    """Hash that the rows of one text share."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def near_copies(files: DataFrame, width: int = 5) -> DataFrame:
    """Groups of near copies among ``files`` ``(file, text)``.

    Two texts are linked when the sets of their ``width``-word shingles, A-Z in
    lower case, share at least 80 per cent of their union; groups are what links
    connect.  Returns ``(file, n_shingles, component_id, kept)``, one row per row
    of ``files``: ``component_id`` is the smallest ``file`` of the group and
    ``kept`` marks it.  A text with fewer words is one shingle; one without words
    (or null) is linked with nothing and kept.  Rows with a null ``file`` count
    as members but name no group; a group of such rows alone keeps them all.
    Repeated rows get the same answer each.  Further columns are left out.

    Each permutation gives its minimum and its maximum, so that half the hash
    evaluations fill the bands.  In every bucket of a band all members are
    compared with the bucket's first, on full sets; buckets whose members are
    still of several components are then compared in blocks.  Texts that are the
    same to the byte are one member, whatever their number.
    """
    return judged_copies(files, width).drop("copy")


def judged_copies(files: DataFrame, width: int = 5) -> DataFrame:
    """``near_copies`` with a column ``copy``, see ``copy_of``: rows of one ``file`` may differ in text."""
    ship(files.sparkSession)
    texts = files.select("file", "text", copy_of("text").alias("copy"))
    kind = files.schema["file"].dataType.simpleString()
    signed = cut(texts.mapInArrow(lambda b: _banded(width, b), f"file {kind}, copy binary, n_shingles bigint, bands array<bigint>, signed binary"))
    distinct = cut(signed.filter("n_shingles > 0").groupBy("copy").agg(F.first("bands").alias("bands"), F.first("signed").alias("signed"), F.min("file").alias("first")))
    one_each = lambda wanted: sent_once(texts.select("copy", "text"), wanted, "copy binary, text string")
    labels = groups_of(distinct.select("copy", "bands", "signed"), one_each, lambda found: [shingles(t, width) for t in found])
    named = cut(distinct.join(labels, F.col("copy") == F.col("node"), "left").select("copy", "first", F.coalesce("component", "copy").alias("label")))
    groups = named.groupBy("label").agg(F.min("first").alias("component_id"))
    found = signed.select("file", "copy", "n_shingles").join(named.join(groups, "label").select("copy", "component_id"), "copy", "left")
    alone = F.col("n_shingles") == 0
    group = F.when(alone, F.col("file")).otherwise(F.col("component_id"))
    return found.select("file", "copy", "n_shingles", group.alias("component_id"), (alone | F.col("file").eqNullSafe(group)).alias("kept"))
