"""Phrases whose words stand together more often than their parts would suggest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm import words as W
from ledgerfold.session import cut, ship

LONGEST = 4
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
SCORE = 2_000_000
NO_KIND = "und"

COUNTER_BITS = 28  # of the space of hashed counts; it saves shuffle, results don't depend on it
CHUNK = 1 << 16  # counters in one row on the way
KEYS = 1 << 22  # phrases hashed before they are counted and sent on
PART = 1 << 21  # bytes of text handled at once

_SPACE, _BREAK, _WORD = 0, 1, 2
_CLASS = np.full(256, _WORD, np.uint8)
_CLASS[[0x20, 0x09]] = _SPACE
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Part:
    """Words of a stretch of text: their bytes, hashes, kinds, and whether the next word follows in the same piece."""

    def __init__(self, data: np.ndarray, owner_starts: np.ndarray, kinds: np.ndarray):
        classes = _CLASS[data]
        word = classes == _WORD
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        self.data, self.starts, stops = _LOWER[data], edges[0::2], edges[1::2]
        self.lengths = stops - self.starts
        breaks = np.cumsum(classes == _BREAK)[self.starts] if len(self.starts) else np.empty(0, np.int64)
        self.follows = np.append(breaks[1:] == breaks[:-1], False)[: len(breaks)]
        self.kinds = kinds[np.searchsorted(owner_starts, self.starts, "right") - 1]
        self.hashes = self._hashes(word) if len(self.starts) else np.empty(0, np.uint64)

    def _hashes(self, word: np.ndarray) -> np.ndarray:
        offsets = np.cumsum(self.lengths) - self.lengths
        codes = self.data[word].astype(np.uint64) + np.uint64(1)
        powers = np.multiply.accumulate(np.full(int(self.lengths.max()), np.uint64(0xD6E8FEB86659FD93)))
        codes *= powers[np.arange(len(codes)) - np.repeat(offsets, self.lengths)]
        return W.mixed(np.add.reduceat(codes, offsets) + self.lengths.astype(np.uint64) * _ODD)

    def leads(self, values: np.ndarray, k: int, fill) -> np.ndarray:
        """``values`` of the words ``k`` places on."""
        return np.append(values[k:], np.full(min(k, len(values)), fill, values.dtype))

    def beginnings(self, kind_hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``LONGEST`` words from every word on: their counter, and whether they are within one piece."""
        key, whole = W.mixed(self.hashes + kind_hashes[self.kinds]), np.ones(len(self.hashes), bool)
        for k in range(1, LONGEST + 1):
            if k > 1:
                key = W.mixed(key * _ODD + self.leads(self.hashes, k - 1, 0))
                whole = whole & self.leads(self.follows, k - 2, False)
            yield (key >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), whole

    def strings(self, at: np.ndarray) -> pa.Array:
        """Texts of the words at ``at``, and an empty one after them."""
        lengths, starts = self.lengths[at], self.starts[at]
        ends = np.cumsum(lengths)
        places = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
        offsets = np.concatenate([[0], ends, ends[-1:] if len(ends) else [0]]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at) + 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data[places].tobytes()))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[Part, list, np.ndarray]]:
    """Parts of a batch's texts, cut between pieces, with the names of kinds and their hashes."""
    column = batch.column("kind").dictionary_encode()
    names, kinds = column.dictionary.to_pylist(), column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = W.word_hashes([n.encode("utf-8", "surrogatepass") for n in names])
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data, owners = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.cumsum(lengths) - lengths
    del texts
    at = 0
    while at < len(data):
        end = look = min(at + PART, len(data))
        while look < len(data):  # on to the next end of a piece
            found = np.flatnonzero(_CLASS[data[look : look + 4096]] == _BREAK)
            end = look = look + (int(found[0]) + 1 if len(found) else 4096)
            if len(found):
                break
        end = min(end, len(data))
        first = int(np.searchsorted(owners, at, "right")) - 1
        last = int(np.searchsorted(owners, end, "left"))
        yield Part(data[at:end], owners[first:last] - at, kinds[first:last]), names, hashes
        at = end


class Often:
    """Whether the counter of a phrase is often found: a bit each, of packed chunks."""

    def __init__(self, chunks: list[tuple[int, bytes]]):
        self.bits = np.zeros((1 << COUNTER_BITS) // 8, np.uint8)
        for chunk, bits in chunks:
            at = chunk * CHUNK // 8
            self.bits[at : at + CHUNK // 8] |= np.frombuffer(zlib.decompress(bits), np.uint8)

    def __getitem__(self, counter: np.ndarray) -> np.ndarray:
        return (self.bits[counter >> 3] >> (7 - (counter & 7)).astype(np.uint8) & 1).astype(bool)


def _packed(keys: np.ndarray) -> pa.RecordBatch:
    """Counters that occur, up to 255 times each, by chunk: bytes of the steps between them, then of their counts."""
    keys.sort()
    opens = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    times = np.minimum(255, np.diff(opens, append=len(keys))).astype(np.uint8)
    chunks, places = np.divmod(keys[opens], np.uint32(CHUNK))
    edges = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])[: len(chunks)])
    counts = []
    for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), len(places)]):
        steps = np.diff(places[start:stop], prepend=np.uint32(0)).astype(np.uint16)
        counts.append(zlib.compress(steps.view(np.uint8).reshape(-1, 2).T.tobytes() + times[start:stop].tobytes(), 1))
    return pa.RecordBatch.from_arrays([pa.array(chunks[edges].astype(np.int32)), pa.array(counts, pa.binary())], names=["chunk", "counts"])


def _counters(sizes: tuple[int, ...], often: Often | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed counts of a task's phrases of ``sizes`` words, in chunks.

    With ``often``, of those only whose pairs of words all can be frequent.
    """
    waiting, held = [], 0
    for batch in batches:
        for part, _, hashes in _parts(batch):
            pairs = open_ = None
            for k, (counter, whole) in zip(range(1, max(sizes) + 1), part.beginnings(hashes)):
                if often is not None and k == 2:
                    pairs = whole = whole & often[counter]
                elif often is not None and k > 2:
                    whole = open_ & part.leads(pairs, k - 2, False)
                open_ = whole
                if k in sizes:
                    waiting.append(counter[whole].astype(np.uint32))
                    held += len(waiting[-1])
            if held >= KEYS:
                yield _packed(np.concatenate(waiting))
                waiting, held = [], 0
    if held:
        yield _packed(np.concatenate(waiting))


def _often(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk, which come together, summed: a bit per counter that reaches ``least``."""

    def told(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        bits = zlib.compress(np.packbits(total >= min(least, 255)).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bits], pa.binary())], names=["chunk", "bits"])

    now, total = None, None
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            planes = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8).reshape(3, -1)
            if chunk != now:
                if now is not None:
                    yield told(now, total)
                now, total = chunk, np.zeros(CHUNK, np.int64)
            total[np.cumsum(planes[0].astype(np.int64) + (planes[1].astype(np.int64) << 8))] += planes[2]
    if now is not None:
        yield told(now, total)


def _windows(often: Often | np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest window from every word on, as columns of leading words, counted within a part.

    It ends with its piece, before a word with which it can't be frequent, or
    after ``LONGEST`` words; what is left is padded with ''.  A word that can't be
    frequent itself is padding too, so that every word counts once.  To take less
    room on the way, a window's columns are one text, with its kind below.
    """
    for batch in batches:
        for part, names, hashes in _parts(batch):
            if not len(part.hashes):
                continue
            _, first, word = np.unique(part.hashes, return_index=True, return_inverse=True)
            pad, columns, open_, shorter = len(first), [], np.ones(len(word), bool), None
            for k, (counter, whole) in enumerate(part.beginnings(hashes)):
                frequent = whole & often[counter]
                open_ = open_ & frequent
                if k:  # what follows the first word must be frequent by itself
                    open_ = open_ & part.leads(shorter, 1, False)
                shorter = frequent
                columns.append(np.where(open_, part.leads(word, k, pad), pad))
            key = part.kinds.astype(np.uint64)
            for c in columns:
                key = W.mixed(key * _ODD + c.astype(np.uint64))
            _, at, times = np.unique(key, return_index=True, return_counts=True)
            strings = part.strings(first)
            words = pc.utf8_rtrim(pc.binary_join_element_wise(*[strings.take(pa.array(c[at])) for c in columns], " "), " ")
            kinds = pa.array([names[k] for k in part.kinds[at].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(words, kinds, "\n"), pa.array(times.astype(np.int64))], names=["window", "n"])


def _often_told(texts: DataFrame, least: int, sizes: tuple[int, ...], known: list[tuple[int, bytes]] | None = None) -> list[tuple[int, bytes]]:
    """Packed chunks of the counters that phrases of ``sizes`` words reach ``least`` times in all texts."""
    shorter = texts.sparkSession.sparkContext.broadcast(known)
    counted = texts.mapInArrow(lambda b: _counters(sizes, None if shorter.value is None else Often(shorter.value), b), "chunk int, counts binary")
    chunks = counted.repartition("chunk").sortWithinPartitions("chunk")
    told = cut(chunks.mapInArrow(lambda b: _often(least, b), "chunk int, bits binary")).collect()  # 32 megabytes at most
    return [(row["chunk"], row["bits"]) for row in told]


def phrase_counts(files: DataFrame, least: int) -> DataFrame:
    """``(kind, size, phrase, n)``: phrases of 1 to ``LONGEST`` words found ``least`` times.

    A row of size 0 counts all words of a kind.  Only the padded longest windows
    are counted; ROLLUP sums them to the counts of their shorter beginnings, which
    are all shorter phrases, as one begins wherever a word stands.
    """
    spark = files.sparkSession
    ship(spark)
    texts = files.select(F.coalesce(F.col("kind").cast("string"), F.lit(NO_KIND)).alias("kind"), "text")
    short = _often_told(texts, least, (1, 2))
    often = spark.sparkContext.broadcast(short + _often_told(texts, least, tuple(range(3, LONGEST + 1)), short))
    windows = texts.mapInArrow(lambda b: _windows(Often(often.value), b), "window string, n bigint")
    counted = windows.groupBy("window").agg(F.sum("n").alias("n")).withColumns({"words": F.split(F.substring_index("window", "\n", 1), " "), "at": F.instr("window", "\n")})
    columns = [F.coalesce(F.get("words", F.lit(k)), F.lit("")).alias(w) for k, w in enumerate(WORDS)]
    longest = counted.select(F.expr("substr(window, at + 1)").alias("kind"), *columns, "n")
    rolled = longest.rollup("kind", *WORDS).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    size = F.lit(LONGEST) - F.bit_count("level").cast("int")
    last = F.element_at(F.array(F.lit("-"), *WORDS), size + 1)  # a beginning that ends with padding is no phrase
    kept = rolled.withColumn("size", size).filter((F.col("size") >= 0) & (last != "") & ((F.col("n") >= least) | (F.col("size") == 0)))
    return kept.select("kind", "size", F.array_join(F.slice(F.array(*WORDS), 1, F.col("size")), " ").alias("phrase"), "n")


def _inner(words: Column, size: Column) -> Column:
    """Shorter phrases of two words or more within a phrase."""
    places = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.lit(LONGEST)), lambda n: F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda at: F.struct(n.alias("n"), at.alias("at"))))),
        lambda x: (x["n"] < size) & (x["at"] + x["n"] - 1 <= size),
    )
    return F.array_distinct(F.transform(places, lambda x: F.array_join(F.slice(words, x["at"], x["n"]), " ")))


def mine_phrases(files: DataFrame, most: int = 2000, least: int = 30, inside: int = 80) -> DataFrame:
    """Collocations in the texts of landed files, for every kind of file.

    ``files`` is ``(kind, text)``: a text with the kind of its file, such as
    norms, registry or template (see ``operators.kinds``), or whatever else texts
    are told apart by.  A-Z in lower case; texts are split at ``.,;:!?`` and line
    ends, pieces at blanks and tabs.  Phrases of 2 to 4 words found ``least``
    times or more in a kind are candidates, unless a longer candidate around them
    is found ``inside`` per cent as often.  Cut after its first words, a phrase
    found ``a`` times has parts found ``l`` and ``r`` times and the score
    ``2000000 * a / (l + r)``, rounded down; the lowest-scoring cut counts, ties
    the shortest first part.

    Returns ``(kind, rank, phrase, a, l, r, n, score)``, the first ``most`` of
    each kind by score, ``a`` and phrase; ``n`` counts all words of the kind.
    Null and empty texts have no words, a null kind is ``und``; repeated rows
    count each; without candidates there are no rows.  Further columns are left
    left out.  Counts are of all texts; hashed counts, of words and pairs first and
    then of longer phrases made of frequent pairs, only keep windows that can't be
    frequent from being moved.
    """
    found = cut(phrase_counts(files, least))
    totals = found.filter("size = 0").select("kind", F.col("n").alias("all_words"))
    longer = found.filter("size >= 2").withColumn("words", F.split("phrase", " "))
    covering = longer.filter("size >= 3").select("kind", F.explode(_inner(F.col("words"), F.col("size"))).alias("phrase"), "n")
    covered = covering.groupBy("kind", "phrase").agg(F.max("n").alias("around"))
    kept = longer.join(covered, ["kind", "phrase"], "left").filter(F.col("around").isNull() | (100 * F.col("around") < inside * F.col("n")))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "kind", "phrase", F.col("n").alias("a"), "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    part = lambda name, n: found.filter("size > 0").select("kind", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(part("first", "l"), ["kind", "first"]).join(part("rest", "r"), ["kind", "rest"])
    score = F.expr(f"cast({SCORE} as decimal(7, 0)) * cast(a as decimal(19, 0)) div cast(l + r as decimal(20, 0))")
    lowest = both.withColumn("score", score).groupBy("kind", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("low"))
    scored = lowest.select("kind", "phrase", "low.a", "low.l", "low.r", "low.score")
    order = Window.partitionBy("kind").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.join(totals, "kind").select(
        "kind", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("all_words").alias("n"), F.col("score").cast("bigint").alias("score")
    )
