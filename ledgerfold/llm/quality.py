"""Quality of files, learned from rated ones: hashed n-gram vectors and a softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import words as W
from ledgerfold.session import cut, ship

BUCKETS = 1 << 18
CHAR_GRAMS = (3, 4)
SAME_PAIR = 0  # bucket of a word that repeats the one before it
SCORED_CHARS = 1 << 19  # bytes of text that are scored at once


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def _word_values(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its hash, and the buckets of the word and its character n-grams as a range."""
    hashes = W.word_hashes([w.encode("utf-8", "surrogatepass") for w in words])
    framed = [f"<{w}>" for w in words]
    codes, lengths = W.code_points(framed)
    buckets, owners = [_bucket(hashes)], [np.arange(len(words))]
    for n in CHAR_GRAMS:
        at, word = W.inside(lengths, n)
        buckets.append(_bucket(W.gram_hashes(codes, n)[at]))
        owners.append(word)
    return hashes, np.concatenate(buckets), np.concatenate(owners)


def _pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; all pairs of one word with itself share one."""
    first, second = hashes[:-1], hashes[1:]
    pairs = _bucket(W.mixed(first * np.uint64(3) + second))
    return np.where(first == second, SAME_PAIR, pairs)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    names = list(dict.fromkeys(words))
    at = {w: k for k, w in enumerate(names)}
    order = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
    hashes, buckets, owners = _word_values(names)
    times = np.bincount(order, minlength=len(names))
    counts = np.bincount(buckets, weights=times[owners], minlength=BUCKETS)
    np.add.at(counts, _pair_buckets(hashes[order]), 1)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(np.int64)


def train(rated: list[tuple[int, np.ndarray, np.ndarray]], dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on averaged vectors and a softmax of two classes.

    Returns what each bucket adds to the logit of class 1 (its vector times the
    difference of the output rows, as the mean and the output are linear), and
    the bias.  Classes weigh alike, whatever their shares.
    """
    dice = np.random.default_rng(seed)
    vectors = dice.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    sizes = np.bincount([label for label, _, _ in rated], minlength=2)
    weigh = len(rated) / np.maximum(2 * sizes, 1)
    steps, done = epochs * len(rated), 0
    for _ in range(epochs):
        for k in dice.permutation(len(rated)).tolist():
            label, found, counts = rated[k]
            step = np.float32(rate * (1 - done / steps) * weigh[label])
            done += 1
            share = (counts / counts.sum()).astype(np.float32)
            rows = vectors[found]
            mean = share @ rows
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            vectors[found] = rows - step * share[:, None] * (p @ output)[None, :] * np.float32(len(found))
            output -= step * np.outer(p, mean)
            bias -= step * np.float32(0.1) * p
    lean = (output[1] - output[0]).astype(np.float64)
    return (vectors.astype(np.float64) @ lean), float(bias[1] - bias[0])


def _scored(weights: np.ndarray, bias: float, keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their scores, cut to few characters: no more texts than those are held as words at once."""

    def work_out(names: list[str]) -> tuple[np.ndarray, ...]:
        hashes, buckets, owners = _word_values(names)
        sums = np.bincount(owners, weights=weights[buckets], minlength=len(names))
        return hashes, sums, np.bincount(owners, minlength=len(names))

    table = W.WordTable(work_out)

    def logits_of(texts: list[str | None]) -> np.ndarray:
        lists = [(t or "").split() for t in texts]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        rows = table.rows([w for ws in lists for w in ws])
        if not len(rows):
            return np.full(len(texts), bias)
        hashes, sums, counts = (c[rows] for c in table.columns)
        pairs = weights[_pair_buckets(hashes)]
        last = np.cumsum(lengths)[lengths > 0] - 1
        first_of_pair = np.ones(len(rows), bool)
        first_of_pair[last] = False  # no pair reaches over the end of a text
        pair_sum = np.zeros(len(rows))
        pair_sum[:-1] = np.where(first_of_pair[:-1], pairs, 0)
        total = W.row_sums(sums + pair_sum, lengths)
        number = W.row_sums(counts, lengths) + np.maximum(lengths - 1, 0)
        return bias + total / np.maximum(number, 1)

    for batch in batches:
        for part in W.parts_of(batch, batch.num_columns - 1, SCORED_CHARS):
            score = 1 / (1 + np.exp(-np.clip(logits_of(part.column(part.num_columns - 1).to_pylist()), -500, 500)))
            told = pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])
            yield told if keep else told.select([0, 2])


def fit_quality(
    files: DataFrame,
    ratings: DataFrame,
    sample_files: int = 4000,
    dim: int = 12,
    epochs: int = 4,
    rate: float = 0.25,
    seed: int = 7,
) -> tuple[np.ndarray, float]:
    """Learn quality from ``ratings`` ``(file, quality)``, 1 good and 0 poor.

    ``sample_files`` is the expected size of the training sample, halved between
    the two qualities and drawn by the hash of ``file``.  It bounds the memory of
    the driver, which runs the descent: a text teaches all its buckets, 8 bytes
    each and ``BUCKETS`` at most.  Rows with a null file or a quality other than 0 or 1 teach
    nothing; with no rated file at all every file scores one half.
    """
    known = ratings.select("file", F.col("quality").cast("int").alias("quality")).filter(F.col("file").isNotNull() & F.col("quality").isin(0, 1)).distinct()
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return np.zeros(BUCKETS), 0.0
    draw = F.pmod(F.xxhash64(F.lit("quality sample"), "file"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("quality") == q, F.lit(min(1.0, sample_files / 2 / n))) for q, n in sizes.items()])
    sample = cut(known.filter(draw < share))  # bounded, and its size known: the texts need not be moved
    ship(files.sparkSession)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, quality, text in zip(*(c.to_pylist() for c in batch.columns)):
                found, counts = features(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([str(file)]), pa.array([quality], pa.int32()), pa.array([found.astype(np.int32).tobytes()]), pa.array([counts.astype(np.int32).tobytes()])],
                    names=["file", "quality", "found", "counts"],
                )

    rows = (
        files.select("file", "text")
        .join(sample, "file")
        .select("file", "quality", "text")
        .mapInArrow(featured, "file string, quality int, found binary, counts binary")
        .collect()
    )
    rated = [(r["quality"], np.frombuffer(r["found"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in sorted(rows, key=lambda r: (r["file"], r["quality"], bytes(r["found"])))]
    rated = [x for x in rated if len(x[1])]
    return train(rated, dim, epochs, rate, seed) if rated else (np.zeros(BUCKETS), 0.0)


def score_files(files: DataFrame, ratings: DataFrame, text: str = "text", key: str = "file", taught: DataFrame | None = None, keep: bool = False, **fit) -> DataFrame:
    """Score every file's whole text for quality: ``(file, score)``, 1 is best.

    Word, word-pair and character n-gram buckets of a text are averaged as
    vectors; the softmax of a linear output gives the score.  ``ratings`` is
    ``(file, quality)``; see ``fit_quality`` for ``fit``, which also says what
    null ratings do.  One row per row of ``files``, repeated files included; a
    null or empty text scores what the bias alone says; further columns of
    ``files`` are left out and may have any name.  ``key`` may be a struct, to
    take columns along; ``taught`` then has the files to learn from, and with ``keep``
    the text stands between key and score.  The model is a vector of
    ``BUCKETS`` numbers, whatever the size of the data.
    """
    spark = files.sparkSession
    model = spark.sparkContext.broadcast(fit_quality(files if taught is None else taught, ratings, **fit))
    kind = files.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, `{text}` string, score double" if keep else f"`{key}` {kind}, score double"
    return files.select(key, text).mapInArrow(lambda batches: _scored(*model.value, keep, batches), shape)


def keep_good(scored: DataFrame, least: float = 0.3) -> Column:
    """Whether a scored file passes."""
    return F.col("score") >= least
