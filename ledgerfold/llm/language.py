"""Language of files: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import words as W
from ledgerfold.session import cut, ship

UNKNOWN = "und"
LONGEST_GRAM = 5
LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall((text or "").lower())


class Model:
    """Log frequencies per language of words and of n-grams of each length.

    ``words`` and ``grams`` map to a row of counts per language; grams carry
    their length with them, as a blank marks the ends of a word.
    """

    def __init__(self, languages: list[str], shares: np.ndarray, words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.languages, self.prior = languages, np.log(shares / shares.sum())
        self.words = self._logs(words)
        by_length: dict[int, dict[str, np.ndarray]] = {}
        for gram, counts in grams.items():
            by_length.setdefault(len(gram), {})[gram] = counts
        self.grams = {n: self._logs(found) for n, found in by_length.items()}

    @staticmethod
    def _logs(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if not counts:
            return {}
        smoothed = np.array(list(counts.values()), float) + 0.5
        return dict(zip(counts, np.log(smoothed / smoothed.sum(axis=0))))

    def of_word(self, word: str) -> np.ndarray:
        """Log evidence of a word: its own, or the mean of its longest known n-grams."""
        own = self.words.get(word)
        if own is not None:
            return own
        framed = f" {word} "
        for n in range(min(LONGEST_GRAM, len(framed)), 0, -1):
            table = self.grams.get(n)
            if table:
                found = [v for k in range(len(framed) - n + 1) if (v := table.get(framed[k : k + n])) is not None]
                if found:
                    return sum(found) / len(found)
        return np.zeros(len(self.languages))


def _judge(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = W.WordTable(lambda names: (np.array([model.of_word(w) for w in names]),))
    names = np.array([*model.languages, UNKNOWN], object)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        best, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
        for start, end in W.slices(texts):
            lists = [letter_words(t) for t in texts[start:end]]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            rows = table.rows([w for ws in lists for w in ws])
            if not len(rows) or not model.languages:
                continue
            logs = W.row_sums(table.columns[0][rows], lengths) + model.prior
            logs -= logs.max(axis=1, keepdims=True)
            share = np.exp(logs)
            share /= share.sum(axis=1, keepdims=True)
            top = share.argmax(axis=1)
            best[start:end] = np.where(lengths > 0, top, len(model.languages))
            score[start:end] = np.where(lengths > 0, share[np.arange(len(top)), top], 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.update((lang, w) for w in letter_words(text))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "piece", "n"])


def _top(pieces: DataFrame, languages: list[str], most: int) -> dict[str, np.ndarray]:
    """The ``most`` most frequent pieces, with their counts per language."""
    per_language = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{k}") for k, lang in enumerate(languages)]
    ranked = pieces.groupBy("piece").agg(F.sum("n").alias("n"), *per_language).orderBy(F.desc("n"), "piece").limit(most)
    return {r["piece"]: np.array(r[2:], float) for r in ranked.collect()}


def fit_languages(samples: DataFrame, sample_files: int = 3000, known_words: int = 60_000, known_grams: int = 120_000) -> Model:
    """Learn from ``samples`` ``(file, text, lang)``.

    ``sample_files`` bounds the expected number of files drawn per language, by
    the hash of ``file``; ``known_words`` and ``known_grams`` bound the model,
    which goes to the driver and to every worker.  Rows with a null text, file
    or language teach nothing.  Languages are known by code point.
    """
    ship(samples.sparkSession)
    taught = samples.select("file", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("file").isNotNull())
    sizes = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(1), {}, {})
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "file"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, sample_files / n))) for lang, n in sizes.items()])
    counted = taught.filter(draw < share).select("lang", "text").mapInArrow(_counted, "lang string, piece string, n bigint")
    word_counts = cut(counted.groupBy("lang", "piece").agg(F.sum("n").alias("n")))
    framed = F.concat(F.lit(" "), "piece", F.lit(" "))
    grams = [
        F.transform(F.sequence(F.lit(1), F.length("framed") - (n - 1)), lambda at, n=n: F.substring(F.col("framed"), at, F.lit(n)))
        for n in range(1, LONGEST_GRAM + 1)
    ]
    cut_up = word_counts.withColumn("framed", framed)
    pieces = None
    for n, found in enumerate(grams, 1):
        part = cut_up.filter(F.length("framed") >= n).select("lang", F.explode(found).alias("piece"), "n").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        pieces = part if pieces is None else pieces.unionByName(part)
    return Model(languages, np.array([sizes[x] for x in languages], float), _top(word_counts, languages, known_words), _top(pieces, languages, known_grams))


def detect_languages(files: DataFrame, samples: DataFrame, key: str = "file", text: str = "text", **fit) -> DataFrame:
    """Language of every file's whole text: ``(file, lang_pred, score)``.

    A word known from ``samples`` ``(file, text, lang)`` speaks by its log
    frequency per language; an unseen one by the mean of its longest known
    character n-grams, from five down to one.  The sum over all words, with the
    share of each language, decides; ``score`` is the winner's posterior, ties
    go to the first language by code point.  A text that is null or without a
    letter is ``und`` with score 0, as is every text when nothing was learned.
    One row per row of ``files``, repeated files included; further columns are
    left out and may have any name.  ``fit`` is passed to ``fit_languages``.
    """
    model = files.sparkSession.sparkContext.broadcast(fit_languages(samples, **fit))
    kind = files.schema[key].dataType.simpleString()
    return files.select(key, text).mapInArrow(lambda batches: _judge(model.value, batches), f"`{key}` {kind}, lang_pred string, score double")
