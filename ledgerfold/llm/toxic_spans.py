"""Toxic passages of files: a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm import words as W
from ledgerfold.session import cut, ship

BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
STEMS = range(3, 8)  # beginnings of words that may be told as toxic
SURE = 5.0  # how much a word's evidence must pass the logarithm of the words looked at
LEAST_TEXTS = 16_000  # that training passes, over and over if there are few
STEEPEST = 30.0  # of a word's weight, so that products stay finite
_WORD = re.compile(r"[^\W\d_]+|\n")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))


# --- the chain ------------------------------------------------------------------


def _blocks(values: np.ndarray, n_blocks: int, fill: float) -> np.ndarray:
    steps = -(-len(values) // n_blocks)
    padded = np.full(steps * n_blocks, fill)
    padded[: len(values)] = values
    return np.ascontiguousarray(padded.reshape(n_blocks, steps).T)


def marginals(odds: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over one chain of words, each toxic or not.

    ``odds`` has the weight of 'toxic' against 'not' of every word, 0 where a word
    can't be toxic, which parts the chain, and the last word must be such a one;
    ``moves[i, j]`` is the weight of j after i.  Returns every word's probability of being toxic and, if asked, the expected
    number of every move.  The chain is cut into blocks that go side by side: the
    products of their matrices first, then the messages at their ends, then the
    messages inside.
    """
    n = len(odds)
    n_blocks = max(1, int(np.sqrt(n)))
    w = _blocks(odds, n_blocks, 0.0)
    steps = len(w)
    (t00, t01), (t10, t11) = moves.tolist()
    p00, p01, p10, p11 = np.ones(n_blocks), np.zeros(n_blocks), np.zeros(n_blocks), np.ones(n_blocks)
    for k in range(steps):
        p00, p01 = p00 * t00 + p01 * t10, (p00 * t01 + p01 * t11) * w[k]
        p10, p11 = p10 * t00 + p11 * t10, (p10 * t01 + p11 * t11) * w[k]
        if k % 4 == 3 or k == steps - 1:
            total = p00 + p01 + p10 + p11
            p00, p01, p10, p11 = p00 / total, p01 / total, p10 / total, p11 / total
    products = np.stack([p00, p01, p10, p11], axis=1).tolist()
    before, after = np.empty((n_blocks, 2)), np.empty((n_blocks, 2))
    a0, a1 = 1.0, 0.0
    for k, (x00, x01, x10, x11) in enumerate(products):
        before[k] = a0, a1
        a0, a1 = a0 * x00 + a1 * x10, a0 * x01 + a1 * x11
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    b0, b1 = 0.5, 0.5
    for k in range(n_blocks - 1, -1, -1):
        after[k] = b0, b1
        x00, x01, x10, x11 = products[k]
        b0, b1 = x00 * b0 + x01 * b1, x10 * b0 + x11 * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    ahead = np.empty((steps + 1, n_blocks))  # share of 'toxic' in the forward message
    f0, f1 = before[:, 0], before[:, 1]
    ahead[0] = f1
    for k in range(steps):
        f0, f1 = f0 * t00 + f1 * t10, (f0 * t01 + f1 * t11) * w[k]
        f1 = f1 / (f0 + f1)
        f0 = 1 - f1
        ahead[k + 1] = f1
    found = np.empty((steps, n_blocks))
    real = _blocks(np.ones(n), n_blocks, 0.0) if pairs else None
    moved = np.zeros((2, 2))
    b0, b1 = after[:, 0], after[:, 1]
    for k in range(steps - 1, -1, -1):
        f1 = ahead[k + 1]
        toxic = f1 * b1
        found[k] = toxic / (toxic + (1 - f1) * b0)
        next0, next1 = t00 * b0 + t01 * w[k] * b1, t10 * b0 + t11 * w[k] * b1
        if pairs:
            f1 = ahead[k]
            each = np.stack([(1 - f1) * t00 * b0, (1 - f1) * t01 * w[k] * b1, f1 * t10 * b0, f1 * t11 * w[k] * b1])
            moved += (each / each.sum(axis=0) * real[k]).sum(axis=1).reshape(2, 2)
        total = next0 + next1
        b0, b1 = next0 / total, next1 / total
    return found.T.ravel()[:n], moved if pairs else None


# --- words ----------------------------------------------------------------------


def tokens(text: str | None) -> list[str]:
    """Words (runs of letters) and line ends, in order."""
    return _WORD.findall(text or "")


def word_buckets(words: list[str]) -> np.ndarray:
    """Buckets of a word: itself, its beginnings and its end; 0 where it is too short for one."""
    lowered = [w.lower() for w in words]
    columns = [[b"=" + w.encode("utf-8", "surrogatepass") for w in lowered]]
    columns += [[f"{n}^{w[:n]}".encode("utf-8", "surrogatepass") if len(w) >= n else b"" for w in lowered] for n in PREFIXES]
    columns += [[b"$" + w[-3:].encode("utf-8", "surrogatepass") if len(w) > 3 else b"" for w in lowered]]
    out = np.stack([(W.word_hashes(c) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1 for c in columns], axis=1)
    for k, c in enumerate(columns):
        out[[not x for x in c], k] = 0
    return out


def key_numbers(words: list[str]) -> np.ndarray:
    """Numbers of a word itself and of its beginnings, -1 where it is too short for one."""
    columns = [[b"=" + w.encode("utf-8", "surrogatepass") for w in words]]
    columns += [[w[:n].encode("utf-8", "surrogatepass") if len(w) >= n else b"" for w in words] for n in STEMS]
    hashes = np.stack([W.word_hashes(c) for c in columns], axis=1)
    _, numbers = np.unique(hashes, return_inverse=True)
    numbers = numbers.reshape(hashes.shape)
    for k, c in enumerate(columns):
        numbers[[not x for x in c], k] = -1
    return numbers


def distinct_texts(texts: list[np.ndarray], alike: float = 0.5) -> list[int]:
    """Texts, as hashes of their words, that no earlier one is a near copy of: half of 32 minima or more are equal."""
    dice = np.random.default_rng(3)
    factors = dice.integers(1, 1 << 62, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    kept, signed = [], np.empty((len(texts), 32), np.uint64)
    for k, hashes in enumerate(texts):
        if not len(hashes):
            continue
        least = np.array([(hashes * f).min() for f in factors])
        if not kept or (signed[: len(kept)] == least).mean(axis=1).max() < alike:
            signed[len(kept)] = least
            kept.append(k)
    return kept


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How unlikely (minus logarithm) it is by chance that so many texts with a key are toxic.

    0 for keys that aren't ten times as frequent in toxic texts as in clean ones.
    """
    share, seen = n_toxic / (n_toxic + n_clean), np.maximum(toxic + clean, 1)
    part = np.clip(toxic / seen, 1e-12, 1 - 1e-12)
    odd = part * np.log(part / share) + (1 - part) * np.log((1 - part) / (1 - share))
    likelier = toxic / n_toxic >= 10 * (clean + 0.5) / n_clean
    return np.where(likelier, seen * odd, 0.0)


def toxic_keys(toxic: list[np.ndarray], clean: list[np.ndarray], n_keys: int) -> np.ndarray:
    """Which keys (words and beginnings of words) make texts toxic, told from the keys of whole texts.

    First those that are in far more toxic texts than chance explains; then, as a
    toxic text holds a toxic word, those that best explain the toxic texts which
    none of the first is in.
    """
    told = np.zeros(n_keys, bool)
    if not toxic or not clean:
        return told
    counted = lambda texts: np.bincount(np.concatenate(texts), minlength=n_keys).astype(float)
    in_clean, rest, everything = counted(clean), toxic, True
    while rest:
        in_toxic = counted(rest)
        sure = _evidence(in_toxic, in_clean, len(rest), len(clean)) - np.log(np.count_nonzero(in_toxic)) - SURE
        sure[in_toxic < 2] = 0
        if not (sure > 0).any():
            break
        told |= (sure > 0) if everything else np.arange(n_keys) == sure.argmax()
        everything = False
        rest = [keys for keys in rest if not told[keys].any()]
    return told


class Model:
    """Weights of word buckets, and of one state after the other."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def odds_of(self, words: list[str]) -> np.ndarray:
        """Odds of each word; a line end can't be toxic."""
        found = word_buckets(words)
        weights = np.where(found > 0, self.weights[found], 0.0).sum(axis=1) + self.weights[0]
        return np.where([w == "\n" for w in words], 0.0, np.exp(np.clip(weights, -STEEPEST, STEEPEST)))


NO_MODEL = Model(np.concatenate([[-STEEPEST], np.zeros(BUCKETS - 1)]), np.ones((2, 2)))


def train(rated: list[tuple[int, str]], epochs: int, rate: float, ridge: float, seed: int) -> Model:
    """A model from whole texts, 1 toxic and 0 clean.

    Words of toxic texts that ``toxic_keys`` tells, and that no clean text holds,
    are the labelled tokens; toxic texts without any are left out, as where they
    are toxic isn't known, and so are near copies.  The likelihood of the labels
    goes up by AdaGrad over batches of texts; in every batch half the words go by
    their beginnings and ends alone, so that these learn to stand for new forms.
    """
    number: dict[str, int] = {"\n": 0}
    texts = [(label, np.array([number.setdefault(w.lower(), len(number)) for w in tokens(text)], np.int32)) for label, text in rated]
    line_end, names = 0, list(number)
    hashes = W.word_hashes([w.encode("utf-8", "surrogatepass") for w in names])
    found = [np.setdiff1d(at, line_end) for _, at in texts]
    sides = [[k for k, (label, _) in enumerate(texts) if label == side] for side in (0, 1)]
    sides = [[side[k] for k in distinct_texts([hashes[found[k]] for k in side])] for side in sides]
    keys = key_numbers(names)
    of_texts = lambda side: [np.setdiff1d(keys[found[k]], -1) for k in side]
    told = np.append(toxic_keys(of_texts(sides[1]), of_texts(sides[0]), int(keys.max()) + 1), False)
    labelled = told[keys].any(axis=1)
    labelled[line_end] = False
    for k in sides[0]:
        labelled[found[k]] = False
    buckets = word_buckets(names)
    buckets[line_end] = 0
    taught = [(texts[k][1], np.zeros(len(texts[k][1]), bool)) for k in sides[0]] + [(texts[k][1], y) for k in sides[1] if (y := labelled[texts[k][1]]).any()]
    texts = [(np.append(at, line_end), np.append(y, False)) for at, y in taught]
    if not any(y.any() for _, y in texts):
        return NO_MODEL
    dice = np.random.default_rng(seed)
    weights, moves = np.zeros(BUCKETS), np.zeros((2, 2))
    weights[0] = np.log((1 + sum(y.sum() for _, y in texts)) / (1 + sum(len(y) for _, y in texts)))
    seen_w, seen_m = np.full(BUCKETS, 1e-2), np.full((2, 2), 1e-2)
    for _ in range(max(epochs, -(-LEAST_TEXTS // len(texts)))):
        order = dice.permutation(len(texts))
        for start in range(0, len(order), 32):
            batch = [texts[k] for k in order[start : start + 32].tolist()]
            at, y = np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch])
            types, place = np.unique(at, return_inverse=True)
            used = buckets[types].copy()
            used[dice.random(len(types)) < 0.5, 0] = 0
            own = np.where(used > 0, weights[used], 0.0).sum(axis=1) + weights[0]
            odds = np.exp(np.clip(own, -STEEPEST, STEEPEST))
            odds[types == line_end] = 0.0
            p, expected = marginals(odds[place], np.exp(moves), pairs=True)
            states = np.concatenate([[False], y])
            observed = np.zeros((2, 2))
            np.add.at(observed, (states[:-1].astype(int), states[1:].astype(int)), 1)
            by_type = np.bincount(place, weights=p - y, minlength=len(types))
            by_type[types == line_end] = 0.0
            flat = used.ravel()
            slope = np.bincount(flat, weights=np.repeat(by_type, used.shape[1]), minlength=BUCKETS)
            slope[0] = by_type.sum()
            touched = np.unique(np.append(flat, 0))
            slope = slope[touched] / len(batch) + ridge * np.where(touched > 0, weights[touched], 0.0)
            seen_w[touched] += slope**2
            weights[touched] -= rate * slope / np.sqrt(seen_w[touched])
            turn = (expected - observed) / len(batch) + ridge * moves
            seen_m += turn**2
            moves -= rate * turn / np.sqrt(seen_m)
    return Model(weights, np.exp(moves))


def fit_toxicity(
    files: DataFrame,
    ratings: DataFrame,
    sample_files: int = 3000,
    sample_chars: int = 12_000_000,
    epochs: int = 6,
    rate: float = 0.5,
    ridge: float = 1e-5,
    seed: int = 7,
) -> Model:
    """Learn where files are toxic from ``ratings`` ``(file, toxic)``, 1 toxic and 0 not.

    ``sample_files`` and ``sample_chars`` are the expected number and size of the
    rated files that teach, halved between the two ratings and drawn by the hash of
    ``file``; they bound what the driver holds.  Rows with a null file or another
    rating teach nothing.  Without toxic and clean files to compare, nothing is
    toxic.
    """
    known = ratings.select("file", F.col("toxic").cast("int").alias("toxic")).filter(F.col("file").isNotNull() & F.col("toxic").isin(0, 1)).distinct()
    rated = files.filter("text <> ''").select("file", F.length("text").alias("chars")).join(known, "file")  # texts stay where they are
    sizes = {r["toxic"]: r for r in rated.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()}
    if len(sizes) < 2:
        return NO_MODEL
    draw = F.pmod(F.xxhash64(F.lit("toxicity sample"), "file"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("toxic") == q, F.lit(min(1.0, sample_files / 2 / r["n"], sample_chars / 2 / r["chars"]))) for q, r in sizes.items()])
    sample = cut(known.filter(draw < share))  # its size is known, so the texts need not be moved
    rows = files.select("file", "text").filter("text <> ''").join(sample, "file").select("file", "toxic", "text").collect()
    rows = sorted({(r["toxic"], r["text"]) for r in rows})
    return train(rows, epochs, rate, ridge, seed)


def _tagged(model: Model, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = W.WordTable(lambda words: (model.odds_of(words),))
    for batch in batches:
        texts = batch.column("text").to_pylist()
        scores, spans = np.zeros(len(texts)), []
        for start, end in W.slices(texts):
            lists = [[*tokens(t), "\n"] for t in texts[start:end]]  # the line end parts one text from the next
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            rows = table.rows([w for words in lists for w in words])
            p, _ = marginals(table.columns[0][rows], model.moves)
            ends = np.cumsum(lengths)
            scores[start:end] = np.maximum.reduceat(p, ends - lengths)
            for k in range(end - start):
                found = []
                if scores[start + k] >= least:
                    own, open_ = p[ends[k] - lengths[k] : ends[k]], False
                    for match, q in zip(_WORD.finditer(texts[start + k]), own.tolist()):
                        if q < least:
                            open_ = False
                        elif open_:
                            found[-1] = {**found[-1], "stop": match.end(), "p": max(q, found[-1]["p"])}
                        else:
                            found.append({"start": match.start(), "stop": match.end(), "p": q})
                            open_ = True
                spans.append(found)
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(scores), pa.array(spans, _SPANS)], names=["file", "score", "spans"])


def tag_files(files: DataFrame, ratings: DataFrame, least: float = 0.5, **fit) -> DataFrame:
    """Toxic passages of landed files, and how likely each file holds one.

    ``files`` is ``(file, text)``, ``ratings`` ``(file, toxic)``, see
    ``fit_toxicity`` for it and for ``fit``.  The registry's records carry no
    rating of this kind, so the operator is general: the texts may be of landed
    files (``records.file_texts``) or of anything else.  Returns ``(file, score,
    spans)``: a linear-chain conditional random field over the words of a text,
    lines apart, gives every word's probability of being toxic by
    forward-backward; ``score`` is the largest of them, ``spans`` are the runs of
    words of ``least`` or more as ``(start, stop, p)``, code points from 0 and the
    run's largest probability.

    One row per row of ``files``, repeated rows alike.  A null or empty text and
    one without letters score 0 and have no spans; further columns are left out.
    """
    spark = files.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit_toxicity(files, ratings, **fit))
    kind = files.schema["file"].dataType.simpleString()
    return files.select("file", "text").mapInArrow(lambda b: _tagged(model.value, least, b), f"file {kind}, score double, spans array<struct<start:int,stop:int,p:double>>")
