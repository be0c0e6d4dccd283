"""Quality rules of a file's text, weighed against each other instead of all-must-pass."""

from __future__ import annotations

import math
import warnings
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.records import SPACES
from ledgerfold.session import cut

WINDOW = 8
FEWEST_WORDS = 20
MOST_REPEATED = 30  # per cent of words
KEEP, REJECT, ABSTAIN = 1, -1, 0


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def _two_halves(span: int, at: Column) -> Column:
    return F.xxhash64(F.get("__windows", at), F.get("__windows", at + span))


def with_repeated_words(split: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words in a window of ``WINDOW`` words that the text has twice or more.

    Windows of the column ``words`` are compared by a 64-bit hash.  Texts whose
    windows all differ, and they are most, are told by a count of distinct ones;
    only the others sort theirs.  Each step is a column of its own that the next
    reads more than once, so that it is worked out once per text.
    """
    windowed = split.withColumn("__windows", F.transform("words", lambda w: F.xxhash64(w)))
    for span in (1, 2, 4):  # windows of 2, 4 and 8 words, each of two halves
        last = F.size("__windows") - 1 - span
        halves = F.transform(F.sequence(F.lit(0), last), partial(_two_halves, span))
        windowed = windowed.withColumn("__windows", F.when(last >= 0, halves))
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    sorted_ = windowed.withColumn("__placed", F.when(repeated, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    beside = lambda x, k: F.coalesce(F.get("__placed", k)["h"] == x["h"], F.lit(False))
    again = F.filter("__placed", lambda x, k: beside(x, k + 1) | F.when(k > 0, beside(x, k - 1)).otherwise(False))
    started = sorted_.withColumn("__starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    step = F.transform("__starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", k + 1) - s, F.lit(WINDOW))))
    covered = F.aggregate(step, F.lit(0), lambda a, g: a + g)
    return started.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("__windows", "__placed", "__starts")


def measures(files: DataFrame, key: str = "file") -> DataFrame:
    """What the rules look at, per file, whole texts; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = files.select(F.col(key).alias("__key"), text.alias("text")).withColumns(
        {
            "words": words_of(F.col("text")),
            "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACES}]")),
        }
    )
    number_of = lambda chars: F.length(F.regexp_replace("text", f"[^{chars}]+", "")).cast("bigint")
    counted = split.select(
        "__key",
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{SPACES}]+", "")).cast("bigint").alias("word_chars"),
        number_of("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        number_of("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÁÍÓÚÑ").alias("n_capitals"),
        number_of("!?").alias("n_shouts"),
        number_of("|\u2022\u00b7").alias("n_bars"),
        F.size(F.filter("lines", lambda x: F.substring(F.rtrim(x), -1, 1).isin(".", ":", ";", "?", "\u2026"))).cast("bigint").alias("n_ended"),
    )
    return with_repeated_words(counted).drop("words").withColumnRenamed("__key", key)


def _vote(good: Column, poor: Column) -> Column:
    return F.when(poor, REJECT).when(good, KEEP).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """The rules: each votes to keep, to reject, or abstains where it can't tell.

    Shares are compared by multiplication, so an empty text divides by nothing.
    """
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    odd = F.col("n_symbols") + F.col("n_shouts")
    long = words >= FEWEST_WORDS
    return {
        "symbols": _vote(50 * F.col("n_symbols") <= words, 10 * F.col("n_symbols") > 2 * words),
        "odd_marks": _vote(20 * odd <= words, 4 * odd > words),
        "capitals": _vote(100 * F.col("n_capitals") <= 12 * chars, 100 * F.col("n_capitals") > 40 * chars),
        "ended_lines": _vote(10 * F.col("n_ended") >= 6 * lines, 10 * F.col("n_ended") < 3 * lines),
        "bars": _vote(F.lit(False), 5 * F.col("n_bars") > words),
        "word_length": _vote(F.lit(False), (chars < 2 * words) | (chars > 20 * words)),
        "variety": _vote(F.lit(False), long & (20 * F.col("n_distinct") < words)),
        "same_lines": _vote(F.lit(False), (lines >= 4) & (10 * F.col("n_dup_lines") > 5 * lines)),
    }


def _likelihood(rules: list[str], accuracy: dict[str, tuple[float, float]], good: bool) -> Column:
    """Log likelihood of the votes of a file that is good (or poor)."""
    total = F.lit(0.0)
    for rule in rules:
        right = accuracy[rule][0 if good else 1]
        keep, reject = (right, 1 - right) if good else (1 - right, right)
        total = total + F.when(F.col(rule) == KEEP, math.log(keep)).when(F.col(rule) == REJECT, math.log(reject)).otherwise(0.0)
    return total


def _posterior(rules: list[str], accuracy: dict[str, tuple[float, float]], share: float) -> Column:
    odds = _likelihood(rules, accuracy, True) - _likelihood(rules, accuracy, False) + math.log(share / (1 - share))
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rules: list[str], rounds: int = 20, least: float = 0.55, most: float = 0.999) -> tuple[dict[str, tuple[float, float]], float]:
    """Expectation-maximisation of rule accuracies and the share of good files.

    ``patterns`` is ``(<rules>, n)``: how many files gave each pattern of votes,
    at most 3 to the number of rules rows.  Given its quality a file's votes are
    taken as independent and abstaining as uninformative.  A rule's accuracy on
    good and on poor files stays within ``least`` and ``most``, so a rule is
    never turned round.  One aggregate row a round reaches the driver; a warning
    says when ``rounds`` end before accuracies and share change by less than 1e-4.
    """
    accuracy, share = {rule: (0.8, 0.8) for rule in rules}, 0.8
    for _ in range(rounds):
        good = _posterior(rules, accuracy, share) * F.col("n")
        poor = F.col("n") - good
        exact = lambda x: F.sum(F.round(x, 6).cast("decimal(38,6)")).cast("double")  # noqa: E731  the same in any order
        sums = [exact(good).alias("good"), F.sum("n").alias("n")]
        for rule in rules:
            spoke = F.col(rule) != ABSTAIN
            sums += [
                exact(F.when(spoke, good)).alias(f"{rule}_good"), exact(F.when(F.col(rule) == KEEP, good)).alias(f"{rule}_kept"),
                exact(F.when(spoke, poor)).alias(f"{rule}_poor"), exact(F.when(F.col(rule) == REJECT, poor)).alias(f"{rule}_rejected"),
            ]
        r = patterns.agg(*sums).first()
        if not r["n"]:
            break
        bound = lambda x: min(most, max(least, x))
        ratio = lambda a, b: bound(((r[a] or 0.0) + 4.0) / ((r[b] or 0.0) + 5.0))  # noqa: E731  starts at 0.8
        before = (accuracy, share)
        accuracy = {rule: (ratio(f"{rule}_kept", f"{rule}_good"), ratio(f"{rule}_rejected", f"{rule}_poor")) for rule in rules}
        share = min(0.99, max(0.05, r["good"] / r["n"]))
        change = max(abs(share - before[1]), *(abs(a - b) for rule in rules for a, b in zip(accuracy[rule], before[0][rule])))
        if change < 1e-4:
            break
    else:
        warnings.warn(f"rule accuracies have not settled in {rounds} rounds", stacklevel=2)
    return accuracy, share


def judge_files(files: DataFrame, key: str = "file", least: float = 0.5) -> DataFrame:
    """Counts, votes and verdict per file of ``files`` ``(file, text)``.

    A file fails outright (``base_failed``) with fewer than 20 words or with more
    than 30 per cent of its words in repeated windows.  Else ``kept`` says that
    the posterior probability of good quality, ``p_good``, is at least ``least``;
    the accuracies behind it are estimated from how all files' votes agree, with
    no rating known.  One row per row of ``files``, repeated files included; a
    null text counts as empty, and fails; an empty table gives an empty one;
    further columns are left out and may have any name.  Measures are written
    once and read for the estimate and the verdict.
    """
    rules = list(votes())
    measured = cut(measures(files, key).withColumns(votes()))
    accuracy, share = estimate(cut(measured.groupBy(*rules).agg(F.count("*").alias("n"))), rules)
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = measured.withColumn("p_good", _posterior(rules, accuracy, share)).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
