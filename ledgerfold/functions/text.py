"""Text normalisation, number parsing and name similarity as Column expressions.

Everything here is built from JVM functions, so it stays inside Catalyst and
can also be registered for SQL (see ``functions.registered``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: words ignored when names are compared -------------------
STOP_WORDS = (
    "и", "или", "в", "во", "на", "по", "с", "со", "для", "из", "от", "до", "при",
    "а", "также", "том", "числе", "за", "исключением", "др", "пр", "прочие",
    "прочих", "прочее", "т", "ч", "иное", "иные", "то", "ли", "не",
)

# --- fixed values: word endings, longest first ------------------------------
ENDINGS = (
    "ическими", "ическому", "ическая", "ические", "ическую",
    "ованные", "ующими", "ующего", "ающими", "ающего",
    "иями", "ями", "ами", "ией", "ыми", "ими", "его", "ого", "ему", "ому",
    "ей", "ой", "ый", "ий", "ая", "яя", "ое", "ее", "ые", "ие", "ов", "ев", "ах",
    "ях", "ам", "ям", "ом", "ем", "ух", "юю", "ую",
    "а", "я", "ы", "и", "у", "ю", "е", "о", "ь", "й",
)

# --- fixed values: shortest stem, and the weights of the two similarity parts
SHORTEST_STEM = 4
TOKEN_WEIGHT = 0.85
STRING_WEIGHT = 0.15
SHARED_PREFIX = 3

# White space as ECMAScript defines it (Java's \s is narrower, (?U)\s wider).
WS = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)

NOT_BLANK = WS.replace("[", "[^", 1)

PLAIN_NUMBER = r"^[+-]?\d{1,300}(?:[.,]\d+)?$"
NUMBER_SHAPE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    """Trim every kind of white space from both ends; null becomes ''."""
    return F.regexp_replace(_text(value), f"^{WS}+|{WS}+$", "")


def cell_text(value: Column) -> Column:
    """Trimmed text with inner white space collapsed to single spaces."""
    return F.trim(F.regexp_replace(_text(value), f"{WS}+", " "))


def normalize(value: Column) -> Column:
    """Comparable key: lower case, ё as е, only digits and letters, single spaces."""
    folded = F.replace(F.lower(_text(value)), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(folded, "[^0-9a-zа-я]+", " "))


def stem(word: Column) -> Column:
    """Cut the longest known ending that leaves at least four characters."""
    pattern = "^(.{%d,}?)(?:%s)$" % (SHORTEST_STEM, "|".join(ENDINGS))
    return F.regexp_replace(word, pattern, "$1")


def tokens_of_key(key: Column) -> Column:
    """Stemmed significant words of an already normalised key."""
    words = F.filter(
        F.split(key, " "),
        lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS),
    )
    return F.transform(words, stem)


def tokens(value: Column) -> Column:
    return tokens_of_key(normalize(value))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the shared prefix; zero when the first characters differ."""
    shared = F.size(
        F.filter(
            F.sequence(F.lit(1), F.least(F.length(a), F.length(b))),
            lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n),
        )
    )
    return F.when(F.substr(a, F.lit(1), F.lit(1)) == F.substr(b, F.lit(1), F.lit(1)), shared).otherwise(0)


def token_similarity(a: Column, b: Column) -> Column:
    """Best of shared-prefix share (from three characters on) and edit ratio."""
    head = SHARED_PREFIX
    alike = (
        (F.length(a) >= head)
        & (F.length(b) >= head)
        & (F.substr(a, F.lit(1), F.lit(head)) == F.substr(b, F.lit(1), F.lit(head)))
    )
    prefix = F.when(alike, common_prefix(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(prefix, levenshtein_ratio(a, b)))


def _mean_best(source: Column, target: Column) -> Column:
    best = F.transform(
        source, lambda t: F.array_max(F.transform(target, lambda o: token_similarity(t, o)))
    )
    return F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x) / F.size(source)


def soft_token_similarity(a: Column, b: Column) -> Column:
    """Soft Dice coefficient: mean best partner, averaged over both directions."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise((_mean_best(a, b) + _mean_best(b, a)) / 2)


def similarity_from_soft(key_a: Column, key_b: Column, soft: Column) -> Column:
    """Similarity of two names whose keys and soft token similarity are known."""
    mixed = let(
        levenshtein_ratio(key_a, key_b),
        lambda lev: F.greatest(soft * TOKEN_WEIGHT + lev * STRING_WEIGHT, lev),
    )
    return (
        F.when((key_a == "") | (key_b == ""), F.lit(0.0))
        .when(key_a == key_b, F.lit(1.0))
        .otherwise(mixed)
    )


def similarity_of_keys(key_a: Column, tokens_a: Column, key_b: Column, tokens_b: Column) -> Column:
    """Similarity of two names whose keys and tokens were computed beforehand."""
    return similarity_from_soft(key_a, key_b, soft_token_similarity(tokens_a, tokens_b))


def similarity(a: Column, b: Column) -> Column:
    return similarity_of_keys(normalize(a), tokens(a), normalize(b), tokens(b))


def parse_number(value: Column) -> Column:
    """Number in a cell: decimal comma, digit groups and footnote marks allowed."""
    text = _text(value)
    bare = F.regexp_replace(text, rf"<[^>]*>|\*|{WS}", "")
    dotted = F.regexp_replace(bare, "^([^,]*),", "$1.")
    number = F.when(dotted.rlike(NUMBER_SHAPE), dotted.try_cast("double"))
    # Most cells are plain numbers and need only one look.
    return F.when(text.rlike(PLAIN_NUMBER), F.replace(text, F.lit(","), F.lit(".")).try_cast("double")).otherwise(
        F.when(F.abs(number) < F.lit(float("inf")), number)
    )


def round_half_up(value: Column, digits: int) -> Column:
    """Half away from zero on the decimal representation; non-finite gives null."""
    finite = F.abs(value) < F.lit(float("inf"))
    return F.when(finite, F.round(value.cast("double"), digits))


def glued(before: Column, part: Column) -> Column:
    """Whether a line goes on with a word that a hyphen broke in the line before."""
    return before.rlike(r"\S[-‑–]$") & part.rlike("^[a-zа-яё]")


def join_lines(parts: Column) -> Column:
    """Glue the lines of one cell; a hyphenated break is joined without a space.

    Whether two lines are glued depends on these two alone, so the separators
    are chosen side by side and no text is grown step by step.
    """

    def piece(part: Column, i: Column) -> Column:
        before = F.coalesce(F.get(parts, i - 1), F.lit(""))
        return F.when(glued(before, part), part).otherwise(F.concat(F.lit(" "), part))

    return cell_text(F.array_join(F.transform(parts, piece), ""))


def join_words(parts: Column) -> Column:
    """Join recognised words and put punctuation back against its word."""
    text = F.array_join(parts, " ")
    text = F.regexp_replace(text, rf"{WS}+([,.;:!?)»%])", "$1")
    text = F.regexp_replace(text, rf"([(«]){WS}+", "$1")
    return cell_text(text)
