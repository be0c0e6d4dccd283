"""Fill-in-middle order, collocations and toxic passages of landed texts, against brute force."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest

from ledgerfold.llm import infill, phrases, toxic_spans

NORMS = "Норматив накопления отходов,  на одного\tпроживающего\nв год: 1,5 м3 "


# --- fill-in-middle ---------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _infilled(file, text):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"42:{'' if file is None else file}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_brute_force_and_comes_back(landed):
    texts = [None, "", " ", "\n\t ", "слово", NORMS, "a<P>b", "x <S> y", "<M>", "< S> <<P", "a <", "> b", "é ü\x0bñ", "w " * 50_000, "<P", "<S", "<M", " a b", "😀 😀  😀"]
    files = landed([(k * 31 + j, t) for j, t in enumerate(texts) for k in range(12)] + [(5, NORMS), (5, NORMS), (None, NORMS)])
    rows = infill.restore_files(infill.infill_files(files)).collect()
    given = {(k * 31 + j): t for j, t in enumerate(texts) for k in range(12)} | {5: None, None: NORMS}
    assert len(rows) == 12 * len(texts) + 3
    forms = Counter()
    for r in rows:
        options = {given[r["file"]] or "", NORMS if r["file"] == 5 else given[r["file"]] or ""}
        assert r["text"] in options
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == _infilled(r["file"], r["text"])
        forms[r["form"]] += 1
    assert min(forms[f] for f in ("plain", "spm", "psm")) > 5


def test_infill_of_nothing(landed):
    assert infill.restore_files(infill.infill_files(landed([]))).count() == 0


@pytest.mark.parametrize("blocks", [(0, 0, 0), (0, 5, 0), (1, 0, 3), (2, 7, 1), (3, 3, 3)])
def test_rotations_exchange_blocks(blocks):
    a, b, c = (bytes(range(k * 40, k * 40 + n)) for k, n in enumerate(blocks))
    data = bytearray(b"head" + a + b + c)
    infill.rotate(np.frombuffer(data, np.uint8), 4, 4 + len(a), 4 + len(a + b))
    assert data == b"head" + b + a + c
    for form in ("psm", "spm"):
        text = b"one two" + a
        assert infill.restored(bytes(infill.arranged(text, 3, 5, form)), form) == text


# --- collocations ------------------------------------------------------------------


def _mined(rows, most, least, inside):
    found, total = Counter(), Counter()
    for kind, text in rows:
        kind = "und" if kind is None else kind
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[kind] += len(words)
            for n in (1, 2, 3, 4):
                for k in range(len(words) - n + 1):
                    found[kind, tuple(words[k : k + n])] += 1
    candidates = {k: n for k, n in found.items() if len(k[1]) > 1 and n >= least}
    scored = []
    for (kind, words), a in candidates.items():
        inner = lambda other: any(other[i : i + len(words)] == words for i in range(len(other) - len(words) + 1))
        if any(k == kind and len(o) > len(words) and inner(o) and 100 * n >= inside * a for (k, o), n in candidates.items()):
            continue
        cuts = [(2_000_000 * a // (found[kind, words[:k]] + found[kind, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        scored.append((kind, -score, -a, " ".join(words).encode(), found[kind, words[:k]], found[kind, words[k:]], total[kind]))
    out = []
    for kind, group in itertools.groupby(sorted(scored), key=lambda x: x[0]):
        out += [(kind, r, p.decode(), -a, x, y, n, -s) for r, (_, s, a, p, x, y, n) in enumerate(itertools.islice(group, most), 1)]
    return out


def _rows_of(frame):
    return sorted(tuple(r[c] for c in ("kind", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


def _texts():
    dice = np.random.default_rng(5)
    words = ["ТКО", "твердые", "коммунальные", "отходы", "Norm", "norm", "м3", "a-b", "в", "год", "é", " x"]
    rows = [(kind, " ".join(dice.choice(words, dice.integers(0, 40)).tolist()) + str(dice.choice([".", "!\n", ", ", ""]))) for kind in ("norms", "registry", None) for _ in range(120)]
    rows += [("norms", "твердые коммунальные отходы за год. " * 40), ("norms", "твердые коммунальные отходы за год. " * 40), ("norms", None), (None, ""), ("registry", " \t,.\r\n"), ("norms", "x " * 3000 + "y"), ("registry", "AB ab Ab aB " * 30)]
    return rows


@pytest.mark.parametrize("most, least, inside", [(2000, 30, 80), (7, 5, 50)])
def test_phrases_equal_brute_force(spark, most, least, inside):
    rows = _texts()
    files = spark.createDataFrame(rows, "kind string, text string").repartition(3).selectExpr("*", "'z' as w1", "1 as n", "'q' as phrase", "2 as size", "3 as level")
    assert _rows_of(phrases.mine_phrases(files, most, least, inside)) == sorted(_mined(rows, most, least, inside))


def test_phrases_over_parts_and_full_counters(spark, monkeypatch):
    """Texts cut into small parts, and a table of two counters that holds nothing back, give the same."""
    rows = _texts()[::3] + _texts()[-7:]
    batches = lambda: iter([__import__("pyarrow").RecordBatch.from_pylist([{"kind": k or "und", "text": t} for k, t in rows])])

    def counts(often):
        total = Counter()
        for batch in phrases._windows(often, batches()):
            for r in batch.to_pylist():
                words, kind = r["window"].split("\n")
                total[(kind, *(words.split(" ") + [""] * 3)[:4])] += r["n"]
        return total

    everything = np.ones(1 << phrases.COUNTER_BITS, bool)
    whole = counts(everything)
    monkeypatch.setattr(phrases, "PART", 64)
    assert counts(everything) == whole
    single = Counter()
    for (kind, *words), n in whole.items():
        single[kind, words[0]] += n
    assert sum(single.values()) == sum(len(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", t or "")) for _, t in rows)


def test_rare_windows_stay_where_they_are(monkeypatch):
    """Counters that rare phrases of all sizes would fill together still tell them apart when pairs are counted first."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "COUNTER_BITS", 17)
    monkeypatch.setattr(phrases, "KEYS", 1 << 18)
    dice = np.random.default_rng(3)
    texts = [" ".join(f"r{k}" for k in dice.integers(0, 250_000, 250_000)) + " one two three four. " * 10 for _ in range(4)]
    batches = lambda: (pa.RecordBatch.from_pylist([{"kind": "und", "text": t}]) for t in texts)

    def often(sizes, known=None):
        counted = sorted((c for b in phrases._counters(sizes, known and phrases.Often(known), batches()) for c in b.to_pylist()), key=lambda r: r["chunk"])
        merged = pa.RecordBatch.from_pylist(counted, pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))
        return [(r["chunk"], r["bits"]) for b in phrases._often(30, iter([merged])) for r in b.to_pylist()]

    def moved(told):
        windows = Counter()
        for batch in phrases._windows(phrases.Often(told), batches()):
            for r in batch.to_pylist():
                windows[r["window"].split("\n")[0]] += r["n"]
        assert windows["one two three four"] == 40 and sum(windows.values()) == 1_000_160
        return sum(n for w, n in windows.items() if " " in w)

    short = often((1, 2))
    assert 10 * moved(short + often((3, 4), short)) < moved(often((1, 2, 3, 4)))


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "kind string, text string")
    assert phrases.mine_phrases(empty).count() == 0
    assert phrases.mine_phrases(spark.createDataFrame([("norms", "a b"), (None, None)], "kind string, text string")).count() == 0


# --- toxic passages ------------------------------------------------------------------


def test_marginals_equal_enumeration():
    dice = np.random.default_rng(2)
    for n in (1, 2, 5, 9):
        odds, moves = np.exp(dice.normal(size=n)), np.exp(dice.normal(size=(2, 2)))
        odds[dice.random(n) < 0.3] = 0.0
        odds[-1] = 0.0
        weight, moved, total = np.zeros(n), np.zeros((2, 2)), 0.0
        for states in itertools.product((0, 1), repeat=n):
            value, last, own = 1.0, 0, np.zeros((2, 2))
            for k, s in enumerate(states):
                value *= moves[last, s] * (odds[k] if s else 1.0)
                own[last, s] += 1
                last = s
            weight += value * np.array(states)
            moved += value * own
            total += value
        p, expected = toxic_spans.marginals(odds, moves, pairs=True)
        assert np.allclose(p, weight / total) and np.allclose(expected, moved / total)


def test_line_ends_part_the_chain():
    dice = np.random.default_rng(3)
    moves = np.array([[1.0, 0.3], [0.4, 5.0]])
    lines = [np.exp(dice.normal(size=k)) for k in (3, 0, 700, 1)]
    whole, _ = toxic_spans.marginals(np.concatenate([np.append(x, 0.0) for x in lines]), moves)
    apart = [np.append(toxic_spans.marginals(np.append(x, 0.0), moves)[0][:-1], 0.0) for x in lines]
    assert np.allclose(whole, np.concatenate(apart))


PLAIN = ["норматив", "отходы", "объем", "масса", "год", "школа", "гостиница", "место", "житель", "тариф", "контейнер", "вывоз", "участок", "договор"]


def _rated(spark, n=240):
    """Every third text holds an insult in one of many forms; forms over 12 are in unrated texts only."""
    dice = np.random.default_rng(9)
    rows, ratings = [], []
    for k in range(n):
        words = [str(w) + str(dice.choice(["", "ы", "ов", "ам"])) for w in dice.choice(PLAIN, 30)]
        toxic, rated = k % 3 == 0, k % 4 > 0
        if toxic:
            for at in dice.integers(0, 30, 2).tolist():
                words[at] = "дурал" + "абвгдежзиклмнопр"[int(dice.integers(0, 12)) if rated else int(dice.integers(12, 16))] + "ей"
        rows.append((k, " ".join(words[:15]) + "\n" + " ".join(words[15:])))
        ratings.append((k, int(toxic)))
    return rows, spark.createDataFrame([r for r in ratings if r[0] % 4], "file bigint, toxic int"), dict(ratings)


def test_toxic_words_are_found_in_unseen_forms(spark, landed):
    rows, ratings, truth = _rated(spark)
    extra = [(1000, None), (1001, ""), (1002, "12 % \n\n"), (1003, "Норматив ДУРАЛкей! масса"), (1003, "Норматив ДУРАЛкей! масса"), (None, "дуралвей"), (1004, "масса " * 60_000 + "дуралгей")]
    noise = spark.createDataFrame([(None, 1), (3, None), (5, 7), (99_999, 1)], "file bigint, toxic int")
    found = toxic_spans.tag_files(landed(rows + extra), ratings.unionByName(noise)).collect()
    assert len(found) == len(rows) + len(extra)
    told = {r["file"]: r for r in found}
    assert all((told[k]["score"] >= 0.5) == bool(t) for k, t in truth.items())
    for k, text in rows:
        assert [text[s["start"] : s["stop"]] for s in told[k]["spans"]] == [m for x in text.split("\n") for m in re.findall(r"дурал\w+(?: дурал\w+)*", x)]
    assert all(told[k]["score"] == 0 and told[k]["spans"] == [] for k in (1000, 1001, 1002))
    assert [(s["start"], s["stop"]) for s in told[1003]["spans"]] == [(9, 17)] and told[None]["score"] >= 0.5
    assert [(s["start"], s["stop"]) for s in told[1004]["spans"]] == [(360_000, 360_008)]


def test_toxicity_without_ratings_or_files(spark, landed):
    rows, ratings, _ = _rated(spark, 24)
    for some in (ratings.limit(0), ratings.filter("toxic = 0"), ratings.filter("toxic = 1")):
        assert {(r["score"] < 0.01, len(r["spans"])) for r in toxic_spans.tag_files(landed(rows), some).collect()} == {(True, 0)}
    assert toxic_spans.tag_files(landed([]), ratings).count() == 0


def test_repeated_texts_teach_once():
    words = np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    other = words + np.uint64(12345)
    assert toxic_spans.distinct_texts([words, words[:-2], other, np.empty(0, np.uint64), words]) == [0, 2]
