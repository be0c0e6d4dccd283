"""Language, quality rules, quality scores and licences on landed texts."""

import re
import warnings
from collections import Counter

import numpy as np
import pytest

from ledgerfold.llm import language, licences, quality, records, rules

NORMS = "Норматив накопления твердых отходов на одного проживающего составляет в год по объему и массе"
ORDER = "Der Normwert für die Sammlung der Abfälle je Einwohner beträgt im Jahr nach Rauminhalt und Masse"


def test_file_texts_of_grids(spark):
    grids = spark.createDataFrame(
        [("a.docx", 1, "Таблица 2", 0, ["Школы", None, "3"]), ("a.docx", 0, "Таблица 1", 1, ["Гостиницы", "1,5"]), ("a.docx", 0, "Таблица 1", 0, ["Наименование", "кг"]), ("b.xlsx", 0, None, 0, [None, None])],
        "file string, table_idx int, title string, row_idx int, cells array<string>",
    )
    texts = {r["file"]: r["text"] for r in records.file_texts(grids).collect()}
    assert texts == {"a.docx": "Таблица 1\nНаименование кг\nГостиницы 1,5\nТаблица 2\nШколы 3", "b.xlsx": ""}


def _samples(spark):
    rows = [(k, NORMS, "ru") for k in range(3)] + [(k, ORDER, "de") for k in range(3, 6)] + [(6, None, "de"), (7, NORMS, None), (None, ORDER, "de")]
    return spark.createDataFrame(rows, "file bigint, text string, lang string")


def test_languages_of_known_and_unseen_words(spark, landed):
    files = landed([(1, "Норматив в год"), (2, "Abfälle je Masse"), (3, "накопленного объемного"), (4, "Einwohnern Normwerte"), (5, None), (6, ""), (7, "12 345 %"), (8, "щ"), (1, "Норматив в год"), (None, "Masse " * 30_000)])
    found = sorted((r["file"] or 0, r["lang_pred"], r["score"]) for r in language.detect_languages(files, _samples(spark)).collect())
    assert [(a, b) for a, b, _ in found] == [(0, "de"), (1, "ru"), (1, "ru"), (2, "de"), (3, "ru"), (4, "de"), (5, "und"), (6, "und"), (7, "und"), (8, "ru")]
    assert all(0 <= s <= 1 for _, _, s in found) and all(s == 0 for _, lang, s in found if lang == "und")


def test_languages_without_samples_or_files(spark, landed):
    none = _samples(spark).limit(0)
    assert language.detect_languages(landed([(1, "Норматив")]), none).first()["lang_pred"] == "und"
    assert language.detect_languages(landed([]), _samples(spark)).count() == 0


def test_backoff_takes_the_longest_known_gram():
    import numpy as np

    model = language.Model(["a", "b"], np.ones(2), {"norm": np.array([9.0, 0.0])}, {" nor": np.array([0.0, 5.0]), "qqqq": np.array([5.0, 0.0]), "o": np.array([5.0, 0.0]), "x": np.array([0.0, 1.0])})
    assert model.of_word("norm").argmax() == 0  # the word itself
    assert model.of_word("norx").argmax() == 1  # " nor" before the single letters
    assert model.of_word("ooo").argmax() == 0
    assert (model.of_word("zzz") == 0).all()


def _brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_brute_force(landed):
    eight = "a b c d e f g h "
    texts = [
        None, "", " \n\t", "one", eight, eight * 2, eight + "x " + eight, "a " * 40, "a\nb\na\n\na", "|x| <y> 5%\n" * 5, NORMS, NORMS + "\n" + NORMS,
        "é" * 9 + " ü", "w " * 20_000, " ".join(str(k) for k in range(3000)) + " " + " ".join(str(k) for k in range(1000, 1020)), "x\r\ny\x0bz\x0c1", eight * 2 + "b c d e f g h a",
    ]
    files = landed(list(enumerate(texts)) + [(3, "one")])
    got = rules.judge_files(files).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        expected = _brute_counts(texts[r["file"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected, r["file"]
        assert r["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r["kept"] and r["base_failed"])


def test_rules_weigh_each_other(landed):
    good = [(k, f"{NORMS} номер {k}.\nВсего за год {k} тонн, без перерасчета, как в приказе о нормативах для всех.") for k in range(60)]
    marks = [(100 + k, " ".join(f"{w}***&&&" for w in f"{NORMS} {k} {ORDER}".split())) for k in range(8)]
    bars = [(200 + k, " | ".join(f"{NORMS} {k} {ORDER}".split())) for k in range(8)]
    kept = {r["file"]: r["kept"] for r in rules.judge_files(landed(good + marks + bars)).collect()}
    assert {k for k, v in kept.items() if v} == {k for k, _ in good}
    assert rules.judge_files(landed([])).count() == 0


def test_quality_scores(spark, landed):
    good = [(k, f"{NORMS} {ORDER} {k}") for k in range(40)]
    poor = [(100 + k, f"{k} реклама!!! скидка!!! " * 12) for k in range(20)]
    rated = spark.createDataFrame([(k, 1) for k, _ in good[:30]] + [(k, 0) for k, _ in poor[:15]] + [(None, 1), (0, None), (1, 7), (999, 1), (2, 1)], "file bigint, quality int")
    files = landed(good + poor + [(500, None), (501, ""), (39, good[39][1]), (None, good[0][1] * 500)])
    got = quality.score_files(files, rated, epochs=8).collect()
    assert len(got) == 64 and all(0 <= r["score"] <= 1 for r in got)
    score = {r["file"]: r["score"] for r in got}
    assert min(score[k] for k in range(40)) > 0.5 > max(score[k] for k in range(100, 120))
    assert score[500] == score[501] and score[None] > 0.5
    again = {r["file"]: r["score"] for r in quality.score_files(files, rated, epochs=8).collect()}
    assert again == score


def test_quality_without_ratings(spark, landed):
    none = spark.createDataFrame([], "file bigint, quality int")
    assert [r["score"] for r in quality.score_files(landed([(1, "x"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert quality.score_files(landed([]), none).count() == 0


def _dice(a, b):
    cut = lambda t: {tuple(w[k : k + 2]) for w in [re.findall(r"[^\W_]+", t.lower())] for k in range(len(w) - 1)}
    a, b = cut(a), cut(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0


def test_licences_equal_brute_force(spark, landed):
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and len(t) > 200)
    texts = {
        1: None, 2: "", 3: "one", 4: "Licensed under the Apache License, Version 2.0.", 5: f"{NORMS}\nreleased UNDER the mit license\n{ORDER}", 6: mit, 7: mit.replace(", ", ",\n"),
        8: "\n\n".join([NORMS, mit.replace("without", "with").replace(" and ", "\nand "), "All rights reserved."]), 9: "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", 10: "the " * 5000,
    }
    found = {r["file"]: r for r in licences.find_licences(landed([*texts.items(), (4, texts[4])])).collect()}
    assert len(found) == 10
    for k, text in texts.items():
        pieces = {(n, 1): p for n, p in enumerate((text or "").split("\n"))}
        if "\n" in (text or ""):
            pieces[0, len(text.split("\n"))] = text
            at = 0
            for part in text.split("\n\n"):
                if "\n" in part:
                    pieces[at, part.count("\n") + 1] = part
                at += part.count("\n") + 2
        expected = []
        for (line, n), piece in sorted(pieces.items()):
            best = min(((-_dice(piece, t), name) for name, t in licences.TEMPLATES), default=(0, ""))
            if -best[0] >= licences.LEAST:
                expected.append((line, n, best[1], round(-best[0], 9)))
        assert [(x["line_no"], x["n_lines"], x["licence"], round(x["dice"], 9)) for x in found[k]["found"]] == expected, k
        assert found[k]["licences"] == sorted({x[2] for x in expected})


def test_licences_of_given_templates(spark, landed):
    given = spark.createDataFrame([("own", "Использование без разрешения запрещено приказом"), ("blank", None), ("one", "слово")], "licence string, text string")
    files = landed([(1, "использование БЕЗ разрешения — запрещено приказом!"), (2, "слово")])
    assert {r["file"]: r["licences"] for r in licences.find_licences(files, given).collect()} == {1: ["own"], 2: []}
    assert {tuple(r["licences"]) for r in licences.find_licences(files, given.limit(0)).collect()} == {()}
    assert licences.find_licences(landed([]), given).count() == 0


def test_unsettled_estimate_is_told(spark):
    names = list(rules.votes())
    patterns = spark.createDataFrame([(*[1] * 8, 70), (*[-1] * 8, 20), (1, -1, 1, -1, 0, 0, 0, 0, 10)], ", ".join(f"{n} int" for n in names) + ", n bigint")
    with pytest.warns(UserWarning, match="not settled in 1 round"):
        rules.estimate(patterns, names, rounds=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        rules.estimate(patterns, names)


def test_long_training_texts_are_whole():
    words = [f"слово{k}" for k in range(4000)]
    found, counts = quality.features(" ".join(words))
    _, buckets, _ = quality._word_values(words)
    assert len(found) == len(counts) > 3000
    assert set(buckets.tolist()) <= set(found.tolist())


def test_scoring_holds_few_texts_at_once():
    import numpy as np
    import pyarrow as pa

    from ledgerfold.llm import quality

    dice = np.random.default_rng(3)
    weights = dice.normal(size=quality.BUCKETS)
    texts = [None, "", "  ", *[" ".join(f"w{k}" for k in dice.integers(0, 500, n)) for n in dice.integers(1, 30_000, 60)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["file", "text"])
    told = list(quality._scored(weights, 0.25, True, iter([batch])))
    one_by_one = [next(quality._scored(weights, 0.25, False, iter([batch.slice(k, 1)]))).column(1)[0].as_py() for k in range(len(texts))]
    assert [f for b in told for f in b.column(0).to_pylist()] == list(range(len(texts)))
    assert [t for b in told for t in b.column(1).to_pylist()] == texts
    assert np.allclose([s for b in told for s in b.column(2).to_pylist()], one_by_one, rtol=1e-12)
    assert len(told) > 5 and all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= quality.SCORED_CHARS for b in told)
