"""Benchmark items in files, token files, and the pipeline of both."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerfold.llm import decontaminate, token_files

LETTERS = "абвгдежзиклмноп рстуф"


def _edits(item, text):
    """Least edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def _changed(dice, text, n):
    for _ in range(n):
        at = dice.randrange(len(text))
        text = dice.choice((text[:at] + dice.choice("xyz") + text[at + 1 :], text[:at] + text[at + 1 :], text[:at] + dice.choice("xyz") + text[at:]))
    return text


def test_items_within_the_budget_are_found(spark, landed):
    dice = random.Random(3)
    make = lambda n: " ".join("".join(dice.choice(LETTERS) for _ in range(n)).split())
    items = [(k, make(dice.randrange(60, 260))) for k in range(12)] + [(20, "кратко"), (21, None), (22, " \n "), (23, make(3000))]
    files, planted = [], {}
    for k in range(60):
        name, item = items[dice.randrange(12)] if k else items[-1]
        n = dice.choice((0, 1, 3, 5, 8, 12, 18, 30))
        held = _changed(dice, item, n)
        files.append((k, f"{make(200)} {held.upper() if k % 3 else held} {make(dice.randrange(400))}"))
        planted[k] = (name, item)
    files += [(100, None), (101, ""), (102, "это КРАТКО и ясно"), (103, "некратко"), (104, items[0][1].replace(" ", "\n\n")), (0, files[0][1]), (105, make(40_000))]
    got = decontaminate.find_items(landed(files), spark.createDataFrame(items, "item bigint, text string")).collect()
    assert len(got) == len(files)
    for r in got:
        found = {x["item"]: x["edits"] for x in r["found"]}
        assert r["clean"] == (not found)
        if r["file"] in planted:
            name, item = planted[r["file"]]
            text = decontaminate.plain(dict(files)[r["file"]])
            index = decontaminate.Items([(name, item)])
            edits, budget = _edits(index.long[0][1], text), int(index.budget[0])
            assert found == ({name: edits} if edits <= budget else {}), r["file"]
    rest = {r["file"]: [x["item"] for x in r["found"]] for r in got if r["file"] >= 100}
    assert rest == {100: [], 101: [], 102: [20], 103: [], 104: [0], 105: []}


def test_no_items_and_no_files(spark, landed):
    items = spark.createDataFrame([(1, "норматив накопления отходов")], "item bigint, text string")
    assert [r["clean"] for r in decontaminate.find_items(landed([(1, "норматив накопления отходов")]), items.limit(0)).collect()] == [True]
    assert decontaminate.find_items(landed([]), items).count() == 0


def test_blocks_of_items_find_the_same(spark, landed, monkeypatch):
    items = spark.createDataFrame([(k, f"пункт {k} приказа о нормативах накопления отходов") for k in range(9)], "item bigint, text string")
    files = landed([(k, f"как сказано, пункт {k} приказа о нормативах накопления отходов гласит") for k in range(12)])
    held = lambda: {r["file"]: sorted(x["item"] for x in r["found"] if not x["edits"]) for r in decontaminate.find_items(files, items).collect()}
    whole = held()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    assert held() == whole == {k: [k] if k < 9 else [] for k in range(12)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40))
def test_code_round_trip(values):
    control, data = token_files.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert token_files.unpack(control, data, len(values)).tolist() == values


def test_damaged_code_is_told():
    control, data = token_files.pack(np.array([1, 70_000, 3], np.uint32))
    with pytest.raises(ValueError):
        token_files.unpack(control, data[:-1], 3)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    known.encode_special_tokens = True
    return path, lambda text: [*known.encode(text or "", add_special_tokens=False).ids, token_files.END]


PIECES = ("норматив", "Of", "the", "1.5", "it's", "<|endoftext|>", "x²", "..", "a.", "b,", "(c).", "d!", "\x01", "日本", "\n", "\t", "", "  ")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map(" ".join), max_size=6))
def test_ids_are_the_tokenizers_own(tokenizer, texts):
    path, ids = tokenizer
    token_files._table_of(path).limit = 50  # forgets often
    assert [x.tolist() for x in token_files.encode([*texts, None], path)] == [ids(t) for t in [*texts, None]]


def test_encoding_holds_few_pieces_at_once(tokenizer, monkeypatch):
    """20 texts of 60,000 characters were held as pieces all at once."""
    (path, ids), texts, asked = tokenizer, [f"слово{k} раз " * 5000 for k in range(20)], []
    table = token_files._table_of(path)
    look = table.rows
    monkeypatch.setattr(table, "rows", lambda pieces: asked.append(len(pieces)) or look(pieces))
    found = [x.tolist() for x in token_files.encode(texts, path)]
    assert max(asked) < 40_000 and sum(asked) >= 20 * 10_000
    assert found == [ids(t) for t in texts]


def test_files_written_and_read_back(spark, landed, tokenizer, tmp_path, monkeypatch):
    path, ids = tokenizer
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 300)
    dice = random.Random(1)
    rows = [(k, " ".join(dice.choice(PIECES) for _ in range(dice.randrange(60)))) for k in range(80)] + [(90, None), (91, ""), (92, "слово " * 5000), (3, "ещё одно"), (None, "без номера")]
    folder = token_files.write_token_files(landed(rows), path, str(tmp_path / "tokens"))
    got = [tuple(r) for r in token_files.read_token_files(spark, folder).orderBy("start").collect()]
    order = {n: k for k, n in enumerate(sorted({r[0] for r in rows}, key=lambda n: (n is not None, n or 0)))}
    assert [order[g[0]] for g in got] == sorted(order[r[0]] for r in rows)
    start, left = 0, {}
    for n, text in rows:
        left.setdefault(n, []).append(ids(text))
    for n, at, size, crc in got:
        assert at == start
        match = next(x for x in left[n] if len(x) == size and zlib.crc32(np.array(x, "<u4").tobytes()) == crc)
        left[n].remove(match)
        start += size
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank")
    assert ranks.first()["rank"] == 0


def test_no_files_to_write(spark, landed, tokenizer, tmp_path):
    folder = token_files.write_token_files(landed([]), tokenizer[0], str(tmp_path / "none"))
    assert token_files.read_token_files(spark, folder).count() == 0


def test_pipeline_stages_keep_what_they_should(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rated = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [decontaminate.plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        frames[name] = (before.collect(), docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    before, after = frames["quality classifier"]
    kept = {r["doc_id"] for r in after}
    good = [d for d, q in rated.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert sum(d not in kept for d, q in rated.items() if q == 0) >= 0.6 * sum(q == 0 for q in rated.values())
    before, after = frames["MinHash near-dedup"]
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.encode().lower().split()] for k in range(max(1, len(w) - 4))}
    sets, up = {r["doc_id"]: shingles(r["text"]) for r in before}, {r["doc_id"]: r["doc_id"] for r in before}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in after} == {d for d in sets if root(d) == d}
    before, after = frames["benchmark decontamination"]
    held = {r["doc_id"] for r in before if any(i in decontaminate.plain(r["text"]) for i in items)}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - held
    before, after = frames["mixing sources to target weights"]
    texts, sizes, taken = {r["doc_id"]: r for r in before}, {}, {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    for r in after:
        assert r == texts[r["doc_id"]]
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values())
    assert all(taken.get(s, 0) <= 2 * n for s, n in sizes.items())
    before, after = frames["token-ID / binary output"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in after)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_near_copies_go_by_number_and_text(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text, other = "Норматив накопления отходов на одного жителя в год", "Совсем другой приказ о тарифах на вывоз для школ"
    rows = [(1, text), (5, text), (5, other), (None, text), (None, "ничей текст из шести разных слов"), (7, None), (None, None)]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id bigint, text string, source string")
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()}
    assert kept == {(1, text), (5, other), *rows[4:]}


def test_words_after_a_blank_are_told_for_every_code_point():
    for code in range(0x110000):
        piece = f" a{chr(code)}"
        alone = len(words := piece.split()) == 1 and piece == f" {words[0]}"
        assert (token_files._WORD(piece) is not None) == alone, hex(code)
