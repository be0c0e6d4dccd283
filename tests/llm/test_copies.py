"""Near copies of files and lines, and the components behind them."""

import random

from pyspark.sql import functions as F

from ledgerfold.llm import line_copies, near_copies
from ledgerfold.llm.components import connected


class Forest(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def test_components_of_random_links(spark):
    dice = random.Random(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(dice.randrange(80), dice.randrange(80)) for _ in range(50)] + [(200, k) for k in range(201, 240)] + [(7, 7)]
    forest = Forest()
    for a, b in links:
        forest.join(a, b)
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()}
    assert got == {n: forest.root(n) for a, b in links for n in (a, b) if (a, b) != (7, 7)}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _sets(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + min(width, len(words))]) for k in range(max(1, len(words) - width + 1))} if words else set()


def _groups(texts, width):
    sets, forest = {k: _sets(t, width) for k, t in texts.items()}, Forest()
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                forest.join(a, b)
    return {k: (len(sets[k]), forest.root(k)) for k in texts}


def _drifting(dice, n=40):
    """Orders of norms that drift apart: neighbours are near copies, ends are not."""
    words = [dice.choice("норматив школа гостиница место кг год объем масса тонна житель".split()) + str(dice.randrange(400)) for _ in range(120)]
    texts = {}
    for k in range(n):
        for _ in range(dice.choice((0, 1, 3, 6, 14))):
            words[dice.randrange(len(words))] = f"правка{dice.randrange(10**6)}"
        texts[k] = " ".join(words)
    return texts


def test_near_copies_equal_brute_force(landed, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)  # many block pairs
    texts = _drifting(random.Random(4))
    texts |= {100: None, 101: "", 102: " \n ", 103: "Одно", 104: "Одно", 105: "A b", 106: "a B", 107: "a c", 108: texts[3].upper(), 109: "w " * 60_000, 110: "w w"}
    for width in (2, 5):
        got = near_copies.near_copies(landed([*texts.items(), (3, texts[3])]), width).collect()
        assert len(got) == len(texts) + 1
        expected = _groups(texts, width)
        for r in got:
            assert (r["n_shingles"], r["component_id"]) == expected[r["file"]], (width, r)
            assert r["kept"] == (r["component_id"] == r["file"])


def test_near_copies_of_odd_rows(landed):
    text = "Норматив накопления на одного жителя в год"
    got = {(r["file"], r["component_id"], r["kept"]) for r in near_copies.near_copies(landed([(None, text), (5, text), (4, text), (None, "другое"), (None, None)])).collect()}
    assert got == {(None, 4, False), (5, 4, False), (4, 4, True), (None, None, True)}
    assert near_copies.near_copies(landed([])).count() == 0


def test_block_pairs_join_what_buckets_heads_miss(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    base = [set(range(k, k + 100)) for k in (0, 0, 0, 9, 9, 18, 18, 300, 300, 309)]
    rows = [(f"{k:02d}".encode(), sorted(hash((k // 1, x)) if x > 10**6 else x * 7919 for x in s)) for k, s in enumerate(base)]
    sets = {c: s for c, s in rows}
    import numpy as np

    hashed = {c: near_copies.W.mixed(np.array(s, np.uint64)) for c, s in sets.items()}
    frame = spark.createDataFrame([(bytearray(c), " ".join(map(str, np.sort(h).tolist()))) for c, h in hashed.items()], "copy binary, text string")
    grams_of = lambda texts: [np.array(t.split(), np.uint64) for t in texts]
    signed = spark.createDataFrame([(bytearray(c), bytearray(near_copies.signature(np.sort(h)).tobytes())) for c, h in hashed.items()], "copy binary, signed binary")
    members = frame.select(F.lit(1).cast("bigint").alias("band"), "copy")  # one bucket for all
    none = spark.createDataFrame([], "node binary, component binary")
    rest = near_copies._rest_of_links(members, none, frame.join(signed, "copy"), grams_of, "binary")
    got = {bytes(r["node"]): bytes(r["component"]) for r in connected(rest).collect()}
    forest = Forest()
    for a in sets:
        for b in sets:
            if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b])):
                forest.join(a, b)
    assert got == {c: forest.root(c) for c in sets if sum(forest.root(x) == forest.root(c) for x in sets) > 1}


def _kept_lines(files):
    grams = lambda x: {x[k : k + 6] for k in range(max(1, len(x) - 5))} if len(x) >= 6 else {x}
    places = {}
    for file, text in sorted(files.items()):
        for n, line in enumerate((text or "").split("\n")):
            if line.strip():
                places.setdefault(line, []).append((file, n))
    forest, lines = Forest(), list(places)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            s, t = grams(a), grams(b)
            if 100 * len(s & t) >= 80 * len(s | t):
                forest.join(a, b)
    first = {}
    for line in lines:
        first[forest.root(line)] = min(first.get(forest.root(line), places[line][0]), places[line][0])
    removed = {f: [] for f in files}
    for line in lines:
        for file, n in places[line]:
            if (file, n) != first[forest.root(line)]:
                removed[file].append(n)
    return {f: sorted(x) for f, x in removed.items()}


def test_line_copies_equal_brute_force(landed):
    dice = random.Random(6)
    known = ["Норматив накопления отходов составляет %d кг на место в год по приказу" % k for k in range(5)] + ["Итого", "кг", "№", "Лист 1 из 20", "-" * 300]
    files = {}
    for k in range(25):
        rows = [dice.choice(known) for _ in range(6)] + [f"Строка {dice.randrange(10**9)} своего вида {dice.randrange(10**9)}", "", "  "]
        rows.append(dice.choice(known[:5]).replace("отходов", dice.choice(("отходов", "отхода", "твердых"))))
        files[k] = "\n".join(dice.sample(rows, len(rows)))
    files |= {50: None, 51: "", 52: "\n\n", 53: "одна строка\r", 54: "x" * 100_000 + "\nкг"}
    expected = _kept_lines(files)
    got = line_copies.drop_line_copies(landed([*files.items(), (0, files[0])])).collect()
    assert len(got) == len(files) + 1
    for r in got:
        text = files[r["file"]]
        assert r["removed"] == expected[r["file"]], r["file"]
        assert r["n_lines"] == (0 if text is None else text.count("\n") + 1)
        assert r["text"] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in expected[r["file"]]))
    assert line_copies.drop_line_copies(landed([])).count() == 0


def test_links_whose_signatures_agree_less_than_their_sets():
    import numpy as np
    import pyarrow as pa

    x = np.random.default_rng(949).integers(0, 1 << 64, 25, dtype=np.uint64)  # found by search
    sets = [np.sort(x[:22]), np.sort(np.concatenate([x[:20], x[22:]]))]  # 20 of 25 shared
    signed = [near_copies.signature(s).ravel() for s in sets]
    assert 0.5 < (signed[0] == signed[1]).mean() < 0.63
    at = {"band": [1, 1], "low": [0, 0], "high": [0, 0], "side": [near_copies.SAME] * 2, "copy": [b"a", b"b"], "label": [b"a", b"b"]}
    shape = pa.schema([("band", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("side", pa.int32()), ("copy", pa.binary()), ("label", pa.binary())])
    rows = [pa.array(at[f.name], f.type) for f in shape]
    first = pa.RecordBatch.from_arrays([*rows, pa.array([s.tobytes() for s in signed], pa.binary())], names=[*shape.names, "signed"])
    assert sum(b.num_rows for b in near_copies._active(shape, iter([first]))) == 2
    whole = pa.RecordBatch.from_arrays([*rows, pa.array([" ".join(map(str, s.tolist())) for s in sets])], names=[*shape.names, "text"])
    ends = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    assert [b.to_pylist() for b in near_copies._links_of_blocks(lambda texts: [np.array(t.split(), np.uint64) for t in texts], ends, iter([whole]))] == [[{"a": b"a", "b": b"b"}]]


def test_bit_maps_grow_with_their_keys(spark):
    import numpy as np

    for n in (1, 5000, 40_000):
        keys = spark.range(n).selectExpr("id * 7 as k", "1 as other")
        held, bits = near_copies.bit_map(keys, "k")
        assert bits == max(16, int(np.ceil(np.log2(16 * n)))) and len(held) == max(4096, 1 << (bits - 6))
        rows = spark.range(20 * n).selectExpr("id as k", "'x' as band")
        kept = near_copies.held_back(rows, keys, "k", "k bigint, band string")
        assert {r["k"] for r in kept.collect()} >= {k for k in range(0, min(7 * n, 20 * n), 7)} and kept.count() < 20 * n / 2


def test_members_of_a_head_are_compared_in_blocks(spark, monkeypatch):
    """One bucket with more members than a block, all of which are near copies of its head."""
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    texts = {k: "контейнер вывоз тариф участок договор место житель школа " * 6 + f"номер {k}" for k in range(23)}
    files = spark.createDataFrame(list(texts.items()), "file bigint, text string").repartition(3)
    got = near_copies.near_copies(files, 2).collect()
    assert {(r["component_id"], r["kept"] == (r["file"] == 0)) for r in got} == {(0, True)}


def test_signatures_take_a_byte_a_value_and_never_seem_less_near():
    import numpy as np

    dice = np.random.default_rng(3)
    pool = dice.integers(0, 1 << 64, 400, dtype=np.uint64)
    sets = [np.sort(dice.choice(pool, n, replace=False)) for n in (1, 2, 40, 300, 390)]
    rows = [np.frombuffer(x, np.uint8) for x in near_copies.signatures(sets).to_pylist()]
    whole = [near_copies.signature(s).ravel() for s in sets]
    assert {len(r) for r in rows} == {2 * near_copies.BANDS * near_copies.PER_BAND}
    assert all((rows[i] == rows[k]).sum() >= (whole[i] == whole[k]).sum() for i in range(5) for k in range(5))


def test_buckets_with_the_same_members_are_compared_once(spark):
    import numpy as np

    texts = {b"a": range(100), b"b": range(5, 105), b"c": range(500, 600)}
    bodies = spark.createDataFrame([(bytearray(c), " ".join(map(str, np.sort(near_copies.W.mixed(np.array(x, np.uint64))).tolist()))) for c, x in texts.items()], "copy binary, text string")
    members = bodies.crossJoin(spark.range(5).select(F.col("id").alias("band"))).filter("band < 4 or copy <> X'63'").select("band", "copy")
    none = spark.createDataFrame([], "node binary, component binary")
    rest = near_copies._rest_of_links(members, none, bodies, lambda texts: [np.array(t.split(), np.uint64) for t in texts], "binary").collect()
    assert [{bytes(r["a"]), bytes(r["b"])} for r in rest] == [{b"a", b"b"}] * 2  # of five buckets, by their members two


def test_lines_of_every_length_have_the_grams_of_their_own():
    lines = ["a", "ab", "abcdef", "x", "abcdefg", "Норматив накопления", "xy"]
    alone = [line_copies.line_grams([x])[0].tolist() for x in lines]
    assert [x.tolist() for x in line_copies.line_grams(lines)] == alone
    assert [len(x) for x in alone] == [max(1, len(x) - 5) for x in lines]
