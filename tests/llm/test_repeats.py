"""Long repeats, against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerfold.llm import repeats


def _expected(texts, least):
    """Per text (bytes, removed, runs, hash) by looking at all windows of all rows."""
    raws = [(k, (t or "").encode()) for k, t in texts]
    seen = Counter(raw[s : s + least] for _, raw in raws for s in range(len(raw) - least + 1))
    out = []
    for k, raw in raws:
        gone = [False] * len(raw)
        for s in range(len(raw) - least + 1):
            if seen[raw[s : s + least]] > 1:
                gone[s : s + least] = [True] * least
        rest = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(g and (not n or not gone[n - 1]) for n, g in enumerate(gone))
        out.append((k, len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest(), rest))
    return sorted(out, key=str)


def _told(frame):
    return sorted(((r["file"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in frame.collect()), key=str)


def _orders(dice):
    passage = "".join(dice.choice("абвгд ") for _ in range(90))
    texts = [(k, "".join(dice.choice("abcdeé \n") for _ in range(dice.randrange(260)))) for k in range(40)]
    texts += [(100 + k, t[: len(t) // 2] + passage[dice.randrange(20) : 60 + dice.randrange(30)] + t[len(t) // 2 :]) for k, t in texts[:25]]
    texts += [(200 + k, t) for k, t in texts[:6]] + [(300, "ab" * 90), (301, "x" * 70 + "ab" * 30), (302, None), (303, ""), (None, texts[3][1]), (0, texts[0][1]), (304, "x" * 30_000)]
    return texts


def test_repeats_equal_brute_force(landed):
    for seed, crowd in ((1, repeats.CROWD), (2, 1)):  # with 1 all windows of crowded grams are counted
        texts = _orders(random.Random(seed))
        got = _told(repeats.remove_repeats(landed(texts), least=40, gram=8, crowd=crowd))
        assert got == _expected(texts, 40)


def test_nothing_repeats(landed):
    texts = [(1, "коротко"), (2, None), (3, "0123456789" * 3)]
    assert _told(repeats.remove_repeats(landed(texts))) == _expected(texts, 400)
    assert repeats.remove_repeats(landed([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=7).map(lambda b: bytes(x % 2 + 97 for x in b)), st.binary(min_size=1, max_size=7).map(lambda b: bytes(x % 3 + 97 for x in b))), min_size=2, max_size=14, unique=True), st.integers(2, 9))
def test_interval_tree_finds_the_deepest_partner(places, least):
    lefts, rights = [a[::-1] for a, _ in places], [b for _, b in places]
    shared = repeats.shared_prefix

    def best(s, o):
        return [max((shared(s[i], s[j]) for j in range(len(s)) if i != j and shared(s[i], s[j]) + shared(o[i], o[j]) >= least), default=0) for i in range(len(s))]

    assert repeats.extents(places, least) == list(zip(best(lefts, rights), best(rights, lefts)))


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3))
def test_equal_windows_have_their_anchor_at_one_place(seed, letters):
    dice = random.Random(seed)
    common = bytes(dice.randrange(letters) for _ in range(60))
    found = []
    for _ in range(2):
        before = bytes(dice.randrange(letters) for _ in range(dice.randrange(80)))
        raw = before + common + bytes(dice.randrange(letters) for _ in range(dice.randrange(80)))
        at, _ = repeats.anchors(np.frombuffer(raw, np.uint8), 40, 8)
        found.append({a - len(before) for a in at.tolist()})
    for s in range(21):
        places = [{a for a in f if s <= a <= s + 32} for f in found]
        assert places[0] & places[1]


def test_repeats_that_begin_at_their_anchor(landed):
    texts = [(1, "=" * 400), (2, "x" + "=" * 1000), (3, "-" * 399), (4, "y" + "-" * 500)]
    for crowd in (repeats.CROWD, 1):
        assert _told(repeats.remove_repeats(landed(texts), crowd=crowd)) == _expected(texts, 400)
    texts = [(1, "=" * 40), (2, "x" + "=" * 100), (3, "ab" * 20), (4, "c" + "ab" * 30)]
    assert _told(repeats.remove_repeats(landed(texts), least=40, gram=8)) == _expected(texts, 40)
