import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.textkit import Hasher, flat, grams, parts, runs, sliding_min, winnow, word_bytes
from tests.llm.util import words


def hashed(texts, limit=1 << 18):
    hasher, inside, out = Hasher(), word_bytes(), []
    for a, b, data, offsets in parts(pa.array(texts, pa.string()), limit):
        starts, ends, owner = runs(inside[data], offsets)
        h = hasher(data, starts, ends)
        out += [(a + d, data[s:e].tobytes().decode(), int(x)) for d, s, e, x in zip(owner, starts, ends, h)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abc é,\n1", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_are_the_same_however_texts_are_cut(texts, limit):
    got = hashed([None if t is None else t.lower() for t in texts], limit)
    assert [(d, w) for d, w, _ in got] == [(i, w) for i, t in enumerate(texts) if t for w in words(t)]
    assert len({w for _, w, _ in got}) == len({h for _, _, h in got}) == len({(w, h) for _, w, h in got})


def test_sliced_arrays():
    a = pa.array(["no", "ab cd", None, "ef"], pa.string())[1:]
    data, offsets = flat(a)
    assert data.tobytes() == b"ab cdef" and offsets.tolist() == [0, 5, 5, 7]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 9))
def test_sliding_min(x, w):
    if len(x) >= w:
        assert sliding_min(np.array(x), w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]


def test_winnow_with_empty_documents_at_the_end():
    x = np.full(2, 7 << 40, np.uint64)
    assert winnow(x, np.array([0, 2, 2]), 3).tolist() == [1] and winnow(x, np.array([0, 0, 2, 2, 2]), 3).tolist() == [1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=25), min_size=1, max_size=5), st.integers(1, 6))
def test_winnow_keeps_the_rightmost_minimum_of_each_window(docs, w):
    values = [np.uint64(x) << np.uint64(40) for d in docs for x in d]
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    expected = set()
    for lo, hi in zip(first[:-1], first[1:]):
        for i in range(lo, max(hi - w + 1, lo + (hi > lo))):
            window = range(i, min(i + w, hi))
            expected.add(min(window, key=lambda j: (values[j], -j)))
    assert set(winnow(np.array(values, np.uint64), first, w).tolist()) == expected


def test_grams_depend_on_order():
    rng = random.Random(0)
    w = np.array([rng.getrandbits(64) for _ in range(6)], np.uint64)
    assert len(set(grams(np.concatenate((w, w[::-1])), 2).tolist())) == 11  # the middle pair is one value twice over
