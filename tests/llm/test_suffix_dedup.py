from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.suffix_dedup import common_prefixes, repeated, repeats, suffix_array
from tests.llm.util import DOCS, awkward, prose, seeded, table, words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=14), min_size=1, max_size=6))
def test_suffix_array_and_common_prefixes(pieces):
    t = np.concatenate([[*p, 0] for p in pieces])
    sa = suffix_array(t)

    def suffix(i):
        end = i + int(np.argmax(t[i:] == 0))
        return t[i:end].tolist()

    assert sorted(sa) == list(range(len(t)))
    assert [suffix(i) for i in sa] == sorted(suffix(i) for i in range(len(t)))
    for a, b, n in zip(sa[:-1], sa[1:], common_prefixes(t, sa[:-1], sa[1:], 5)):
        x, y = suffix(a), suffix(b)
        assert n == min(5, next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 2), min_size=3, max_size=12), min_size=1, max_size=5))
def test_repeated_windows(pieces):
    windows = Counter(tuple(p[i : i + 3]) for p in pieces for i in range(len(p) - 2))
    got = repeated([np.array(p, np.uint32) for p in pieces], np.zeros(len(pieces), bool), 3)
    assert [g.tolist() for g in got] == [[windows[tuple(p[i : i + 3])] > 1 for i in range(len(p) - 2)] for p in pieces]


def brute(texts, length=50):
    tokens = {i: words(t) for i, t in enumerate(texts) if t}
    seen = Counter(tuple(w[p : p + length]) for w in tokens.values() for p in range(len(w) - length + 1))
    out = set()
    for d, w in tokens.items():
        cover = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                cover[p : p + length] = [True] * length
        edges = [i for i in range(len(w) + 1) if (cover[i] if i < len(w) else False) != (cover[i - 1] if i else False)]
        out |= {(d, a, b) for a, b in zip(edges[::2], edges[1::2])}
    return out


def corpus():
    rng = seeded(11)
    texts = awkward(rng)
    passages = [prose(rng, n) for n in (49, 50, 51, 80, 300)]
    for p in passages * 3:
        texts.append(f"{prose(rng, rng.randint(0, 90))} {p.upper()}, {prose(rng, rng.randint(0, 90))}")
    return [*texts, passages[4], passages[4], "la " * 120, "ti ta " * 40, prose(rng, 30_000) + " " + passages[3]]


def adjoining(spans):
    """Spans that touch are one."""
    out = []
    for d, a, b in sorted(spans):
        if out and out[-1][0] == d and a <= out[-1][2]:
            out[-1] = (d, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((d, a, b))
    return out


def test_against_brute_force(spark, monkeypatch):
    texts = corpus()
    got = [tuple(r) for r in repeats(table(spark, texts)).collect()]
    assert sorted(got) == adjoining(brute(texts)) and len(got) > 15
    monkeypatch.setattr("lodestone.llm.suffix_dedup.TOKENS_A_SORT", 200)  # many small sorts find the same
    assert sorted(tuple(r) for r in repeats(table(spark, texts)).collect()) == sorted(got)


def test_empty_table_and_repeated_rows(spark):
    assert repeats(spark.createDataFrame([], DOCS)).count() == 0
    text = prose(seeded(1), 80)
    assert repeats(spark.createDataFrame([(1, text, None, None, None)] * 2, DOCS)).count() == 0


def test_ids_that_clash(spark):
    """Each text has its own spans, whatever the other rows of its id are."""
    rng = seeded(2)
    p = prose(rng, 70)
    rows = [(1, f"a b {p}"), (1, prose(rng, 60)), (1, f"{p} x y z"), (2, "too short"), (2, prose(rng, 90)), (None, p)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows * 2], DOCS)
    assert sorted(tuple(r) for r in repeats(docs).collect()) == [(1, 0, 70), (1, 2, 72)]


def test_hot_anchors_find_the_same(spark):
    """Whether a group is sorted or its windows meet one by one doesn't show."""
    texts = corpus()
    rng = seeded(12)
    notice = prose(rng, 60)
    texts += [f"{prose(rng, 30)} {notice} {prose(rng, 30)}" for _ in range(40)] + [notice] * 5
    expected = adjoining(brute(texts))
    for hot in (1, 12, 1 << 16):
        assert sorted(tuple(r) for r in repeats(table(spark, texts), hot=hot).collect()) == expected
