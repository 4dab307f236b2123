import numpy as np

from lodestone.llm.near_dup import _buckets, _meet, cardinality, joint_jaccard, keep_one, near_duplicates, registers
from tests.llm.util import DOCS, awkward, prose, seeded, table, words


def shingle_set(text):
    w = words(text or "")
    return {tuple(w[i : i + 3]) for i in range(max(len(w) > 0, len(w) - 2))}


def groups(texts, least=0.5):
    sets = {i: s for i, t in enumerate(texts) if (s := shingle_set(t))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return pairs, {i: find(i) for i in {x for p in pairs for x in p}}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "zz%d" % rng.randrange(10**6)
    return " ".join(w)


def corpus():
    rng = seeded(5)
    texts = awkward(rng, 25)
    base = [prose(rng, 120) for _ in range(6)]
    for b in base:
        texts += [b, b.title() + ".", *[edited(rng, b, rng.randint(1, 6)) for _ in range(rng.randint(1, 12))]]
    return texts + [base[0]] * 40 + ["tiny", "Tiny!", "two words", "two words"]


def test_groups_against_brute_force(spark):
    texts = corpus()
    pairs, expected = groups(texts)
    got = {r.doc_id: r.keep_id for r in near_duplicates(table(spark, texts)).collect()}
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs) >= 0.97 * len(pairs)
    assert set(got) <= set(expected) and all(expected[d] == expected[k] for d, k in got.items())


def test_one_of_each_group_stays(spark):
    docs = table(spark, ["a b c d", "A b, c d", "else", None, ""])
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [0, 2, 3, 4]


def test_ids_that_clash(spark):
    """Texts of one id are documents of their own: each may be kept, or be a copy of another's."""
    rng = seeded(4)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (2, b), (3, c), (4, edited(rng, a, 2)), (4, edited(rng, c, 2)), (None, a), (5, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = sorted(tuple(r) for r in near_duplicates(docs).collect())
    assert got == [(1, 1, False), (1, 1, True), (2, 1, True), (3, 3, False), (4, 1, False), (4, 3, False)]
    kept = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (3, c), (None, a), (5, None)], key=str)


def test_split_buckets_hold_every_member():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    key = np.sort(rng.choice([1, 2, 3, 4, 5], 200, p=[0.7, 0.1, 0.1, 0.05, 0.05]))
    doc = np.concatenate([np.sort(rng.permutation(1000)[: (key == k).sum()]) for k in range(1, 6)])
    for step in (7, 50, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + step]), pa.array(doc[i : i + step])], names=["key", "doc_id"]) for i in range(0, 200, step)]
        for most in (3, 15, 1000):
            out = [r for b in _buckets(most)(batches) for r in b.to_pylist()]
            assert all(len(r["members"]) == r["n"] <= most for r in out)
            for k in range(1, 6):
                own = sorted((r for r in out if r["key"] == k), key=lambda r: r["part"])
                assert [r["part"] for r in own] == list(range(len(own)))
                assert [d for r in own for d in r["members"]] == doc[key == k].tolist()


def test_hot_buckets_in_parts_lose_no_pair(spark):
    texts = corpus()[:60]
    pairs, _ = groups(texts)
    whole = {(r.doc_id, r.keep_id) for r in near_duplicates(table(spark, texts), bands=16, rows=1).collect()}
    split = {(r.doc_id, r.keep_id) for r in near_duplicates(table(spark, texts), bands=16, rows=1, most=4).collect()}
    assert whole == split and len(pairs) > 5


def test_empty_table_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e", None, None, None)] * 2, DOCS)
    assert near_duplicates(twice).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b, both = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (2000, 3000, 5000))
    x, y = np.concatenate((a, both)), np.concatenate((b, both))
    rx, ry = (registers(v, np.array([0, len(v)]), 1024) for v in (x, y))
    union = registers(np.concatenate((x, y)), np.array([0, len(x) + len(y)]), 1024)
    assert (union == np.maximum(rx, ry)).all()
    assert abs(cardinality(rx)[0] / 7000 - 1) < 0.15
    assert abs(joint_jaccard(rx, ry)[0] - 0.5) < 0.06


def test_a_bucket_of_different_documents_loses_no_pair(spark):
    """With one row a band nearly everything meets; the leaders then do all comparisons."""
    texts = corpus()[:40]
    pairs, _ = groups(texts)
    got = {r.doc_id: r.keep_id for r in near_duplicates(table(spark, texts), bands=64, rows=1).collect()}
    assert all(got.get(a, -1) == got.get(b, -2) for a, b in pairs)


def test_near_copies_within_a_family_that_is_not_quite_near(spark):
    """All share a passage (similarity 0.45), pairs share more (0.55): whoever is near a leader only by estimate must lead too."""
    rng = seeded(8)
    passage, texts = prose(rng, 126), []
    for _ in range(200):
        more = prose(rng, 18)
        texts += [f"{passage} {more} {prose(rng, 58)}" for _ in "ab"]
    pairs, _ = groups(texts)
    assert len(pairs) == 200
    got = {r.doc_id: r.keep_id for r in near_duplicates(table(spark, texts)).collect()}
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs) >= 0.92 * len(pairs)
    assert all((k, d) in set(pairs) for d, k in got.items() if d != k)


def test_members_of_different_leaders_meet_unless_linked():
    """Neighbours of a chain are near: 1 and 2 are reached by the leaders 0 and 3, their own pair comes in a later round."""
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [h[i * 300 : i * 300 + 1000] for i in (0, 1, 2, 3)]
    regs = registers(np.concatenate(sets), np.arange(5) * 1000, 1024)[[0, 3, 1, 2]]
    a, b, left = _meet(regs, np.arange(4), 0.4, 1)
    assert {(0, 2), (1, 3)} <= set(zip(a, b)) and set(left) == {2, 3}
    a, b, left = _meet(regs[left], np.array([0, 1]), 0.4, 4)
    assert list(zip(a, b)) == [(0, 1)] and not len(left)
    assert [len(x) for x in _meet(regs, np.zeros(4, int), 0.4, 1)] == [0, 0, 0]
