import random

import numpy as np
import pytest

from lodestone.llm import language_id
from lodestone.llm.language_id import BITS, features, ftrl, identify, letters, softmax, temperature, train
from lodestone.llm.textkit import flat
from tests.llm.util import DOCS, prose

SOUNDS = {"aa": "abcdea", "bb": "uvwxyu", "cc": "éàçôéè"}


def labelled(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(8, 60), SOUNDS[lang]), lang, "s", 0) for i, lang in enumerate(rng.choice(list(SOUNDS)) for _ in range(n))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def model(spark):
    return train(labelled(spark, 240, 1), 150)


def test_held_out_accuracy(spark, model):
    docs = labelled(spark, 300, 2)
    got = {r.doc_id: (r.lang_pred, r.accepted) for r in identify(docs, model=model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(got[d] == (lang, True) for d, lang in truth.items()) >= 0.98 * len(truth)
    assert model["held_out"] >= 0.98 and 0.05 < model["temperature"] < 20


def test_awkward_rows(spark, model):
    long = prose(random.Random(4), 30_000, SOUNDS["bb"])
    rows = [(1, None), (2, ""), (3, "12 ... !!"), (None, long), (4, "abc dea"), (4, "abc dea")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).selectExpr("*", "1 as pick", "2 as confidence", "3 as rank")
    got = [(r.doc_id, r.lang_pred, r.accepted) for r in identify(docs, model=model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und", False), (2, "und", False), (3, "und", False), (None, "bb", True), (4, "aa", True), (4, "aa", True)], key=str)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([(1, "some text", None, None, None)], DOCS)
    assert [(r.lang_pred, r.accepted) for r in identify(none).collect()] == [("und", False)]
    assert identify(none.limit(0)).count() == 0


def test_one_language(spark):
    one = spark.createDataFrame([(i, "some text here", "xx", None, None) for i in range(12)], DOCS)
    assert {r.lang_pred for r in identify(one).collect()} == {"xx"}


def test_weights_are_sparse_where_nothing_is_learnt():
    rng = np.random.default_rng(0)
    examples = [(np.array([i % 2, 2 + rng.integers(0, 50)]), np.array([1.0, 0.01])) for i in range(200)]
    w = ftrl(examples, [i % 2 for i in range(200)], 2, l1=0.5)
    assert (w[52:] == 0).all() and (w[2:52] == 0).mean() > 0.9 and w[0, 0] > 0 > w[0, 1]


def test_temperature_recovers_a_known_one():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert abs(temperature(logits * 3, labels) - 3) < 0.3


def naive_grams(text):
    """Buckets and counts, character by character."""
    t = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower())
    out, m = {}, 0xFFFFFFFF
    for k in (1, 2, 3) if t.strip(" ") else ():
        for i in range(len(t) - k + 1):
            h = k * 0x27D4EB2F & m
            for c, f in zip(t[i : i + k], (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)):
                h = (h ^ ord(c)) * f & m
                h ^= h >> 15
            b = (h * 0x2C1B3C6D & m) >> (32 - BITS)
            out[b] = out.get(b, 0) + 1
    return out


TEXTS = ["Abc, déf!", "", "12 ..", "a", "ab", "éé é", "the cat the cat", "x" * 50, "日本 text"]


def test_features_against_a_naive_version():
    import pyarrow as pa

    first, where, counts = features(*letters(*flat(pa.array([t.lower() for t in TEXTS]))))
    for i, t in enumerate(TEXTS):
        own = slice(first[i], first[i + 1])
        assert dict(zip(where[own].tolist(), counts[own].tolist())) == naive_grams(t)


def test_weights_against_a_naive_follow_the_regularised_leader():
    rng = np.random.default_rng(3)
    examples = [(rng.choice(60, 5, replace=False), rng.normal(size=5)) for _ in range(40)]
    labels = rng.integers(0, 3, 40).tolist()
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1
    z, n = {}, {}

    def weight(j, c):
        v = z.get((j, c), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((beta + n.get((j, c), 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(2):
        for i in order.permutation(40):
            where, x = examples[i]
            logits = [sum(v * weight(j, c) for j, v in zip(where, x)) for c in range(3)]
            p = np.exp(logits) / np.exp(logits).sum()
            step = [(j, c, v * (p[c] - (c == labels[i])), weight(j, c)) for j, v in zip(where, x) for c in range(3)]
            for j, c, g, w in step:
                old = n.get((j, c), 0.0)
                n[j, c] = old + g * g
                z[j, c] = z.get((j, c), 0.0) + g - (n[j, c] ** 0.5 - old**0.5) / alpha * w
    got = ftrl(examples, labels, 3, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert np.allclose(got[:60], [[weight(j, c) for c in range(3)] for j in range(60)]) and not got[60:].any()


def test_query_against_a_naive_version(spark):
    """Document frequencies, idf and probabilities of a small table, from the fitted weights."""
    docs = labelled(spark, 90, 5)
    m = train(docs, 60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    grams = {i: naive_grams(t) for i, t in texts.items()}
    df = np.zeros(1 << BITS)
    for g in grams.values():
        df[list(g)] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    assert np.allclose(m["idf"], idf, atol=1e-5)
    for r in identify(docs, model=m).collect():
        g = grams[r.doc_id]
        x = np.array([(1 + np.log(n)) * idf[b] for b, n in g.items()])
        p = softmax((x / np.sqrt(x @ x) @ m["weights"][list(g)] / m["temperature"])[None])[0]
        assert r.lang_pred == m["langs"][p.argmax()] and abs(r.confidence - p.max()) < 1e-5 and r.accepted == (p.max() >= 0.5)


def test_the_bound_on_labelled_rows_holds(spark, monkeypatch):
    """With more labels than rows, and where a third of the rows are one row without an id."""
    taken = []
    monkeypatch.setattr(language_id, "ftrl", lambda examples, labels, n: taken.append((len(examples), n)) or np.zeros((1 << BITS, n)))
    rng = random.Random(6)
    many = [(i, prose(rng, 9), f"l{i % 40:02}", None, None) for i in range(120)]
    train(spark.createDataFrame(many, DOCS), 20)
    train(spark.createDataFrame([(None, "same words here", "aa", None, None)] * 60 + many[:80:40] * 20, DOCS), 30)
    assert taken[0] == (20, 20) and taken[1][0] + taken[1][0] // 4 <= 30
