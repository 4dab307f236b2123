import math
from collections import Counter, defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.mixing import exponent_for, mix, mix_sql, scaled, weights
from tests.llm.util import DOCS, prose, seeded


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(1, 1e6), min_size=2, max_size=12), st.floats(0.5, 0.99), st.floats(1.1, 20))
def test_exponent(tokens, entropy, repeats):
    budget = sum(tokens)
    a = exponent_for(tokens, budget, entropy, repeats)
    q = scaled(tokens, a)
    over = max(x * budget / t for x, t in zip(q, tokens))
    assert math.isclose(sum(q), 1) and 0 <= a <= 1 and over <= repeats * (1 + 1e-4)
    h = -sum(x * math.log(x) for x in q if x)
    exact = over >= repeats * (1 - 1e-4) or a >= 1 - 1e-8
    assert exact or abs(h - entropy * math.log(len(tokens))) < 1e-4


def test_weights_of_nothing_and_of_one():
    assert weights({}, 10) == {} and weights({"a": 5}, 10) == {"a": 1.0}


def corpus(spark):
    rng = seeded(9)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", rng.choice(["hot"] * 8 + ["a", "b", None]), 0) for i in range(400)]
    rows += [(1000, None, None, "a", None), (1001, "  ", None, "a", None), (None, "lost", None, "a", None), (1002, prose(rng, 20_000), None, "rare", None)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as tokens", "2 as epoch", "3 as key", "4 as quota")


def test_against_sql_and_quotas(spark):
    docs = corpus(spark)
    got = mix(docs, block_tokens=3000).collect()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    assert sorted(tuple(r) for r in got) == sorted(con.execute(mix_sql(block_tokens=3000)).fetchall())
    tokens, used, blocks = defaultdict(int), Counter(), defaultdict(Counter)
    for i, t, s in docs.select("doc_id", "text", "source").collect():
        if t and i is not None:
            tokens[s or ""] += len(t.split())
    for r in got:
        used[r.source] += r.tokens
        blocks[r.block][r.source] += r.tokens
    share = weights(tokens, sum(tokens.values()))
    longest = max(r.tokens for r in got if r.source != "rare")
    for s in ("hot", "a", "b", ""):
        assert 0 <= used[s] - math.floor(share[s] * sum(tokens.values())) <= longest
        assert abs(blocks[0][s] - used[s] / len(blocks)) <= 2 * longest
    for block in {r.block for r in got}:
        assert sorted(r.slot for r in got if r.block == block) == list(range(1, 1 + sum(r.block == block for r in got)))


def test_buckets_do_not_change_positions(spark, monkeypatch):
    docs = corpus(spark)
    whole = sorted(map(tuple, mix(docs, budget=9000).collect()))
    monkeypatch.setattr("lodestone.llm.mixing.DOCS_A_BUCKET", 1)
    assert sorted(map(tuple, mix(docs, budget=9000).collect())) == whole


def test_empty_table_and_repeated_rows(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    twice = spark.createDataFrame([(1, "a b", None, "s", None)] * 2, DOCS)
    assert mix(twice).count() == 2
