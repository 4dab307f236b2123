"""What larger tables need: bounded memory, work on all cores, nothing made twice."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import vectors
from lodestone.plans import index_queries
from lodestone.plans import queries as base
from lodestone.sources import analyze
from lodestone.sources.mapping import FieldSpec, Mapping
from lodestone.sources.segment import build_segment, open_segment, spread

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_without_collecting_places(spark):
    """A task holds a chunk of text, and nothing is shuffled before tables are sorted."""
    assert "collect_list" not in plan(base.build_texts(spark, DIR).postings)
    assert "field, term" not in plan(base.build_texts(spark, DIR, False).postings).replace("#", " ") and "hashpartitioning" not in plan(base.postings_build(spark, DIR))


def test_text_is_taken_apart_in_chunks(monkeypatch):
    monkeypatch.setattr(analyze, "CHUNK_BYTES", 10)
    kind = pa.list_(pa.struct([("src", pa.string()), ("value", pa.string()), ("array_pos", pa.list_(pa.int64())), ("keyword", pa.bool_())]))
    inst = [[{"src": "t", "value": v, "array_pos": [], "keyword": False}] for v in ("a b a", "b", "c" * 30, "", "a a")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["t"] * 5), pa.array(inst, kind)], names=["doc_num", "field", "inst"])
    made = list(analyze._counts([batch]))
    assert len(made) == 3
    got = {(r["term"], r["doc_num"]): (r["freq"], r["field_len"]) for b in made for r in b.to_pylist()}
    assert got == {("a", 0): (2, 2), ("b", 0): (1, 2), ("b", 1): (1, 1), ("c" * 30, 2): (1, 1), ("", 3): (1, 1), ("a", 4): (2, 1)}


def test_numbers_that_repeat_are_one_document_still(spark, tmp_path):
    m = Mapping("id", (FieldSpec("t", "t"), FieldSpec("l", "l")), {"_all": ()})
    df = spark.createDataFrame([(0, "a b", ["x y", "x"]), (0, "a", ["x"]), (1, "a", [])], "id long, t string, l array<string>").withColumn("doc_num", F.col("id"))
    got = {(r.field, r.term, r.doc_num): (r.freq, len(r.locations)) for r in build_segment(df, m).postings.filter("locations is not null").collect()}
    assert got[("t", "a", 0)] == (2, 2) and got[("l", "x", 0)] == (3, 3) and got[("_all", "a", 1)] == (1, 1)
    once = df.filter("t <> 'a' or id = 1")
    lazy = build_segment(once, m, unique=True)
    stored = open_segment(spark, lazy.persist(f"{tmp_path}/one"))
    every = lambda s: sorted(map(str, s.postings.collect()))
    assert every(lazy) == every(stored) == every(build_segment(once, m)) and "array_pos=[1]" in str(every(stored))


def test_small_files_are_dealt_out(spark):
    """A compressed table of one file is no one task's."""
    rows = spark.range(0, 100_000, 1, 1)
    assert spread(rows).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 1
    assert spread(rows).count() == 100_000


def test_segments_of_a_compaction_read_what_is_theirs(spark):
    """orders are numbered once, not for each segment."""
    s = index_queries.twenty(spark, DIR, 3)
    assert "Window" not in plan(s[1].docs) and "PartitionFilters: [isnotnull(part" in plan(s[1].docs)


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_batch_search_holds_tiles_and_breaks_ties(spark, monkeypatch, metric):
    """many equal vectors come by vec_id, in tiles far smaller than a batch."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 24)).astype(np.float32)[rng.integers(0, 40, 300)]
    df = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "vec_id long, doc_num long, embedding array<float>").repartition(3).cache()
    monkeypatch.setattr(vectors, "TILE", 700)
    got = {}
    for r in vectors.knn_batch(df.select(F.col("vec_id").alias("query_id"), "embedding"), df, 5, metric).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    y = x.astype(float)
    for i in range(300):
        s = sum(((y[i, c] - y[:, c]) ** 2 if metric == "l2" else -y[i, c] * y[:, c] for c in range(24)), np.zeros(300))
        assert [v for _, v in sorted(got[i])] == np.lexsort((np.arange(300), s))[:5].tolist()


def test_no_more_than_a_tile_of_scores_is_made():
    """F1: of 4000 queries and a batch of 10,000 rows, 2^21 scores at once."""
    import tracemalloc

    class Sent:
        rng = np.random.default_rng(0)
        value = (np.arange(4000), rng.normal(size=(4000, 16)).astype(np.float32))

    x = Sent.rng.normal(size=(10_000, 16)).astype(np.float32)
    ids = pa.array(np.arange(10_000))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(list(x))], names=["vec_id", "doc_num", "embedding"])
    tracemalloc.start()
    assert sum(b.num_rows for b in vectors._best_of(Sent, 5, False)([batch])) == 20_000
    assert tracemalloc.get_traced_memory()[1] < 150e6


def test_postings_are_stored_in_blocks_that_hold_a_term_apart(spark, tmp_path, monkeypatch):
    """No row a place is made when an index is written, and a posting is read from its own places."""
    from lodestone.sources.segment import aes_hook, rewrite

    monkeypatch.setattr(analyze, "BLOCK_PLACES", 4)
    far = "x " * 70_000 + "é end end"
    rows = [(0, "a b a", ["x y", "x"]), (1, far, []), (2, "a  a", ["é", None, "q a"]), (3, "a a a a a a a", ["x"] * 9)]
    df = spark.createDataFrame(rows, "id long, t string, l array<string>").withColumn("doc_num", F.col("id"))
    m = Mapping("id", (FieldSpec("t", "t"), FieldSpec("l", "l"), FieldSpec("k", "t", "keyword", term_vectors=False)), {"_all": ("t", "l")})
    want = {}
    for i, t, ls in rows:
        want[("_id", str(i), i)] = None
        want[("k", t, i)] = None
        for name, values in (("t", [(t, [])]), ("l", [(v, [j]) for j, v in enumerate(ls) if v])):
            for v, at in values:
                start = 0
                for pos, word in enumerate(v.split(" "), 1):
                    for f in (name, "_all"):
                        want.setdefault((f, word, i), []).append((name, pos, start, start + len(word.encode()), at))
                    start += len(word.encode()) + 1
    lazy = build_segment(df, m, unique=True)
    one = lazy.persist(f"{tmp_path}/one")
    hook = aes_hook("h", "00" * 16)
    sealed = lazy.persist(f"{tmp_path}/sealed", hook)
    back = rewrite(spark, sealed, f"{tmp_path}/back", {"h": hook})
    for s in (lazy, open_segment(spark, one), open_segment(spark, sealed, {"h": hook}), open_segment(spark, back)):
        got = {(r.field, r.term, r.doc_num): r for r in s.postings.collect()}
        assert got.keys() == want.keys()
        for key, places in want.items():
            assert got[key].freq == len(places or [0])
            assert (got[key].locations is None) if places is None else sorted((x.field, x.pos, x.start, x.end, x.array_pos) for x in got[key].locations) == sorted(places), key[:1]
        assert {(r.field, r.term): (r.df, r.single) for r in s.dictionary.collect()}[("t", "end")] == (1, False)
        if "path" in s.manifest:
            assert spark.read.parquet(f"{s.manifest['path']}/sizes").filter("name = 'postings'").first()["rows"] == len(want)
    blocks = spark.read.parquet(f"{one}/blocks").filter("field = 't' and term = 'a'").collect()
    assert sorted(d for b in blocks for d in b.docs) == [0, 2, 3] and len(blocks) > 1
    look = plan(open_segment(spark, one).postings.filter("field = 't' and term = 'a'").select("doc_num", "freq"))
    assert "EqualTo(term,a)" in look and "named_struct" not in look


def test_no_task_sorts_a_table_to_deal_it_out(spark):
    """Rows go by a hash of their number."""
    assert "RoundRobin" not in plan(spread(spark.range(0, 100_000, 1, 1).withColumn("doc_num", F.col("id"))))


def test_blocks_go_to_ranges_of_measured_size(spark, tmp_path, monkeypatch):
    """No block is shuffled or sorted as a row; files are ranges of (field, term, document), as many as their size
    asks for, not as partitions are set, and a frequent term is in several."""
    import glob

    import pyarrow.parquet as pq

    from lodestone.sources import arrange

    monkeypatch.setattr(arrange, "RANGE_BYTES", 16_000)
    monkeypatch.setattr(analyze, "BLOCK_PLACES", 64)
    df = spark.range(0, 3000, 1, 4).withColumns({"t": F.expr("concat('hot w', id, ' w', id % 97)"), "doc_num": F.col("id")})
    s = build_segment(df, Mapping("id", (FieldSpec("t", "t"),)), unique=True)
    assert "Sort" not in plan(s._arranged())
    path = s.persist(f"{tmp_path}/one")
    files = [pq.read_table(f, columns=["field", "term", "doc_num"]).to_pylist() for f in glob.glob(f"{path}/blocks/*.parquet")]
    keys = sorted([(r["field"], r["term"], r["doc_num"]) for r in f] for f in files if f)
    assert len(keys) > 5 and sum(any(k[1] == "hot" for k in f) for f in keys) > 1
    assert all(f == sorted(f) for f in keys) and all(a[-1] <= b[0] for a, b in zip(keys, keys[1:]))
    got = [(r.field, r.term, r.doc_num, r.freq) for r in open_segment(spark, path).postings.collect()]
    want = {("_id", str(i), i): 1 for i in range(3000)}
    for i in range(3000):
        for w in ("hot", f"w{i}", f"w{i % 97}"):
            want[("t", w, i)] = want.get(("t", w, i), 0) + 1
    assert sorted(got) == sorted((*k, n) for k, n in want.items())


def test_a_range_that_is_larger_than_estimated_is_folded_in_runs(monkeypatch):
    from lodestone.sources import arrange

    monkeypatch.setattr(arrange, "RANGE_BYTES", 300)
    kind = pa.list_(pa.struct([("src", pa.string()), ("value", pa.string()), ("array_pos", pa.list_(pa.int64())), ("keyword", pa.bool_())]))
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array(["t"]), pa.array([True]), pa.array([[{"src": "t", "value": f"b a{i} b", "array_pos": [], "keyword": False}]], kind)], names=list(analyze.BLOCK_INPUT)) for i in range(20)]
    sent = [b for x in batches for b in arrange._dealt(analyze._blocks([x], ("t",)), [("t", "b", False, 0)], 1000)]
    assert {p for b in sent for p in b.column("part").to_pylist()} == {0, 1}
    made = list(arrange._gathered(sent, 1000))
    rows = [(r["term"], d, f, p) for b in made for r in b.to_pylist() for d, f, p in zip(r["docs"], r["freqs"], r["places"])]
    assert len(made) > 3
    assert sorted(rows, key=str) == sorted([("b", i, 2, [1, 0, 3, 4 + len(str(i))]) for i in range(20)] + [(f"a{i}", i, 1, [2, 2]) for i in range(20)], key=str)
