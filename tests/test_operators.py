"""What the queries over the driver's tables don't reach: sizing rules, awkward rows, approximate search."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import sections, terms, vectors
from lodestone.plans import queries
from lodestone.sources.mapping import FieldSpec, Mapping
from lodestone.sources.segment import build_segment


def test_chunk_sizes():
    assert scalars.chunk_size(1024, 5, 9000) == 1024 and scalars.chunk_size(1, 5, 9000) == 1
    assert scalars.chunk_size(1025, 1024, 9000) == 9000 and scalars.chunk_size(1025, 1025, 9000) == 1024
    assert scalars.chunk_size(1026, 1024, 9000) == 9000 and scalars.chunk_size(1026, 5000, 9000) == 9000 // 5
    for mode, docs in ((0, 10), (1027, 10), (1026, 0)):
        with pytest.raises(ValueError):
            scalars.chunk_size(mode, 1, docs)


def test_cluster_counts():
    assert [scalars.nlist(n) for n in (999, 1000, 199_999, 200_000)] == [0, 10, 1999, 1788] and scalars.nlist(5, 7) == 7
    assert scalars.nprobe(100) == 10 and scalars.nprobe(100, True) == 5 and scalars.nprobe(1, True) == 1
    assert scalars.choose_index(999) == "flat" and scalars.choose_index(1000) == "ivf_10_flat" and scalars.choose_index(10_000) == "ivf_100_sq8"
    assert scalars.choose_index(2000, "memory") == "ivf_20_sq4" and scalars.choose_index(5, "binary_sq8") == "binary_sq8"


def test_packed_codes_round_trip(spark):
    rows = [(0, False, 0, 0), (1, True, 5, 2**32 - 1), (2**40, True, 2**31 - 1, 7)]
    df = spark.createDataFrame(rows, "f long, l boolean, hi long, lo long")
    back = df.select(scalars.unpack_freq(scalars.pack_freq(F.col("f"), F.col("l"))).alias("a"), scalars.unpack_pair(scalars.pack_pair(F.col("hi"), F.col("lo"))).alias("b")).collect()
    assert [(r.a.freq, r.a.has_locations, r.b.high, r.b.low) for r in back] == rows


def test_null_empty_and_empty_table(spark):
    m = Mapping("id", (FieldSpec("text", "text"),))
    df = spark.createDataFrame([(0, "a b a"), (1, ""), (2, None), (3, "b")], "id long, text string").withColumn("doc_num", F.col("id"))
    got = {(r.term, r.doc_num): r.freq for r in build_segment(df, m).postings.filter("field = 'text' and term <> ''").collect()}
    assert got == {("a", 0): 2, ("b", 0): 1, ("b", 3): 1}
    assert build_segment(df.limit(0), m).postings.filter("field = 'text'").count() == 0
    assert terms.dictionary(build_segment(df, m).postings, "no such field").count() == 0


def test_sections_are_registered_once():
    assert {"postings", "vectors", "synonyms"} <= sections.REGISTRY.keys()
    with pytest.raises(ValueError):
        sections.register(sections.REGISTRY["postings"])


def test_unknown_kind_and_metric():
    with pytest.raises(ValueError):
        FieldSpec("x", "x", "number")
    with pytest.raises(ValueError):
        scalars.score("manhattan", F.col("a"), F.col("b"))


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(8, 16))[rng.integers(0, 8, 400)] * 3 + rng.normal(size=(400, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "vec_id long, doc_num long, embedding array<float>")
    return x, df


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_batch_search_in_blocks(cloud, metric):
    x, df = cloud
    q = df.filter("vec_id < 40").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in vectors.knn_batch(q, df, 5, metric, block_bytes=2000).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    y = x.astype(float)
    s = ((y[:40, None] - y[None]) ** 2).sum(2) if metric == "l2" else -(y[:40] @ y.T)
    assert {i: [v for _, v in sorted(g)] for i, g in got.items()} == {i: np.lexsort((np.arange(400), np.round(s[i], 9)))[:5].tolist() for i in range(40)}


def test_recall_of_clustered_and_one_bit_search(cloud):
    x, df = cloud
    c = vectors.kmeans_centroids(df, 8)
    a = vectors.assign(df, c).cache()
    found = {"ivf": 0, "bits": 0}
    for i in range(10):
        q, best = x[i].tolist(), set(np.argsort(((x - x[i]) ** 2).sum(1))[:10].tolist())
        found["ivf"] += len(best & {r.vec_id for r in vectors.ivf_search(a, c, q, 10, probes=3).collect()})
        found["bits"] += len(best & {r.vec_id for r in vectors.rabitq_search(a, c, q, 10).collect()})
    assert found["ivf"] >= 90 and found["bits"] >= 90


def test_other_dimensions_and_null_vectors_have_no_hits(cloud, spark):
    _, df = cloud
    assert vectors.scored(df, []).count() == 0 and vectors.scored(df, [1.0]).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (2, 2, [1.0])], "vec_id long, doc_num long, embedding array<float>")
    assert vectors.scored(odd, [1.0]).count() == 1


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_one_bit_search_is_exact_for_every_row_of_the_embeddings(spark, sf):
    assigned, c = queries._clustered(spark, f"/root/testdata/{sf}")
    rows = assigned.select("vec_id", "doc_num", "embedding", "centroid").toArrow()
    centers = {r.centroid: np.array(r.embedding) for r in c.collect()}
    x, ids = np.array(rows["embedding"].to_pylist(), np.float64), rows["vec_id"].to_numpy()
    rot = vectors.random_rotation(x.shape[1])
    for q in x:
        found = pa.Table.from_batches(vectors.one_bit(rot, centers, q, 10)(rows.to_batches(max_chunksize=700)))
        order = np.lexsort((found["vec_id"], np.round(found["score"], 9)))[:10]
        best = np.lexsort((ids, np.round(((x - q) ** 2).sum(1), 9)))[:10]
        assert found["vec_id"].to_numpy()[order].tolist() == ids[best].tolist()
    got = [r.vec_id for r in vectors.rabitq_search(assigned, c, x[7].tolist(), 10).collect()]
    assert got == ids[np.lexsort((ids, np.round(((x - x[7]) ** 2).sum(1), 9)))[:10]].tolist()
