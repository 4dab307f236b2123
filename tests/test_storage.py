"""Writing, opening and merging segments: what must fail does, and what was there stays."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import merge, terms, vector_index, vectors
from lodestone.plans import index_queries
from lodestone.plans import queries as base
from lodestone.sources import segment as storage
from lodestone.sources.mapping import FieldSpec, Mapping
from lodestone.sources.segment import aes_hook, build_segment, open_segment

WORDS = Mapping("id", (FieldSpec("text", "text", stored=True),))
DIR = "/root/testdata/sf0.001"


def small(spark, *texts):
    return build_segment(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").withColumn("doc_num", F.col("id")), WORDS)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    return small(spark, "a b", "b c").persist(str(tmp_path_factory.mktemp("seg") / "one"))


def test_a_failed_overwrite_leaves_what_was_there(spark, written, monkeypatch):
    with pytest.raises(FileExistsError):
        small(spark, "x").persist(written)

    class Failing:
        def __init__(self, fs):
            self.fs, self.moves = fs, 0

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            self.moves += 1
            return False if self.moves == 2 else self.fs.rename(a, b)

    real = storage._filesystem
    monkeypatch.setattr(storage, "_filesystem", lambda s, p: Failing(real(s, p)))
    with pytest.raises(OSError):
        small(spark, "x").persist(written, overwrite=True)
    monkeypatch.undo()
    assert sorted(r.term for r in open_segment(spark, written).dictionary.filter("field = 'text'").collect()) == ["a", "b", "c"]
    assert os.listdir(os.path.dirname(written)) == [os.path.basename(written)]


def test_other_versions_and_unknown_hooks_are_refused(spark, written, tmp_path):
    spark.createDataFrame([("lodestone", 99, 2, "")], "kind string, format int, num_docs long, hook string").write.parquet(f"{tmp_path}/manifest")
    with pytest.raises(ValueError, match="format"):
        open_segment(spark, str(tmp_path))
    hook = aes_hook("mine", "00" * 16)
    path = small(spark, "a b").persist(f"{tmp_path}/sealed", hook)
    with pytest.raises(ValueError, match="unknown hook"):
        open_segment(spark, path)
    s = open_segment(spark, path, {"mine": hook})
    assert "00" * 16 not in s.postings._jdf.queryExecution().toString() and s.postings.count() == 3
    assert "a b" not in str(spark.read.parquet(f"{path}/stored").collect())


def test_a_failing_check_aborts_the_build(spark):
    rows = spark.createDataFrame([(0, None)], "id long, text string").withColumn("doc_num", F.col("id"))
    bad = lambda df: df.withColumn("text", F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.lit("no text"))))
    with pytest.raises(Exception, match="no text"):
        build_segment(rows, WORDS, checks=(bad,)).postings.collect()


def test_merging_nothing_and_cancelling(spark, written):
    with pytest.raises(ValueError):
        merge.merge([])
    asked = []
    with pytest.raises(merge.Cancelled):
        merge.merge([open_segment(spark, written)], cancelled=lambda: asked.append(1) or len(asked) > 2)
    with pytest.raises(KeyError):
        vector_index.trained(open_segment(spark, written), "vec")
    assert vector_index.open_index(open_segment(spark, written), "vec").search([1.0], 3).count() == 0


def test_without_drops_nothing_is_joined(spark, written):
    s = [open_segment(spark, written) for _ in range(3)]
    merged, docmap = merge.merge(s)
    plan = merged.stored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("Join LeftSemi") > 0  # only those with the fields kept
    assert sorted(r.doc_num for r in merged.docs.collect()) == list(range(6)) and docmap.count() == 6


def test_plan_of_a_compaction_grows_with_the_segments_only(spark):
    size = {}
    for n in (2, 6):
        s, _ = merge.compact(index_queries.twenty(spark, DIR, n))
        size[n] = len(s.docs._jdf.queryExecution().logical().toString().split("\n"))
    assert size[6] <= 3.5 * size[2]


def test_lookups_push_filters_and_searches_prune_folders(spark):
    p = terms.postings_list(base.parts(spark, DIR).postings, "name", "small")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(field,name)" in plan and "EqualTo(term,small)" in plan and "locations" not in plan
    index = vector_index.open_index(index_queries._vectors_by_centroid(spark, DIR), "vec")
    own = index.vectors.filter(F.col("centroid").isin(1, 2))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "centroid#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_centroids_in_blocks_assign_alike(spark):
    e = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)] + [(60, None), (61, [1.0])], "vec_id long, embedding array<float>")
    c = spark.createDataFrame([(i, [float(i), float(6 - i)]) for i in range(7)], "centroid long, embedding array<double>")
    whole, blocks = ({r.vec_id: r.centroid for r in vectors.assign(e, c, block_bytes=b).collect()} for b in (1 << 20, 32))
    assert whole == blocks and whole[60] is None and whole[61] is None
    assert all(whole[i] == min(range(7), key=lambda k: ((i % 7 - k) ** 2 + (i % 5 - 6 + k) ** 2, k)) for i in range(60))
