import os

import duckdb
import pytest

from lodestone.llm.textkit import checkpoint_dir
from tests.llm import test_decontam, test_line_dedup, test_near_dup
from tests.llm.util import awkward, prose, seeded, table

pipeline = pytest.importorskip("corpus_pipeline") if __import__("importlib").util.find_spec("corpus_pipeline") else pytest.skip("no pipeline", allow_module_level=True)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = seeded(21)
    items = [(i, prose(rng, 30)) for i in range(4)]
    texts = awkward(rng)
    base = prose(rng, 200)
    texts += [base, test_near_dup.edited(rng, base, 6), f"{prose(rng, 40)} {items[1][1]}", "same line\n" + prose(rng, 9), "same line\n" + prose(rng, 9), "12 34 !!"]
    out = str(tmp_path_factory.mktemp("tables"))
    table(spark, texts).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, texts, items


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_follow_their_brute_force_versions(spark, folder):
    out, texts, items = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language ID", "line dedup", "near dedup", "decontamination", "mixing"]
    stages, columns = [f for _, f in pipeline.STAGES], docs.columns

    now = stages[0](spark, docs, out)
    assert now.columns == columns and set(rows(now)) == {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}

    before = rows(now)
    now = stages[1](spark, now, out)
    order = sorted(before)
    keep = test_line_dedup.expected([before[i] for i in order])
    expected = {i: "\n".join(x for x, k in zip(before[i].split("\n"), keep[n]) if k) for n, i in enumerate(order)}
    assert now.columns == columns and rows(now) == {i: t for i, t in expected.items() if t == before[i] or t.strip()}

    before = rows(now)
    now = stages[2](spark, now, out)
    order = sorted(before)
    groups = test_near_dup.groups([before[i] for i in order])[1]
    assert now.columns == columns and set(rows(now)) == {i for n, i in enumerate(order) if groups.get(n, n) == n}

    before = rows(now)
    now = stages[3](spark, now, out)
    order = sorted(before)
    hits = test_decontam.brute([before[i] for i in order], items, 10)
    assert now.columns == columns and set(rows(now)) == set(before) - {order[d] for d, *_, n in hits if n >= 13}

    from lodestone.llm.mixing import mix_sql

    con = duckdb.connect()
    con.register("documents", now.select("doc_id", "text", "source").toArrow())
    expected = sorted(con.execute(mix_sql()).fetchall())
    assert sorted(tuple(r) for r in stages[4](spark, now, out).collect()) == expected
    assert sorted(tuple(r) for r in pipeline.run(spark, out).collect()) == expected
    assert not [x for x in os.listdir(checkpoint_dir(spark).removeprefix("file://")) if x.startswith("pipeline-")]  # deleted


def test_language_stage_decides_row_by_row(spark, folder):
    """A clean row without an id stays, and a row without letters goes though an accepted one has its id."""
    rng = seeded(3)
    kept = [(i, prose(rng, 30), "en", "s", 1) for i in range(6)] + [(None, prose(rng, 30), "en", "s", 1)]
    docs = spark.createDataFrame([*kept, (2, "12 34 !!", "en", "s", 1), (2, None, "en", "s", 1), (None, "...", "en", "s", 1)], test_near_dup.DOCS)
    got = pipeline.STAGES[0][1](spark, docs, folder[0])
    assert got.schema == docs.schema and sorted(map(str, got.collect())) == sorted(str(r) for r in docs.collect()[: len(kept)])


def test_awkward_tables_pass_all_stages(spark, tmp_path):
    """No rows, no benchmark, null ids, ids that clash, repeated rows: nothing crashes, and clean rows stay."""
    rng = seeded(9)
    columns = test_near_dup.DOCS
    clean = [(i, prose(rng, 40), "en", "s", 1) for i in range(8)]
    odd = [(None, prose(rng, 40), "en", None, 1), (3, prose(rng, 40), "en", "s", 1), clean[5], (None, None, None, None, None), (9, "", "en", "s", 0)]
    items = [(0, prose(rng, 30)), (0, prose(rng, 50)), (None, prose(rng, 20)), (1, None)]
    dirty = [(10, f"{prose(rng, 20)} {items[1][1]}", "en", "s", 1), (None, f"{items[0][1]} {prose(rng, 20)}", "en", "s", 1)]
    for name, docs, bench in (("none", [], []), ("both", clean + odd + dirty, items)):
        d = str(tmp_path / name)
        spark.createDataFrame(docs, columns).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = sorted(r.doc_id for r in pipeline.run(spark, d).collect())
        assert got == sorted([r[0] for r in clean + odd[1:3] if docs])
        now = spark.read.parquet(f"{d}/documents.parquet")
        for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
            stage(spark, now, d).write.parquet(f"{d}/{k}")
            now = spark.read.parquet(f"{d}/{k}")
        assert sorted(map(str, now.collect())) == sorted(map(str, spark.createDataFrame((clean + odd[:3]) if docs else [], columns).collect()))
