from lodestone.llm.decontam import K, W, contaminated, decontaminate, keep_clean
from tests.llm.util import DOCS, awkward, prose, seeded, table, words


def brute(texts, items, least):
    out, where = set(), {}
    for i, t in items:
        w = words(t or "")
        for q in range(len(w) - least + 1):
            where.setdefault(tuple(w[q : q + least]), []).append((i, q, w))
    for d, t in enumerate(texts):
        w = words(t or "")
        for p in range(len(w) - least + 1):
            for i, q, v in where.get(tuple(w[p : p + least]), ()):
                if p and q and w[p - 1] == v[q - 1]:
                    continue
                n = least
                while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                    n += 1
                out.add((d, i, p, q, n))
    return out


def make(spark):
    rng = seeded(3)
    items = [(i, prose(rng, 25)) for i in range(6)] + [(6, None), (7, ""), (8, "short one"), (9, "na na " * 30)]
    texts = awkward(rng)
    for n in (7, 9, 10, 11, 18, 25):
        part = " ".join(words(items[n % 6][1])[: n])
        texts.append(f"{prose(rng, 12)} {part.upper().replace(' ', ', ')} {prose(rng, 12)}")
    texts += ["na na na " * 40, prose(rng, 20_000) + " " + items[2][1]]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    return texts, items, bench.selectExpr("*", "'x' as h", "'y' as doc_id")


def test_both_ways_against_brute_force(spark):
    texts, items, bench = make(spark)
    docs = table(spark, texts)
    for size in (1 << 20, 0):
        got = decontaminate(docs, bench, broadcast_bytes=size).collect()
        assert {tuple(r) for r in got} == brute(texts, items, K + W - 1) and len(got) == len(set(got))


def test_which_documents_go(spark):
    texts, items, bench = make(spark)
    docs = table(spark, texts)
    gone = {r.doc_id for r in contaminated(decontaminate(docs, bench), bench).collect()}
    assert len(texts) - 1 in gone and not gone & set(range(12))


def test_clean_rows_stay_in_place_or_by_shuffle(spark):
    texts, items, bench = make(spark)
    docs = table(spark, texts)
    gone = {r.doc_id for r in contaminated(decontaminate(docs, bench), bench).collect()}
    for size in (1 << 20, 0):
        kept = keep_clean(docs, bench, broadcast_bytes=size)
        assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - gone
    assert keep_clean(docs, bench.limit(0)).count() == keep_clean(docs, bench.limit(0), broadcast_bytes=-1).count() == len(texts)
    assert keep_clean(docs.limit(0), bench).count() == 0


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], DOCS), make(spark)[2]
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(table(spark, ["a b c"]), bench.limit(0)).count() == 0
    assert decontaminate(table(spark, ["a b c"]), bench.limit(0), broadcast_bytes=-1).count() == 0
