from hypothesis import given
from hypothesis import strategies as st

from lodestone.llm.line_dedup import apply_keep, decode_keep, encode_keep, line_dedup
from tests.llm.util import DOCS, table


@given(st.lists(st.booleans(), max_size=400))
def test_bitmaps_round_trip(keep):
    assert decode_keep(encode_keep(len(keep), [i for i, k in enumerate(keep) if not k])) == keep


def expected(texts):
    seen, out = {}, {}
    for i, t in enumerate(texts):
        if t is not None:
            lines = [x.strip(" \t\r") for x in t.split("\n")]
            out[i] = [x == "" or seen.setdefault(x, (i, p)) == (i, p) for p, x in enumerate(lines)]
    return out


TEXTS = ["a\nb\na\n\n", None, "", "b\n c \r\nd", "c\nhot\nhot", *["hot\nline %d" % (i % 7) for i in range(60)], "é\nÉ", "x" * 300_000 + "\n" + "x" * 300_000, "b"]


def test_against_brute_force(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # a hot line spreads over several
    try:
        got = {r.doc_id: decode_keep(bytes(r.keep)) for r in line_dedup(table(spark, TEXTS)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert got == expected(TEXTS)


def test_texts_after_the_bitmaps(spark):
    docs = table(spark, TEXTS)
    out = {r.doc_id: r for r in apply_keep(docs, line_dedup(docs)).collect()}
    assert out[0].text == "a\nb\n\n" and out[3].text == " c \r\nd" and out[3].n_chars == 6
    assert out[1].text is None and out[2].text == "" and len(TEXTS) - 1 not in out
    assert apply_keep(docs, line_dedup(docs)).columns == docs.columns


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a\na", None, None, None)] * 2 + [(None, "a", None, None, None)], DOCS)
    assert [(r.doc_id, r.n_lines, r.n_kept) for r in line_dedup(docs).collect()] == [(1, 2, 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert line_dedup(docs).count() == 0 and apply_keep(docs, line_dedup(docs)).count() == 0
