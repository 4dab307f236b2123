"""Queries over stored indexes: vector indexes, inspection, hooks, merges of many segments; each with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import documents, inspect, merge, sections, synonyms, terms, vector_index, vectors
from lodestone.plans.queries import (
    ASSIGNED, CENTERS, ORDERS, PAIRS, _clustered, _good, asked, build_parts, build_words, embeddings, many_vectors, parts, query, rounded, sql_hits, sql_ip, sql_l2, sql_raw, stored_index, table, texts, words,
)
from lodestone.session import shared_folder
from lodestone.sources.mapping import FieldSpec, Mapping
from lodestone.sources.segment import Segment, aes_hook, build_segment, dense, open_segment, rewrite

VECTORS = Mapping("vec_id", (FieldSpec("vec", "embedding", "vector"),))


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def centers(spark, d):
    return vectors.mean_centroids(embeddings(spark, d), "label")


# Vector indexes

PLACED = """n AS (SELECT count(DISTINCT centroid) AS total FROM ce), q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7),
el AS (SELECT vec_id, doc, embedding, centroid FROM (SELECT vec_id, vec_id % 20 AS doc, embedding, centroid FROM a) WHERE {where}),
cnt AS (SELECT centroid, count(*) AS n FROM el GROUP BY centroid),
o AS (SELECT *, row_number() OVER w AS place, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT ce.centroid, {distance} AS distance, n FROM ce JOIN cnt USING (centroid), q) WINDOW w AS (ORDER BY distance, centroid)),
f AS (SELECT count(*) FILTER (before < {k} OR place <= {probes}) AS probes, count(*) AS total FROM o),
l AS (SELECT list({{'v': vec_id, 'd': doc, 's': score, 'p': place}} ORDER BY {order}) AS l FROM (
  SELECT vec_id, doc, {score} AS score, {h} AS h, place FROM el JOIN o USING (centroid), q))"""
ROUNDS = """, r(it, probes, seen, docs, more) AS (SELECT 0, probes, CAST([] AS BIGINT[]), 0, true FROM f UNION ALL
  SELECT it + 1, CASE WHEN {grow} AND it + 1 >= 2 THEN least(total, probes + greatest((total - probes) // 2, 1)) ELSE probes END, seen2,
    len(list_distinct(list_transform(list_filter(l, lambda x: list_contains(seen2, x.v)), lambda x: x.d))),
    len(got) = {k} AND it < 99 AND len(list_distinct(list_transform(list_filter(l, lambda x: list_contains(seen2, x.v)), lambda x: x.d))) < {k}
  FROM (SELECT it, probes, total, l, list_filter(l, lambda x: x.p <= probes AND NOT list_contains(seen, x.v))[1:{k}] AS got,
    list_concat(seen, list_transform(list_filter(l, lambda x: x.p <= probes AND NOT list_contains(seen, x.v))[1:{k}], lambda x: x.v)) AS seen2 FROM r,
    (SELECT total FROM f), l WHERE more)),
e AS (SELECT unnest(list_filter(l, lambda x: list_contains(seen, x.v))) AS x FROM l, (SELECT seen FROM r ORDER BY it DESC LIMIT 1))
SELECT CAST(x.d AS BIGINT) AS doc_num, round(min(x.s), 6) AS score FROM e GROUP BY x.d"""


def _rounds(k, probes, where="true", grow=True, assigned=ASSIGNED, distance=None, score=None, h="0", order="score, vec_id"):
    placed = PLACED.format(where=where, k=k, probes=probes, distance=distance or sql_l2("center", "e"), score=score or sql_l2("embedding", "e"), h=h, order=order)
    return f"WITH RECURSIVE {assigned}, {placed}{ROUNDS.format(k=k, grow=str(grow).lower())}"


def _index(spark, d, optimise="recall", docs=20):
    v = embeddings(spark, d).withColumn("doc_num", F.col("vec_id") % docs)
    return vector_index.build(v, "vec", optimise, template=centers(spark, d), clusters=10)


@query(_rounds(12, 1, "doc < 15"))
def ivf_doc_search(spark, d):
    """Twelve of fifteen documents with many vectors each: rounds visit more clusters until they are found."""
    e = spark.range(15).select(F.col("id").alias("doc_num"))
    index = _flat(_index(spark, d))
    return rounded(index.search(asked(spark, d), 12, eligible=e, probes=1))


def _flat(index):
    """The same clusters with plain vectors, whatever the size of the table chose."""
    index.kind = "ivf_10_flat"
    return index


@query(_rounds(10, 3, grow=False))
def ivf_doc_search_all(spark, d):
    return rounded(_flat(_index(spark, d)).search(asked(spark, d), 10, probes=3))


SIGNS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST((z[1] > 0) <> (z[2] > 0) AS INTEGER)))"
BY_SIGN = CENTERS + f", d AS (SELECT vec_id, embedding, centroid, row_number() OVER (PARTITION BY vec_id ORDER BY {SIGNS.format(a='embedding', b='center')}, centroid) AS n FROM embeddings, ce), a AS (SELECT vec_id, embedding, centroid FROM d WHERE n = 1)"


@query(_rounds(8, 3, grow=False, assigned=BY_SIGN, distance=SIGNS.format(a="center", b="e"), h=SIGNS.format(a="embedding", b="e"), order="h, vec_id"))
def binary_ivf_search(spark, d):
    """Clusters by sign bits; within them the least Hamming distances, scored exactly."""
    return rounded(_index(spark, d, "binary_flat").search(asked(spark, d), 8, probes=3))


SQ = """x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS g(i)), b AS (SELECT i, min(x) AS lo, (max(x) - min(x)) / 255 AS step FROM x GROUP BY i),
y AS (SELECT vec_id, i, lo + floor((x - lo) / step + 0.5) * step AS y FROM x JOIN b USING (i)), e AS (SELECT i, x FROM x WHERE vec_id = 7)"""


@query(f"WITH {SQ} SELECT vec_id AS doc_num, round(sum((y - x) * (y - x)), 5) AS score FROM y JOIN e USING (i) GROUP BY vec_id ORDER BY sum((y - x) * (y - x)), vec_id LIMIT 10")
def sq8_search(spark, d):
    """Scores of what codes of eight bits restore, over all clusters."""
    index = _index(spark, d, docs=1 << 40)
    index.bounds = vectors.train_sq(index.vectors)
    index.vectors, index.kind = vectors.sq_encode(index.vectors, index.bounds), "ivf_10_sq8"
    return index.search(asked(spark, d), 10, probes=10).withColumn("score", F.round("score", 5))


def _vectors_by_centroid(spark, d):
    def vectors_by_centroid():
        rows = embeddings(spark, d).withColumn("doc_num", F.col("vec_id"))
        return vector_index.index_segment(build_segment(rows, VECTORS), VECTORS, {"vec": centers(spark, d)}, 10)

    return stored_index(spark, d, "embeddings", vectors_by_centroid)


@query(f"WITH {sql_hits()}, {sql_raw(10)}")
def persisted_vectors(spark, d):
    """Written with centroids and codes, opened, and searched over all clusters."""
    index = vector_index.open_index(_vectors_by_centroid(spark, d), "vec")
    return rounded(index.search(asked(spark, d), 10, probes=10))


@query(f"WITH {CENTERS} SELECT centroid, round(list_sum(center), 6) AS total FROM ce")
def trained_index(spark, d):
    return vector_index.trained(_vectors_by_centroid(spark, d), "vec").select("centroid", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {ASSIGNED} SELECT vec_id AS doc_num, centroid FROM a")
def merge_vectors_template(spark, d):
    """Two segments trained alike keep their centroids when merged; every vector lies with its nearest one."""
    rows, t = embeddings(spark, d), {"vec": centers(spark, d)}
    n = rows.count() // 2
    halves = [rows.filter(F.col("vec_id") < n).withColumn("doc_num", F.col("vec_id")), rows.filter(F.col("vec_id") >= n).withColumn("doc_num", F.col("vec_id") - n)]
    s = [vector_index.index_segment(build_segment(h, VECTORS), VECTORS, t, 10) for h in halves]
    return vector_index.merge_indexes(s, merge.merge(s)[0], VECTORS, False).vectors.select("doc_num", "centroid")


@query("WITH o AS (SELECT *, vec_id < (SELECT count(*) // 2 FROM embeddings) AS early FROM embeddings), k AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY early DESC, vec_id) - 1 AS doc_num FROM o WHERE NOT (early AND vec_id % 3 = 0)) SELECT doc_num, doc_num << 20 AS vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM k")
def merge_vectors(spark, d):
    """A third of the first segment is dropped; vectors follow their documents, and ids are made anew."""
    rows = embeddings(spark, d)
    n = rows.count() // 2
    s = [build_segment(rows.filter(F.col("vec_id") < n).withColumn("doc_num", F.col("vec_id")), VECTORS), build_segment(rows.filter(F.col("vec_id") >= n).withColumn("doc_num", F.col("vec_id") - n), VECTORS)]
    return merge.merge(s, [s[0].docs.filter("doc_num % 3 = 0").select("doc_num"), None])[0].vectors.select("doc_num", "vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query(f"WITH {sql_hits()} SELECT count(*) AS n FROM (SELECT doc_num FROM h WHERE score < 2) WHERE doc_num NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def vector_count_except(spark, d):
    hits = vectors.scored(embeddings(spark, d), asked(spark, d)).filter("score < 2")
    return vectors.count_hits(hits, _good(spark, d))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings WHERE vec_id IN (3, 7, 11)")
def reconstruct(spark, d):
    got = vector_index.open_index(_vectors_by_centroid(spark, d), "vec").reconstruct([3 << 20, 7 << 20, 11 << 20])
    return got.select(F.shiftright("vec_id", 20).alias("vec_id"), F.round(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {sql_hits()} SELECT doc_num, round(score, 6) AS score FROM h ORDER BY h.score, doc_num LIMIT 10")
def knn_all_eligible(spark, d):
    """All documents eligible: as without a filter. Hits come by document number."""
    e = embeddings(spark, d)
    return rounded(vectors.by_number(vectors.knn_topk(vectors.scored(e, asked(spark, d), eligible=e.select("doc_num")), 10)))


@query(f"WITH {sql_hits(where='vec_id % 2 = 0 AND vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)')} SELECT doc_num, round(score, 6) AS score FROM h ORDER BY h.score, doc_num LIMIT 10")
def knn_filter_and_exclude(spark, d):
    e = embeddings(spark, d)
    return rounded(vectors.knn_topk(vectors.scored(e, asked(spark, d), exclude=_good(spark, d), eligible=e.filter("vec_id % 2 = 0").select("doc_num")), 10))


@query("""SELECT n, CAST(CASE WHEN n >= 200000 THEN floor(4 * sqrt(n)) WHEN n >= 1000 THEN n // 100 ELSE 0 END AS BIGINT) AS clusters,
  CASE WHEN n < 1000 THEN 'flat' WHEN n < 10000 THEN 'flat' ELSE 'sq8' END AS coding, CAST(floor(sqrt(CASE WHEN n >= 200000 THEN floor(4 * sqrt(n)) WHEN n >= 1000 THEN n // 100 ELSE 0 END)) AS BIGINT) AS probes
  FROM (VALUES (1), (999), (1000), (9999), (10000), (199999), (200000), (1000000), (10000000)) v(n)""")
def vector_sizing(spark, d):
    rows = [(n, scalars.nlist(n), scalars.choose_index(n).split("_")[-1], scalars.nprobe(scalars.nlist(n))) for n in (1, 999, 1000, 9999, 10000, 199999, 200000, 1000000, 10000000)]
    return spark.createDataFrame(rows, "n int, clusters long, coding string, probes long")


# Packed codes

@query("SELECT l_orderkey, l_linenumber, (CAST(l_quantity AS BIGINT) << 1) | CAST(l_returnflag = 'R' AS BIGINT) AS freq_code, (l_partkey << 32) | l_suppkey AS pair_code, CASE WHEN l_partkey < 2147483648 THEN (CAST(l_linenumber AS BIGINT) << 31) | l_partkey END AS hit_code FROM lineitem")
def packed_codes(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", scalars.pack_freq(F.col("l_quantity").cast("long"), F.col("l_returnflag") == "R").alias("freq_code"), scalars.pack_pair(F.col("l_partkey"), F.col("l_suppkey")).alias("pair_code"), scalars.pack_hit(F.col("l_partkey"), F.col("l_linenumber")).alias("hit_code"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS freq, l_returnflag = 'R' AS located, l_partkey AS high, l_suppkey AS low FROM lineitem")
def unpacked_codes(spark, d):
    li = table(spark, d, "lineitem")
    f = scalars.unpack_freq(scalars.pack_freq(F.col("l_quantity").cast("long"), F.col("l_returnflag") == "R"))
    p = scalars.unpack_pair(scalars.pack_pair(F.col("l_partkey"), F.col("l_suppkey")))
    return li.select("l_orderkey", "l_linenumber", f["freq"].alias("freq"), f["has_locations"].alias("located"), p["high"].alias("high"), p["low"].alias("low"))


@query("SELECT mode, cardinality, CAST(CASE mode WHEN 1025 THEN CASE WHEN cardinality <= 1024 THEN 90000 ELSE 1024 END WHEN 1026 THEN CASE WHEN cardinality <= 1024 THEN 90000 ELSE 90000 // (cardinality // 1024 + 1) END ELSE mode END AS INTEGER) AS size FROM (VALUES (1), (1024), (1025), (1026)) m(mode), (VALUES (5), (1024), (1025), (5000), (80000)) c(cardinality)")
def chunk_sizes(spark, d):
    rows = [(m, c, scalars.chunk_size(m, c, 90000)) for m in (1, 1024, 1025, 1026) for c in (5, 1024, 1025, 5000, 80000)]
    return spark.createDataFrame(rows, "mode int, cardinality int, size int")


# Inspection

@query("SELECT p_partkey AS doc_num, count(*) AS freq, CAST(count(*) AS INTEGER) AS places, CAST(min(pos) AS BIGINT) AS pos FROM (SELECT p_partkey, w[i] AS term, i AS pos FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)) WHERE term = 'small' GROUP BY p_partkey")
def inspect_term(spark, d):
    return inspect.term(parts(spark, d), "name", "small").select("doc_num", "freq", F.size("locations").alias("places"), F.array_min(F.transform("locations", lambda x: x["pos"])).alias("pos"))


@query("SELECT field, CAST(0 AS INTEGER) AS seq, value FROM (SELECT '_id' AS field, CAST(p_partkey AS VARCHAR) AS value FROM part WHERE p_partkey = 7 UNION ALL SELECT 'name', p_name FROM part WHERE p_partkey = 7 UNION ALL SELECT 'brand', p_brand FROM part WHERE p_partkey = 7)")
def inspect_stored(spark, d):
    return inspect.stored(parts(spark, d), 7).select("field", "seq", F.col("value").cast("string").alias("value"))


TALKS = "p AS (SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS turn FROM conversations UNION SELECT conv_id, turn FROM conversations), n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc_num FROM p)"


def nested_talks(spark, d):
    """Conversations and their turns, flattened by the builder."""
    t = table(spark, d, "conversations")
    rows = t.select(F.array("conv_id").alias("keys")).distinct().unionByName(t.select(F.array("conv_id", "turn").alias("keys")).distinct())
    m = Mapping("array_join(transform(keys, x -> cast(x as string)), '/')", (FieldSpec("kind", "if(size(keys) = 1, 'conversation', 'turn')", "keyword", doc_values=True),), path_expr="keys")
    return build_segment(rows, m, False)


@query(f"WITH {TALKS} SELECT c.doc_num AS child, r.doc_num AS parent FROM n c JOIN n r ON c.conv_id = r.conv_id AND c.turn >= 0 AND r.turn < 0")
def inspect_edges(spark, d):
    return inspect.edges(nested_talks(spark, d))


@query(f"WITH {TALKS} SELECT doc_num, CASE WHEN turn < 0 THEN 'conversation' ELSE 'turn' END AS term FROM n")
def nested_builder(spark, d):
    return documents.doc_values(nested_talks(spark, d), ["kind"]).select("doc_num", "term")


@query("SELECT 'lodestone' AS kind, CAST(1 AS INTEGER) AS format, count(*) AS num_docs, CAST(NULL AS VARCHAR) AS hook FROM part")
def inspect_footer(spark, d):
    return inspect.footer(parts(spark, d)).drop("path")


@query("SELECT 'docs' AS name, count(*) AS rows, true AS written FROM part UNION ALL SELECT 'doc_values', 2 * count(*), true FROM part UNION ALL SELECT 'stored', 3 * count(*), true FROM part UNION ALL SELECT 'fields_meta', 5, true")
def inspect_sizes(spark, d):
    """Rows of each table as written; bytes depend on the writer."""
    s = inspect.sizes(parts(spark, d)).filter("name in ('docs', 'doc_values', 'stored', 'fields_meta')")
    return s.select("name", "rows", (F.col("bytes") > 0).alias("written"))


@query("SELECT 2 * count(*) AS rows, true AS equal FROM part")
def checksum_roundtrip(spark, d):
    """The checksum of doc values is the same before and after storage."""
    a, b = (inspect.checksum(s, "doc_values") for s in (build_parts(spark, d), parts(spark, d)))
    return a.crossJoin(b.select(F.col("crc").alias("other"))).select("rows", (F.col("crc") == F.col("other")).alias("equal"))


@query("SELECT vec_id << 20 AS vec_id, vec_id AS doc_num FROM embeddings")
def inspect_vector(spark, d):
    return inspect.vector(_vectors_by_centroid(spark, d), "vec")


# Documents and synonyms

@query("SELECT p_partkey AS doc_num, term, count(*) AS freq FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part UNION ALL SELECT p_partkey, unnest(string_split(p_type, ' ')) FROM part) GROUP BY ALL")
def repeated_fields(spark, d):
    """Two fields of one name are one field with the options of both."""
    m = Mapping("p_partkey", (FieldSpec("words", "p_name"), FieldSpec("words", "p_type", stored=True)))
    s = build_segment(table(spark, d, "part").withColumn("doc_num", F.col("p_partkey")), m)
    return s.postings.filter("field = 'words'").select("doc_num", "term", "freq")


@query("WITH t AS (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) || [p_type] AS v FROM part) SELECT p_partkey AS doc_num, 'name' AS field, CAST(i - 1 AS INTEGER) AS ord, v[i] AS value FROM (SELECT p_partkey, v, unnest(range(1, len(v) + 1)) AS i FROM t)")
def doc_value_extras(spark, d):
    """Terms in dictionary order, then the bytes that the mapping adds."""
    m = Mapping("p_partkey", (FieldSpec("name", "p_name", doc_values=True, extra="encode(p_type, 'UTF-8')"),))
    s = build_segment(table(spark, d, "part").withColumn("doc_num", F.col("p_partkey")), m, False)
    return documents.visit_doc_values(s, ["name"]).select("doc_num", "field", "ord", F.col("value").cast("string").alias("value"))


@query("SELECT p_partkey AS doc_num, p_name AS value FROM part WHERE p_size IS NOT NULL AND p_name <> ''")
def validated_build(spark, d):
    """A check that every row passes; one that fails aborts the build."""
    check = lambda rows: rows.withColumn("p_size", F.when(F.col("p_size") > 0, F.col("p_size")).otherwise(F.raise_error(F.lit("no size")).cast("int")))
    m = Mapping("p_partkey", (FieldSpec("name", "if(p_size > 0, p_name, null)", "keyword", stored=True),))
    s = build_segment(table(spark, d, "part").withColumn("doc_num", F.col("p_partkey")), m, False, (check,))
    return documents.stored_fields(s, fields=["name"]).select("doc_num", F.col("value").cast("string").alias("value"))


@query(f"SELECT synonym, doc_num FROM {PAIRS} WHERE term = 'small'")
def persisted_synonyms(spark, d):
    return synonyms.lookup(words(spark, d).synonyms, "words", "small")


@query("SELECT DISTINCT p_brand AS term FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3]\\d?')")
def synonyms_regex(spark, d):
    return synonyms.terms(words(spark, d).synonyms, "brands", regex=r"Brand#[1-3]\d?")


@query("SELECT DISTINCT p_brand AS term FROM part WHERE levenshtein(p_brand, 'Brand#11') <= 1")
def synonyms_fuzzy(spark, d):
    return synonyms.terms(words(spark, d).synonyms, "brands", fuzzy=("Brand#11", 1))


@query("SELECT t AS term, t IN (SELECT p_brand FROM part) AS present FROM (VALUES ('Brand#11'), ('Brand#99')) v(t)")
def synonyms_contains(spark, d):
    s = words(spark, d).synonyms
    return spark.createDataFrame([(t, synonyms.contains(s, "brands", t)) for t in ("Brand#11", "Brand#99")], "term string, present boolean")


# Storage and merge

def _sealed(spark, d):
    hook = aes_hook("demo", "000102030405060708090a0b0c0d0e0f")
    return build_parts(spark, d).persist(fresh(spark, "sealed"), hook), hook


@query("SELECT p_partkey AS doc_num, count(*) AS freq FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) WHERE term = 'small' GROUP BY p_partkey")
def encrypted_lookup(spark, d):
    """Postings, too, are sealed on disk and read back through the hook."""
    path, hook = _sealed(spark, d)
    return terms.postings_list(open_segment(spark, path, {"demo": hook}).postings, "name", "small", norms=False)


@query("SELECT DISTINCT p_partkey AS doc_num, 'name' AS field, unnest(string_split(p_name, ' ')) AS term FROM part")
def rewrite_segment(spark, d):
    """Written again without the hook, then opened without one."""
    path, hook = _sealed(spark, d)
    plain = rewrite(spark, path, fresh(spark, "plain"), {"demo": hook})
    return documents.doc_values(open_segment(spark, plain), ["name"])


@query(f"SELECT DISTINCT term, synonym FROM {PAIRS}")
def encrypted_synonyms(spark, d):
    hook = aes_hook("demo", "000102030405060708090a0b0c0d0e0f")
    path = build_words(spark, d).persist(fresh(spark, "sealed"), hook)
    return open_segment(spark, path, {"demo": hook}).synonyms.filter("thesaurus = 'words'").select("term", "synonym").distinct()


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS doc_num, 'status' AS field, o_orderstatus AS term FROM orders")
def merge_empty(spark, d):
    """Empty segments before, between and after add nothing."""
    o = table(spark, d, "orders").withColumn("one", F.lit(1))
    full, none = (build_segment(dense(x, ["one"], "o_orderkey", "doc_num"), ORDERS, False) for x in (o, o.limit(0)))
    return documents.doc_values(merge.merge([none, full, none, Segment(spark, {})])[0], ["status"])


@query("""WITH v AS (SELECT o_orderkey AS id, o_orderkey % 20 AS seg, o_orderstatus AS status FROM orders UNION ALL SELECT o_orderkey, 19, 'U' FROM orders WHERE o_orderkey % 20 < 19 AND o_orderkey % 7 = 0),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seg DESC) AS n FROM v) SELECT CAST(id AS VARCHAR) AS id, status FROM l WHERE n = 1""")
def compact_many(spark, d):
    s, _ = merge.compact(twenty(spark, d))
    return s.docs.join(s.stored.filter("field = 'status'"), "doc_num").select("id", F.col("value").cast("string").alias("status"))


def twenty(spark, d, n=20):
    """Orders as twenty segments, the last of which also has newer versions of every seventh order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").withColumn("part", F.col("o_orderkey") % 20)
    newer = o.filter("part < 19 and o_orderkey % 7 = 0").withColumns({"part": F.lit(19).cast("long"), "o_orderstatus": F.lit("U")})
    path, rows = fresh(spark, "twenty"), dense(o.unionByName(newer), ["part"], "o_orderkey", "doc_num")
    rows.write.partitionBy("part").parquet(path)  # numbered once; a segment reads its own folder
    rows = spark.read.schema(rows.schema).parquet(path)
    m = Mapping("o_orderkey", (FieldSpec("status", "o_orderstatus", "keyword", stored=True),))
    return [build_segment(rows.filter(F.col("part") == i), m, False, unique=True) for i in range(n)]


@query("SELECT doc_num, field, CASE field WHEN '_id' THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority END AS value FROM (SELECT *, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS doc_num FROM orders), (VALUES ('_id'), ('priority')) f(field)")
def merge_stored_updates(spark, d):
    """Updates that segments carry are united: one tells not to store a field, another, of the same, not to index it."""
    o = table(spark, d, "orders").withColumn("one", F.lit(1))
    s = build_segment(dense(o, ["one"], "o_orderkey", "doc_num"), ORDERS, False)
    told = "field string, deleted boolean, no_index boolean, no_store boolean, no_doc_values boolean"
    s = s.replace(updates=spark.createDataFrame([("status", False, False, True, False), ("status", False, True, False, None)], told))
    got = merge.merge([s])[0]
    kept = got.fields_meta.filter("field = 'status' and not stored and not indexed").select(F.lit(1).alias("ok"))
    return got.stored.crossJoin(F.broadcast(kept)).select("doc_num", "field", F.col("value").cast("string").alias("value"))  # one row


class Lengths(sections.IndexSection):
    """An own section: characters of each document's fields of kind ``measured``."""

    name, schema, claims = "lengths", "doc_num long, field string, length long", ("measured",)

    def build(self, builder):
        parts_ = [builder.source.select("doc_num", F.lit(f.name).alias("field"), F.length(F.expr(f.expr)).cast("long").alias("length")) for f in builder.mapping.of("measured")]
        return parts_[0] if parts_ else None


@query("SELECT row_number() OVER (ORDER BY late, p_partkey) - 1 AS doc_num, 'size' AS field, length(p_name) AS length FROM (SELECT *, p_size > 25 AS late FROM part)")
def section_plugin(spark, d):
    """A section that is registered from outside is built, written, opened and merged like the others."""
    sections.register(Lengths())
    try:
        p = table(spark, d, "part").withColumn("late", F.col("p_size") > 25)
        m = Mapping("p_partkey", (FieldSpec("size", "p_name", "measured"),))
        made = [build_segment(dense(p.filter(c), ["late"], "p_partkey", "doc_num"), m, False).persist(fresh(spark, "own")) for c in ("not late", "late")]
        return merge.merge([open_segment(spark, x) for x in made])[0].table("lengths")
    finally:
        sections.unregister("lengths")
