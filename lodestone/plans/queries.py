"""Every query of the search index over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import documents, inspect, merge, nested, synonyms, terms, vectors
from lodestone.session import shared_folder
from lodestone.sources.mapping import FieldSpec, Mapping
from lodestone.sources.segment import Builder, Segment, aes_hook, build_segment, dense, is_unique, open_segment, spread
from lodestone.streaming.ingest import compacted, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Segments over the tables

TEXTS = Mapping("doc_id", (FieldSpec("text", "text"), FieldSpec("lang", "lang", "keyword", stored=True, doc_values=True, term_vectors=False), FieldSpec("source", "source", "keyword", stored=True, doc_values=True, term_vectors=False)))
PARTS = Mapping(
    "p_partkey",
    (FieldSpec("name", "p_name", stored=True, doc_values=True), FieldSpec("brand", "p_brand", "keyword", stored=True, doc_values=True), FieldSpec("type", "p_type", "keyword")),
    {"_all": ()},
)
WORDS = Mapping("p_partkey", (FieldSpec("words", "split(p_name, ' ')", "synonym"), FieldSpec("brands", "struct(array(p_brand) as terms, array(p_type) as synonyms)", "synonym")))
ORDERS = Mapping(
    "o_orderkey",
    (FieldSpec("status", "o_orderstatus", "keyword", stored=True, doc_values=True), FieldSpec("priority", "o_orderpriority", stored=True, doc_values=True), FieldSpec("customer", "o_custkey", "keyword")),
)


def build_table(rows, mapping, number: str, locations=True) -> Segment:
    """A segment of a table's rows, on all cores; their numbers are counted for repeats first."""
    rows = spread(rows.withColumn("doc_num", F.col(number)))
    return build_segment(rows, mapping, locations, unique=is_unique(rows))


def build_texts(spark, d, locations=True) -> Segment:
    return build_table(table(spark, d, "documents"), TEXTS, "doc_id", locations)


def build_parts(spark, d, locations=True) -> Segment:
    return build_table(table(spark, d, "part"), PARTS, "p_partkey", locations)


def build_words(spark, d) -> Segment:
    return build_segment(table(spark, d, "part").withColumn("doc_num", F.col("p_partkey")), WORDS)


_INDEXES: dict[tuple, str] = {}


def stored_index(spark, d, name: str, make: Callable[[], Segment]) -> Segment:
    """An index over a table: built and written once for each state of the table and application, then opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, d, make.__name__, status.getModificationTime(), status.getLen())
    if key not in _INDEXES:
        _INDEXES[key] = make().persist(f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return open_segment(spark, _INDEXES[key])


def texts(spark, d) -> Segment:
    def documents_by_term():
        return build_texts(spark, d)

    return stored_index(spark, d, "documents", documents_by_term)


def parts(spark, d) -> Segment:
    def parts_by_term():
        return build_parts(spark, d)

    return stored_index(spark, d, "part", parts_by_term)


def words(spark, d) -> Segment:
    def parts_by_word():
        return build_words(spark, d)

    return stored_index(spark, d, "part", parts_by_word)


def order_segments(spark, d) -> list[Segment]:
    """Orders as three segments by status."""
    o = table(spark, d, "orders")
    return [build_segment(dense(o.filter(F.col("o_orderstatus") == s), ["o_orderstatus"], "o_orderkey", "doc_num"), ORDERS, False) for s in "FOP"]


def order_drops(segments) -> list[DataFrame | None]:
    """Nothing of the first segment, urgent orders of the second, all of the third."""
    urgent = terms.postings_list(segments[1].postings, "priority", "1-URGENT").select("doc_num")
    return [None, urgent, segments[2].docs.select("doc_num")]


def embeddings(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("doc_num"), "embedding", "label")


def many_vectors(spark, d) -> DataFrame:
    """Twenty documents with many vectors each."""
    return embeddings(spark, d).withColumn("doc_num", F.col("vec_id") % 20)


def asked(spark, d, vec_id=7) -> list[float]:
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def tree(spark, d) -> DataFrame:
    """Customers, their orders and those orders' items, flattened in preorder."""
    c = table(spark, d, "customer").select(F.array(F.col("c_custkey")).alias("path"), F.lit("customer").alias("kind"))
    o = table(spark, d, "orders").select(F.array("o_custkey", "o_orderkey").alias("path"), F.lit("order").alias("kind"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = lines.select(F.array(F.col("o_custkey"), F.col("l_orderkey"), F.col("l_linenumber").cast("long")).alias("path"), F.lit("item").alias("kind"))
    return nested.flatten(c.unionByName(o).unionByName(n.distinct()))


def talks(spark, d) -> DataFrame:
    """Conversations with their turns below them."""
    t = table(spark, d, "conversations")
    return nested.flatten(t.select(F.array("conv_id").alias("path")).distinct().unionByName(t.select(F.array("conv_id", "turn").alias("path")).distinct()))


# SQL pieces

TOK = "(SELECT doc_id AS doc_num, unnest(string_split(text, ' ')) AS term, len(list_distinct(string_split(text, ' '))) AS field_len FROM documents)"
NAMES = "(SELECT p_partkey AS doc_num, unnest(string_split(p_name, ' ')) AS term FROM part)"
ALL = "(SELECT p_partkey AS doc_num, unnest(string_split(p_name, ' ') || [p_brand, p_type]) AS term, len(list_distinct(string_split(p_name, ' '))) + 2 AS field_len FROM part)"
NORM = "CAST(CAST(1 / sqrt(field_len) AS FLOAT) AS DOUBLE)"
ORD = """s AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS segment,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS old FROM orders),
m AS (SELECT *, CASE WHEN kept THEN row_number() OVER (PARTITION BY kept ORDER BY segment, old) - 1 END AS new
  FROM (SELECT *, segment = 0 OR (segment = 1 AND o_orderpriority <> '1-URGENT') AS kept FROM s))"""
TREE = """p AS (SELECT c_custkey AS a, CAST(-1 AS BIGINT) AS b, CAST(-1 AS BIGINT) AS c, 'customer' AS kind FROM customer
  UNION ALL SELECT o_custkey, o_orderkey, -1, 'order' FROM orders
  UNION ALL SELECT DISTINCT o_custkey, l_orderkey, l_linenumber, 'item' FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT *, row_number() OVER (ORDER BY a, b, c) - 1 AS doc_num FROM p),
t AS (SELECT x.*, r.doc_num AS root_num, CASE WHEN x.kind = 'order' THEN r.doc_num WHEN x.kind = 'item' THEN o.doc_num END AS parent
  FROM n x JOIN n r ON r.a = x.a AND r.kind = 'customer' LEFT JOIN n o ON o.a = x.a AND o.b = x.b AND o.kind = 'order')"""


def sql_l2(a: str, b: str) -> str:
    diff = "(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))"
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {diff} * {diff}))"


def sql_ip(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def sql_hits(score: str = "l2", where: str = "true", doc: str = "vec_id", vec: int = 7) -> str:
    f = sql_l2 if score == "l2" else sql_ip
    return f"q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = {vec}), h AS (SELECT vec_id, {doc} AS doc_num, {f('embedding', 'e')} AS score FROM embeddings, q WHERE {where})"


def sql_raw(k: int, asc: str = "ASC") -> str:
    best = "min" if asc == "ASC" else "max"
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY score {asc}, vec_id) AS rn FROM h),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_num ORDER BY rn) = 1 AS INTEGER) AS is_first FROM r),
c AS (SELECT *, sum(is_first) OVER (ORDER BY rn) AS docs FROM f),
m AS (SELECT ceil(min(rn) FILTER (docs >= {k}) / {k}.0) AS rounds FROM c)
SELECT doc_num, round({best}(score), 6) AS score FROM c, m WHERE rounds IS NULL OR rn <= rounds * {k} GROUP BY doc_num"""


def rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


CENTERS = "m AS (SELECT CAST(label AS BIGINT) AS centroid, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) AS g(i) GROUP BY ALL), ce AS (SELECT centroid, list(x ORDER BY i) AS center FROM m GROUP BY centroid)"
ASSIGNED = CENTERS + f", d AS (SELECT vec_id, embedding, centroid, row_number() OVER (PARTITION BY vec_id ORDER BY {sql_l2('embedding', 'center')}, centroid) AS n FROM embeddings, ce), a AS (SELECT vec_id, embedding, centroid FROM d WHERE n = 1)"
PLAN = f"""q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7),
cnt AS (SELECT centroid, count(*) AS n FROM a WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY centroid),
o AS (SELECT centroid, distance, n, row_number() OVER w AS place, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT ce.centroid, {sql_l2('center', 'e')} AS distance, n FROM ce JOIN cnt USING (centroid), q) WINDOW w AS (ORDER BY distance, centroid)),
pl AS (SELECT * FROM o WHERE before < 40 OR place <= 3)"""


# Dictionary


@query(f"SELECT doc_num, count(*) AS freq, {NORM} AS norm FROM {TOK} WHERE term = 'the' GROUP BY doc_num, field_len")
def term_lookup(spark, d):
    return terms.postings_list(texts(spark, d).postings, "text", "the")


@query(f"SELECT doc_num, count(*) AS freq, {NORM} AS norm FROM {TOK} WHERE term = 'the' AND doc_num NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY doc_num, field_len")
def term_lookup_except(spark, d):
    bad = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("doc_num"))
    return terms.postings_list(texts(spark, d).postings, "text", "the", exclude=bad)


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT doc_num FROM {TOK} WHERE term = 'the' AND doc_num NOT IN (SELECT doc_id FROM labels WHERE quality = 0))")
def posting_count_except(spark, d):
    bad = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("doc_num"))
    return terms.postings_list(texts(spark, d).postings, "text", "the", bad, freq=False, norms=False).agg(F.count("*").alias("n"))


@query(f"SELECT term, count(DISTINCT doc_num) AS df FROM {TOK} GROUP BY term")
def dict_enumerate(spark, d):
    return terms.dictionary(texts(spark, d).dictionary, "text")


@query(f"SELECT term, count(DISTINCT doc_num) AS df FROM {TOK} WHERE starts_with(term, 'th') GROUP BY term")
def dict_prefix(spark, d):
    return terms.dictionary(texts(spark, d).dictionary, "text", prefix="th")


@query(f"SELECT term, count(DISTINCT doc_num) AS df FROM {TOK} WHERE term >= 'on' AND term < 're' GROUP BY term")
def dict_range(spark, d):
    return terms.dictionary(texts(spark, d).dictionary, "text", "on", "re")


@query(f"SELECT term, count(DISTINCT doc_num) AS df FROM {TOK} WHERE term >= 'é' GROUP BY term")
def dict_range_open(spark, d):
    return terms.dictionary(texts(spark, d).dictionary, "text", "é")


def _fuzzy(n):
    return f"SELECT term, count(DISTINCT doc_num) AS df, CAST(levenshtein(term, 'ring') AS INTEGER) AS distance FROM {NAMES} WHERE levenshtein(term, 'ring') <= {n} GROUP BY term"


@query(_fuzzy(1))
def dict_fuzzy1(spark, d):
    return terms.dictionary(parts(spark, d).dictionary, "name", fuzzy=("ring", 1))


@query(_fuzzy(2))
def dict_fuzzy2(spark, d):
    return terms.dictionary(parts(spark, d).dictionary, "name", fuzzy=("ring", 2))


@query(_fuzzy(3))
def dict_fuzzy3(spark, d):
    return terms.dictionary(parts(spark, d).dictionary, "name", fuzzy=("ring", 3))


@query(f"SELECT term, count(DISTINCT doc_num) AS df FROM {TOK} WHERE regexp_full_match(term, '[a-m]+(ing|tion)') AND term >= 'b' GROUP BY term")
def dict_regex(spark, d):
    return terms.dictionary(texts(spark, d).dictionary, "text", start="b", regex="[a-m]+(ing|tion)")


@query(f"SELECT 'text' AS field, count(DISTINCT term) AS n_terms FROM {TOK} UNION ALL SELECT 'lang', count(DISTINCT lang) FROM documents UNION ALL SELECT 'source', count(DISTINCT source) FROM documents UNION ALL SELECT '_id', count(*) FROM documents")
def dict_cardinality(spark, d):
    return terms.cardinality(texts(spark, d).dictionary)


@query(f"SELECT term, count(DISTINCT doc_num) AS df FROM {TOK} WHERE term IN ('the', 'und', 'que') GROUP BY term")
def term_df(spark, d):
    return terms.dictionary(texts(spark, d).dictionary, "text", predicate=F.col("term").isin("the", "und", "que"))


@query(f"SELECT t AS term, t IN (SELECT term FROM {TOK}) AS present FROM (VALUES ('the'), ('no such term'), ('und')) v(t)")
def term_contains(spark, d):
    return terms.contains(texts(spark, d).postings, "text", ["the", "no such term", "und"])


@query("SELECT field, term, CAST(source AS INTEGER) AS source, df FROM (SELECT 'type' AS field, p_type AS term, 0 AS source, count(*) AS df FROM part WHERE p_size <= 25 GROUP BY p_type UNION ALL SELECT 'type', p_type, 1, count(*) FROM part WHERE p_size > 25 GROUP BY p_type)")
def dict_merge_ordered(spark, d):
    p = table(spark, d, "part").withColumn("doc_num", F.col("p_partkey"))
    only = Mapping("p_partkey", (FieldSpec("type", "p_type", "keyword"),))
    halves = [build_segment(p.filter(c), only, False).postings.filter("field = 'type'") for c in ("p_size <= 25", "p_size > 25")]
    return terms.merged_terms(*halves).orderBy("field", "term", "source")


# Postings


@query("""WITH s AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM s),
p AS (SELECT doc_id AS doc_num, w[pos] AS term, pos, sum(strlen(w[pos]) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - strlen(w[pos]) - 1 AS start FROM t)
SELECT doc_num, pos, CAST(start AS BIGINT) AS start, CAST(start + strlen(term) AS BIGINT) AS "end" FROM p WHERE term = 'und'""")
def postings_locations(spark, d):
    p = terms.postings_list(texts(spark, d).postings, "text", "und", freq=False, norms=False, locations=True)
    return p.select("doc_num", F.explode("locations").alias("l")).select("doc_num", "l.pos", "l.start", "l.end")


@query(f"SELECT doc_num, count(*) AS freq FROM {TOK} WHERE term = 'of' AND doc_num >= 100 GROUP BY doc_num")
def postings_advance(spark, d):
    return terms.advance(terms.postings_list(texts(spark, d).postings, "text", "of", norms=False), 100)


@query(f"SELECT min(doc_num) AS doc_num FROM {TOK} WHERE term = 'of' AND doc_num >= 100")
def postings_next(spark, d):
    return terms.next_at_or_after(terms.postings_list(texts(spark, d).postings, "text", "of", freq=False, norms=False), 100)


@query(f"SELECT DISTINCT doc_num FROM {TOK} WHERE term IN ('und', 'que')")
def postings_union(spark, d):
    p = texts(spark, d).postings
    return terms.union(terms.postings_list(p, "text", "und"), terms.postings_list(p, "text", "que"))


@query(f"SELECT DISTINCT doc_num FROM {TOK} WHERE term = 'in' AND doc_num NOT IN (SELECT doc_num FROM {TOK} WHERE term = 'the')")
def postings_difference(spark, d):
    p = texts(spark, d).postings
    return terms.difference(terms.postings_list(p, "text", "in", freq=False, norms=False), terms.postings_list(p, "text", "the"))


@query(f"SELECT count(*) AS n FROM (SELECT doc_num FROM {TOK} WHERE term = 'in' INTERSECT SELECT doc_num FROM {TOK} WHERE term = 'the')")
def postings_and_count(spark, d):
    p = texts(spark, d).postings
    return terms.intersection_count(terms.postings_list(p, "text", "in"), terms.postings_list(p, "text", "the"))


@query("WITH t AS (SELECT p_partkey AS doc_num, 'name' AS loc_field, unnest(string_split(p_name, ' ')) AS term FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part) SELECT doc_num, term, loc_field, count(*) AS n FROM t GROUP BY ALL")
def composite_all(spark, d):
    p = parts(spark, d).postings.filter("field = '_all'").select("doc_num", "term", F.explode("locations").alias("l"))
    return p.groupBy("doc_num", "term", F.col("l.field").alias("loc_field")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_num, any_value({NORM}) AS norm FROM {ALL} GROUP BY doc_num")
def norms(spark, d):
    return parts(spark, d).postings.filter("field = '_all'").groupBy("doc_num").agg(F.max(scalars.norm(F.col("field_len"))).alias("norm"))


@query(f"SELECT term, doc_num, count(*) AS freq FROM {TOK} GROUP BY term, doc_num")
def postings_build(spark, d):
    return build_texts(spark, d, False).postings.filter("field = 'text'").select("term", "doc_num", "freq")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS doc_num FROM orders WHERE o_orderpriority = '1-URGENT'")
def doc_numbers(spark, d):
    o = table(spark, d, "orders")
    s = build_segment(o.withColumn("doc_num", F.col("o_orderkey")), ORDERS, False)
    ids = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("id")).union(s.spark.createDataFrame([("~beyond",)], "id string"))
    return terms.doc_numbers(s.postings, ids)


# Documents


@query("SELECT doc_id AS doc_num, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def doc_id(spark, d):
    return documents.doc_id(texts(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("doc_num")))


@query("SELECT p_partkey AS doc_num, '_id' AS field, CAST(0 AS INTEGER) AS seq, 't' AS typ, CAST(p_partkey AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'name', 0, 't', p_name FROM part UNION ALL SELECT p_partkey, 'brand', 0, 't', p_brand FROM part")
def stored_fields(spark, d):
    return documents.stored_fields(parts(spark, d)).select("doc_num", "field", "seq", "typ", F.col("value").cast("string").alias("value"))


@query("SELECT c_custkey AS doc_num, 'words' AS field, CAST(i - 1 AS BIGINT) AS position, w[i] AS value FROM (SELECT c_custkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT c_custkey, string_split(c_name, '#') AS w FROM customer))")
def stored_array_positions(spark, d):
    m = Mapping("c_custkey", (FieldSpec("words", "split(c_name, '#')", "keyword", stored=True),))
    s = documents.stored_fields(build_segment(table(spark, d, "customer").withColumn("doc_num", F.col("c_custkey")), m), fields=["words"])
    return s.select("doc_num", "field", F.element_at("array_pos", 1).alias("position"), F.col("value").cast("string").alias("value"))


@query("SELECT DISTINCT p_partkey AS doc_num, 'name' AS field, unnest(string_split(p_name, ' ')) AS term FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part")
def doc_values(spark, d):
    return documents.doc_values(parts(spark, d), ["name", "brand", "unknown"])


@query("SELECT 'name' AS field UNION ALL SELECT 'brand'")
def doc_value_fields(spark, d):
    return documents.doc_value_fields(parts(spark, d))


@query("SELECT f AS field, CAST(i AS INTEGER) AS field_id FROM (VALUES ('_id', 0), ('_all', 1), ('brand', 2), ('name', 3), ('type', 4)) v(f, i)")
def field_names(spark, d):
    return documents.field_names(parts(spark, d))


def _two_metas(spark, d):
    p = table(spark, d, "part").withColumn("doc_num", F.col("p_partkey"))
    a = Mapping("p_partkey", (FieldSpec("name", "p_name", stored=True), FieldSpec("brand", "p_brand", "keyword", doc_values=True)))
    b = Mapping("p_partkey", (FieldSpec("name", "p_name", doc_values=True, stored=True), FieldSpec("type", "p_type", "keyword")))
    return Builder(p, a).fields_meta(), Builder(p, b).fields_meta()


@query("SELECT * FROM (VALUES ('_id', true, true, false, false), ('name', true, true, true, true), ('brand', true, false, true, true), ('type', true, false, false, true)) v(field, indexed, stored, doc_values, term_vectors)")
def field_options_or(spark, d):
    return documents.options_or(*_two_metas(spark, d))


@query("SELECT * FROM (VALUES ('_id', true, true, false, false, false), ('name', true, true, false, true, true), ('brand', true, false, true, true, false), ('type', true, false, false, true, false)) v(field, indexed, stored, doc_values, term_vectors, differs)")
def field_options_and(spark, d):
    return documents.options_and(*_two_metas(spark, d))


# Merge


@query(f"WITH {ORD} SELECT count(*) AS n FROM m WHERE kept")
def merge_counts(spark, d):
    s = order_segments(spark, d)
    return documents.count(merge.merge(s, order_drops(s))[0])


@query(f"WITH {ORD} SELECT CAST(segment AS INTEGER) AS segment, old, new FROM m")
def merge_docmap(spark, d):
    s = order_segments(spark, d)
    return merge.doc_map(s, order_drops(s))


@query(f"WITH {ORD} SELECT 'customer' AS field, CAST(o_custkey AS VARCHAR) AS term, new AS doc_num, CAST(1 AS BIGINT) AS freq FROM m WHERE kept UNION ALL SELECT 'status', o_orderstatus, new, 1 FROM m WHERE kept UNION ALL SELECT '_id', CAST(o_orderkey AS VARCHAR), new, 1 FROM m WHERE kept UNION ALL SELECT 'priority', t, new, count(*) FROM (SELECT unnest(string_split(o_orderpriority, ' ')) AS t, new FROM m WHERE kept) GROUP BY t, new")
def merge_postings(spark, d):
    s = order_segments(spark, d)
    return merge.merge(s, order_drops(s))[0].postings.select("field", "term", "doc_num", "freq")


@query(f"WITH {ORD} SELECT new AS doc_num, 'status' AS field, o_orderstatus AS term FROM m WHERE kept UNION ALL SELECT DISTINCT new, 'priority', unnest(string_split(o_orderpriority, ' ')) FROM m WHERE kept")
def merge_doc_values(spark, d):
    s = order_segments(spark, d)
    return documents.doc_values(merge.merge(s, order_drops(s))[0], ["status", "priority"])


@query(f"WITH {ORD} SELECT new AS doc_num, '_id' AS field, CAST(o_orderkey AS VARCHAR) AS value FROM m WHERE kept UNION ALL SELECT new, 'status', o_orderstatus FROM m WHERE kept UNION ALL SELECT new, 'priority', o_orderpriority FROM m WHERE kept")
def merge_stored(spark, d):
    s = order_segments(spark, d)
    return merge.merge(s, order_drops(s))[0].stored.select("doc_num", "field", F.col("value").cast("string").alias("value"))


@query("WITH v AS (SELECT o_orderkey AS id, o_orderstatus AS status, 0 AS seg FROM orders UNION ALL SELECT o_orderkey, 'X', 1 FROM orders WHERE o_orderpriority = '2-HIGH'), l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seg DESC) AS n FROM v) SELECT CAST(id AS VARCHAR) AS id, status FROM l WHERE n = 1")
def merge_updates(spark, d):
    o = table(spark, d, "orders")
    newer = dense(o.filter("o_orderpriority = '2-HIGH'").withColumn("o_orderstatus", F.lit("X")), ["o_orderstatus"], "o_orderkey", "doc_num")
    s, _ = merge.compact([build_segment(o.withColumn("doc_num", F.col("o_orderkey")), ORDERS, False), build_segment(newer, ORDERS, False)])
    return s.docs.join(s.stored.filter("field = 'status'"), "doc_num").select("id", F.col("value").cast("string").alias("status"))


@query(f"WITH {ORD} SELECT new AS doc_num, '_id' AS field, CAST(o_orderkey AS VARCHAR) AS value FROM m WHERE kept UNION ALL SELECT new, 'priority', o_orderpriority FROM m WHERE kept")
def merge_deleted_field(spark, d):
    """The fields behind a deleted one stay."""
    s = order_segments(spark, d)
    gone = spark.createDataFrame([("status", True, False, False, False), ("customer", False, True, False, False)], "field string, deleted boolean, no_index boolean, no_store boolean, no_doc_values boolean")
    return merge.merge(s, order_drops(s), gone)[0].stored.select("doc_num", "field", F.col("value").cast("string").alias("value"))


@query("SELECT CAST(0 AS BIGINT) AS n")
def merge_self_invariant(spark, d):
    """Postings that a segment and its merge with nothing don't share."""
    s = parts(spark, d)
    a, b = (x.postings.select("field", "term", "doc_num", "freq", "field_len") for x in (s, merge.merge([s])[0]))
    return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count("*").alias("n"))


# Trees


@query(f"WITH {TREE} SELECT doc_num, kind, parent, root_num FROM t")
def nested_flatten(spark, d):
    return tree(spark, d).select("doc_num", "kind", "parent", "root_num")


@query(f"WITH {TREE} SELECT doc_num, CAST(0 AS INTEGER) AS depth, doc_num AS ancestor FROM t UNION ALL SELECT doc_num, 1, parent FROM t WHERE parent IS NOT NULL UNION ALL SELECT doc_num, 2, root_num FROM t WHERE kind = 'item'")
def nested_ancestors(spark, d):
    return nested.ancestors_by_path(tree(spark, d))


@query("WITH p AS (SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS turn FROM conversations UNION SELECT conv_id, turn FROM conversations), n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc_num FROM p) SELECT doc_num, CAST(0 AS INTEGER) AS depth, doc_num AS ancestor FROM n UNION ALL SELECT a.doc_num, 1, b.doc_num FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.turn >= 0 AND b.turn < 0")
def nested_ancestors_recursive(spark, d):
    n = talks(spark, d)
    return nested.ancestors(n, n.filter("parent is not null").select(F.col("doc_num").alias("child"), "parent"))


@query(f"WITH {TREE} SELECT root_num, doc_num FROM t WHERE parent IS NOT NULL")
def nested_descendants(spark, d):
    return nested.descendants(tree(spark, d))


@query(f"WITH {TREE} SELECT root_num, min(doc_num) + 1 AS first, max(doc_num) AS last FROM t GROUP BY root_num")
def nested_root_ranges(spark, d):
    return nested.root_ranges(tree(spark, d))


@query(f"WITH {TREE} SELECT count(*) AS n FROM t JOIN customer ON a = c_custkey WHERE kind = 'customer' AND c_mktsegment <> 'MACHINERY'")
def nested_count_root(spark, d):
    t = tree(spark, d)
    gone = t.join(table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'"), F.element_at("path", 1) == F.col("c_custkey"), "left_semi").select("doc_num")
    return nested.root_count(t, gone)


@query(f"WITH {TREE} SELECT doc_num FROM t JOIN customer ON a = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def nested_cascade_delete(spark, d):
    t = tree(spark, d)
    roots = t.filter("kind = 'customer'").join(table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'"), F.element_at("path", 1) == F.col("c_custkey"), "left_semi")
    return nested.cascade(t, roots.select("doc_num"))


@query("WITH p AS (SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS turn, '' AS role FROM conversations UNION SELECT conv_id, turn, role FROM conversations), n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS old FROM p), k AS (SELECT *, row_number() OVER (ORDER BY old) - 1 AS new FROM n WHERE turn <> 0) SELECT c.new AS child, r.new AS parent FROM k c JOIN k r ON c.conv_id = r.conv_id AND c.turn > 0 AND r.turn < 0")
def nested_merge_edges(spark, d):
    """First turns are dropped; edges of the others are renumbered."""
    n = talks(spark, d)
    s = Segment(spark, {"docs": n.select("doc_num", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("id"), "parent")})
    return merge.merge([s], [n.filter(F.get("path", F.lit(1)) == 0).select("doc_num")])[0].edges


# Vectors


@query(f"WITH {sql_hits()}, {sql_raw(10)}")
def knn_l2_raw(spark, d):
    return rounded(vectors.knn_raw(vectors.scored(embeddings(spark, d), asked(spark, d)), 10))


@query(f"WITH {sql_hits()} SELECT doc_num, round(score, 6) AS score FROM h ORDER BY h.score, doc_num LIMIT 10")
def knn_l2_topk(spark, d):
    return rounded(vectors.knn_topk(vectors.scored(embeddings(spark, d), asked(spark, d)), 10))


@query(f"WITH {sql_hits('ip')} SELECT doc_num, round(score, 6) AS score FROM h ORDER BY h.score DESC, doc_num LIMIT 10")
def knn_ip(spark, d):
    return rounded(vectors.knn_topk(vectors.scored(embeddings(spark, d), asked(spark, d), "ip"), 10, "ip"))


@query(f"WITH {sql_hits('ip', vec=3)}, {sql_raw(5, 'DESC')}")
def knn_cosine(spark, d):
    return rounded(vectors.knn_raw(vectors.scored(embeddings(spark, d), asked(spark, d, 3), "cosine"), 5, "cosine"))


@query(f"WITH {sql_hits(where='vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)')} SELECT doc_num, round(score, 6) AS score FROM h ORDER BY h.score, doc_num LIMIT 10")
def knn_exclude(spark, d):
    e = embeddings(spark, d)
    return rounded(vectors.knn_topk(vectors.scored(e, asked(spark, d), exclude=e.filter("label = 3")), 10))


@query(f"WITH {sql_hits(where='vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)')} SELECT doc_num, round(score, 6) AS score FROM h ORDER BY h.score, doc_num LIMIT 10")
def knn_filter(spark, d):
    return rounded(vectors.knn_topk(vectors.scored(embeddings(spark, d), asked(spark, d), eligible=_good(spark, d)), 10))


@query(f"WITH {sql_hits(doc='vec_id % 20')}, {sql_raw(10)}")
def knn_multivector(spark, d):
    return rounded(vectors.knn_raw(vectors.scored(many_vectors(spark, d), asked(spark, d)), 10))


@query(f"WITH {sql_hits(doc='vec_id % 20')} SELECT doc_num // 5 AS root_num, round(min(score), 6) AS score FROM h GROUP BY ALL")
def knn_nested_root(spark, d):
    v = many_vectors(spark, d)
    nodes = v.select("doc_num").distinct().withColumn("root_num", F.expr("doc_num div 5"))
    return rounded(vectors.roll_up(vectors.scored(v, asked(spark, d)), nodes))


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {sql_ip('a.embedding', 'b.embedding')} AS score FROM embeddings a, embeddings b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_batch(spark, d):
    e = embeddings(spark, d)
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(vectors.knn_batch(q, spread(e), 5, "ip")).select("query_id", "vec_id", "score", "rank")


@query("SELECT vec_id, vec_id AS doc_num, CAST(0 AS DOUBLE) AS score FROM embeddings WHERE false")
def knn_dim_mismatch(spark, d):
    return vectors.nearest_vectors(vectors.scored(embeddings(spark, d), asked(spark, d)[:-1]), 10)


@query(f"WITH {sql_hits()} SELECT vec_id, doc_num, round(score, 6) AS score FROM h ORDER BY h.score, vec_id LIMIT 20")
def knn_vectors(spark, d):
    return rounded(vectors.nearest_vectors(vectors.scored(embeddings(spark, d), asked(spark, d)), 20))


def _good(spark, d):
    return table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("doc_num"))


def _clustered(spark, d):
    e = embeddings(spark, d).drop("label")
    c = vectors.mean_centroids(embeddings(spark, d), "label")
    return vectors.assign(e, c), c


@query(f"WITH {ASSIGNED} SELECT vec_id, centroid FROM a")
def ivf_assign(spark, d):
    return _clustered(spark, d)[0].select("vec_id", "centroid")


@query(f"WITH {ASSIGNED} SELECT centroid, count(*) AS n FROM a GROUP BY centroid ORDER BY n DESC, centroid LIMIT 5")
def ivf_centroid_cardinality(spark, d):
    return vectors.centroid_cardinalities(_clustered(spark, d)[0], 5)


@query(f"WITH {ASSIGNED} SELECT centroid, count(*) AS n FROM a WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY centroid")
def ivf_eligible_counts(spark, d):
    a, _ = _clustered(spark, d)
    return vectors.eligible_counts(a, _good(spark, d))


@query(f"WITH {ASSIGNED}, {PLAN} SELECT centroid, round(distance, 6) AS distance, n, CAST(place AS INTEGER) AS place FROM pl")
def ivf_probe_plan(spark, d):
    a, c = _clustered(spark, d)
    return vectors.probe_plan(a, c, asked(spark, d), 40, _good(spark, d)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {ASSIGNED}, {PLAN} SELECT vec_id, vec_id AS doc_num, round({sql_l2('embedding', 'e')}, 6) AS score FROM a JOIN pl USING (centroid), q WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY {sql_l2('embedding', 'e')}, vec_id LIMIT 40")
def ivf_search(spark, d):
    a, c = _clustered(spark, d)
    return rounded(vectors.ivf_search(a, c, asked(spark, d), 40, _good(spark, d)))


@query(f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), h AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, e), lambda z: CAST((z[1] > 0) <> (z[2] > 0) AS INTEGER))) AS hamming, {sql_l2('embedding', 'e')} AS score FROM embeddings, q), c AS (SELECT * FROM h ORDER BY hamming, vec_id LIMIT 40) SELECT vec_id, vec_id AS doc_num, CAST(hamming AS INTEGER) AS hamming, round(score, 6) AS score FROM c ORDER BY c.score, vec_id LIMIT 10")
def binary_hamming_rerank(spark, d):
    return rounded(vectors.binary_search(embeddings(spark, d), asked(spark, d), 10))


@query("WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS g(i)), b AS (SELECT i, min(x) AS lo, (max(x) - min(x)) / 255 AS step FROM x GROUP BY i) SELECT vec_id, CAST(sum(CAST(floor((x - lo) / step + 0.5) AS INTEGER)) AS BIGINT) AS code_sum, max(abs(x - (lo + floor((x - lo) / step + 0.5) * step))) <= (SELECT max(step) FROM b) / 2 + 1e-9 AS within FROM x JOIN b USING (i) GROUP BY vec_id")
def sq8_roundtrip(spark, d):
    e = embeddings(spark, d)
    t = vectors.train_sq(e)
    r = vectors.sq_decode(vectors.sq_encode(e, t), t).crossJoin(t.select(F.array_max("steps").alias("step")))
    worst = F.aggregate(F.zip_with("embedding", "restored", lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return r.select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda a, b: a + b).alias("code_sum"), (worst <= F.col("step") / 2 + 1e-9).alias("within"))


@query("SELECT 'vec' AS field, count(*) AS n_vectors, count(DISTINCT vec_id % 20) AS n_docs, CAST(64 AS INTEGER) AS dim FROM embeddings")
def vector_stats(spark, d):
    return vectors.stats(many_vectors(spark, d).withColumn("field", F.lit("vec")))


@query()
def kmeans_train(spark, d):
    e = embeddings(spark, d)
    n = e.count()
    c = vectors.kmeans_centroids(e, max(2, scalars.nlist(n) or 5))
    return vectors.centroid_cardinalities(vectors.assign(e, c))


@query()
def rabitq_search(spark, d):
    a, c = _clustered(spark, d)
    return rounded(vectors.rabitq_search(a, c, asked(spark, d), 10))


# Synonyms

PAIRS = "(SELECT DISTINCT p_partkey AS doc_num, a AS term, b AS synonym FROM (SELECT p_partkey, w, unnest(w) AS a FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)), unnest(w) AS u(b) WHERE a <> b)"


@query(f"SELECT synonym, doc_num FROM {PAIRS} WHERE term = 'small'")
def synonyms_lookup(spark, d):
    return synonyms.lookup(words(spark, d).synonyms, "words", "small")


@query(f"SELECT synonym, doc_num FROM {PAIRS} WHERE term = 'small' AND doc_num NOT IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def synonyms_except(spark, d):
    gone = table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("doc_num"))
    return synonyms.lookup(words(spark, d).synonyms, "words", "small", gone)


@query("SELECT DISTINCT p_brand AS term FROM part WHERE p_brand >= 'Brand#2'")
def synonyms_enumerate(spark, d):
    return synonyms.terms(words(spark, d).synonyms, "brands", start="Brand#2")


@query("SELECT DISTINCT p_brand AS term, p_type AS synonym FROM part")
def synonyms_one_way(spark, d):
    return words(spark, d).synonyms.filter("thesaurus = 'brands'").select("term", "synonym").distinct()


@query("WITH s AS (SELECT p_brand, p_type, p_size > 25 AS late, row_number() OVER (PARTITION BY p_size > 25 ORDER BY p_partkey) - 1 AS old FROM part) SELECT p_brand AS term, p_type AS synonym, CASE WHEN late THEN old + (SELECT count(*) FROM part WHERE p_size <= 25) ELSE old END AS doc_num FROM s")
def synonyms_merge(spark, d):
    p = table(spark, d, "part").withColumn("late", F.col("p_size") > 25)
    s = [build_segment(dense(p.filter(c), ["late"], "p_partkey", "doc_num"), WORDS) for c in ("not late", "late")]
    return merge.merge(s)[0].synonyms.filter("thesaurus = 'brands'").select("term", "synonym", "doc_num")


# Inspection, storage, streaming


@query(f"SELECT term, count(*) AS cardinality, count(*) = 1 AND max(freq) = 1 AS single FROM (SELECT term, doc_num, count(*) AS freq FROM {TOK} GROUP BY ALL) GROUP BY term")
def inspect_dict(spark, d):
    return inspect.dictionary(texts(spark, d), "text")


@query("SELECT * FROM (VALUES ('_id', CAST(0 AS INTEGER), true, false, false), ('_all', 1, true, false, false), ('brand', 2, true, false, false), ('name', 3, true, false, false), ('type', 4, true, false, false)) v(field, field_id, has_text, has_vector, has_synonym)")
def inspect_fields(spark, d):
    return inspect.fields(parts(spark, d))


@query("SELECT a.term, count(DISTINCT synonym) AS n_synonyms, count(DISTINCT doc_num) AS n_docs FROM " + PAIRS + " a GROUP BY a.term")
def inspect_thesaurus(spark, d):
    return inspect.thesaurus(words(spark, d), "words")


@query("SELECT count(*) AS n_docs, CAST(sum(len(list_distinct(string_split(p_name, ' ')))) AS BIGINT) AS n_terms FROM part")
def inspect_docvalue(spark, d):
    return inspect.docvalue(parts(spark, d), "name")


@query("SELECT p_partkey AS doc_num, p_name AS value FROM part")
def encrypted_roundtrip(spark, d):
    """Stored values encrypted on disk, read back through the hook."""
    hook = aes_hook("demo", "000102030405060708090a0b0c0d0e0f")
    path = build_parts(spark, d).persist(f"{shared_folder(spark)}/encrypted-{uuid.uuid4().hex}", hook)
    s = open_segment(spark, path, {"demo": hook})
    return documents.stored_fields(s, fields=["name"]).select("doc_num", F.col("value").cast("string").alias("value"))


@query(f"SELECT doc_num, count(*) AS freq, {NORM} AS norm FROM (SELECT p_partkey AS doc_num, unnest(string_split(p_name, ' ')) AS term, len(list_distinct(string_split(p_name, ' '))) AS field_len FROM part) WHERE term = 'small' GROUP BY doc_num, field_len")
def persisted_lookup(spark, d):
    """A term of a segment that was written and opened again."""
    return terms.postings_list(parts(spark, d).postings, "name", "small")


@query("SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_ingest_compact(spark, d):
    """Events as a stream of segments keyed by user; the newest event of each user stays."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, d, "events").withColumn("version", F.struct("ts", "event_id")).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    m = Mapping("user_id", (FieldSpec("event_type", "event_type", "keyword", stored=True),))
    ingest(spark.readStream.schema(schema).parquet(f"{base}/in"), m, f"{base}/index", f"{base}/state", "version").awaitTermination()
    s = compacted(spark, f"{base}/index")
    return s.docs.join(s.stored.filter("field = 'event_type'"), "doc_num").select("id", F.col("value").cast("string").alias("event_type"))
