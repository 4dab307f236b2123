"""Views over a segment, as the inspection commands show them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import documents, synonyms
from lodestone.operators.terms import postings_list
from lodestone.sources.segment import Segment


def footer(s: Segment) -> DataFrame:
    """One row: format, number of documents, hook, path."""
    m = s.manifest
    return s.spark.createDataFrame([(m.get("kind"), m.get("format"), m.get("num_docs"), m.get("hook") or None, m.get("path"))], "kind string, format int, num_docs long, hook string, path string")


def sizes(s: Segment) -> DataFrame:
    """(name, rows, bytes) of each table as it was written."""
    return s.spark.read.parquet(f"{s.manifest['path']}/sizes")


def checksum(s: Segment, name: str) -> DataFrame:
    """(rows, crc): CRC-32 of each row of a table, combined whatever their order; equal before and after storage."""
    t = s.table(name)
    row = F.to_json(F.struct(*sorted(t.columns))).cast("binary")
    return t.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.crc32(row)), F.lit(0)).alias("crc"))


def fields(s: Segment) -> DataFrame:
    """(field, field_id, has_text, has_vector, has_synonym)"""
    text = s.table("dictionary").select("field").distinct().withColumn("has_text", F.lit(True))
    vec = s.vectors.select("field").distinct().withColumn("has_vector", F.lit(True))
    syn = s.synonyms.select(F.col("thesaurus").alias("field")).distinct().withColumn("has_synonym", F.lit(True))
    both = documents.field_names(s).join(text, "field", "full").join(vec, "field", "full").join(syn, "field", "full")
    return both.fillna(False, ["has_text", "has_vector", "has_synonym"])


def dictionary(s: Segment, field: str) -> DataFrame:
    """(term, cardinality, single): single marks terms of one document with frequency 1."""
    return s.table("dictionary").filter(F.col("field") == field).select("term", F.col("df").alias("cardinality"), "single")


def term(s: Segment, field: str, word: str) -> DataFrame:
    return postings_list(s.postings, field, word, locations=True)


def docvalue(s: Segment, field: str, doc_num: int | None = None) -> DataFrame:
    """Documents and terms of a field's doc values, or one document's terms."""
    v = s.doc_values.filter(F.col("field") == field)
    if doc_num is not None:
        return v.filter(F.col("doc_num") == doc_num).select(F.explode("terms").alias("term"))
    return v.agg(F.count("*").alias("n_docs"), F.sum(F.size("terms")).alias("n_terms"))


def stored(s: Segment, doc_num: int) -> DataFrame:
    return documents.stored_fields(s, doc_num)


def edges(s: Segment) -> DataFrame:
    return s.edges


def thesaurus(s: Segment, name: str) -> DataFrame:
    return synonyms.thesaurus(s.synonyms, name).groupBy("term").agg(F.countDistinct("synonym").alias("n_synonyms"), F.countDistinct("doc_num").alias("n_docs"))


def vector(s: Segment, field: str, vec_id: int | None = None) -> DataFrame:
    v = s.vectors.filter(F.col("field") == field)
    return v.select("vec_id", "doc_num") if vec_id is None else v.filter(F.col("vec_id") == vec_id).select("vec_id", "embedding")
