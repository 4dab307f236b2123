"""Stored fields, external ids, doc values, counts and field options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.mapping import FLAGS, ID
from lodestone.sources.segment import Segment


def field_names(segment: Segment) -> DataFrame:
    """(field, field_id): the id field is 0, the rest follow bytewise."""
    meta = segment.fields_meta.select("field")
    ranked = meta.groupBy().agg(F.sort_array(F.collect_set(F.struct((F.col("field") != ID).alias("rest"), "field"))).alias("x"))
    return ranked.select(F.posexplode("x").alias("field_id", "f")).select(F.col("f.field").alias("field"), "field_id")


def stored_fields(segment: Segment, doc_num: int | None = None, fields: list[str] | None = None) -> DataFrame:
    """Stored values; of one document in order, the id first, then by field name. A document out of range has none."""
    s = segment.stored
    s = s if doc_num is None else s.filter(F.col("doc_num") == doc_num)
    s = s if fields is None else s.filter(F.col("field").isin(fields))
    return s if doc_num is None else s.orderBy(F.col("field") != ID, "field", "seq")


def doc_id(segment: Segment, docs: DataFrame | list[int]) -> DataFrame:
    """External ids of document numbers."""
    d = segment.docs.select("doc_num", "id")
    return d.filter(F.col("doc_num").isin(docs)) if isinstance(docs, list) else d.join(docs.select("doc_num").distinct(), "doc_num", "left_semi")


def doc_values(segment: Segment, fields: list[str], docs: DataFrame | list[int] | None = None) -> DataFrame:
    """(doc_num, field, term) of listed fields; unknown fields are skipped. See visit_doc_values for order and extras."""
    v = segment.doc_values.filter(F.col("field").isin(fields))
    if docs is not None:
        v = v.filter(F.col("doc_num").isin(docs)) if isinstance(docs, list) else v.join(docs.select("doc_num").distinct(), "doc_num", "left_semi")
    return v.select("doc_num", "field", F.explode("terms").alias("term"))


def visit_doc_values(segment: Segment, fields: list[str], docs: DataFrame | list[int] | None = None) -> DataFrame:
    """(doc_num, field, ord, value): each document's terms as bytes in dictionary order, its extra value (an encoded shape)
    last."""
    v = segment.doc_values.filter(F.col("field").isin(fields))
    if docs is not None:
        v = v.filter(F.col("doc_num").isin(docs)) if isinstance(docs, list) else v.join(docs.select("doc_num").distinct(), "doc_num", "left_semi")
    terms = F.transform("terms", lambda t: t.cast("binary"))
    return v.select("doc_num", "field", F.posexplode(F.when(F.col("extra").isNull(), terms).otherwise(F.concat(terms, F.array("extra")))).alias("ord", "value"))


def doc_value_fields(segment: Segment) -> DataFrame:
    return segment.fields_meta.filter("doc_values").select("field")


def count(segment: Segment) -> DataFrame:
    """Documents, nested ones included."""
    return segment.docs.agg(F.count("*").alias("n"))


def options_or(*metas: DataFrame) -> DataFrame:
    """Options of fields within a batch: any instance switches them on."""
    return _options(metas, F.bool_or)


def options_and(*metas: DataFrame) -> DataFrame:
    """Options across segments: all that know the field must agree; ``differs`` tells if they didn't."""
    spans = [(F.bool_and(f) != F.bool_or(f)) for f in FLAGS]
    differs = spans[0]
    for s in spans[1:]:
        differs = differs | s
    return _options(metas, F.bool_and, differs.alias("differs"))


def _options(metas, how, *more):
    every = metas[0]
    for m in metas[1:]:
        every = every.unionByName(m)
    return every.groupBy("field").agg(*[how(f).alias(f) for f in FLAGS], *more)
