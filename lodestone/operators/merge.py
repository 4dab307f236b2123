"""Merging segments: renumbering, options, updates, drops, edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.documents import options_and
from lodestone.operators.sections import REGISTRY
from lodestone.session import materialise
from lodestone.sources.segment import SCHEMAS, Segment, dense

BROADCAST_ROWS = 1 << 20


class Cancelled(Exception):
    """A merge was told to stop."""


def _stack(segments: list[Segment], name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.table(name).withColumn("segment", F.lit(i)) for i, s in enumerate(segments)])


def _losers(drops) -> DataFrame | None:
    """One relation (segment, old) of dropped documents, from a list with a frame (doc_num) for each segment or as it is."""
    if drops is None or isinstance(drops, DataFrame):
        return None if drops is None else drops.select("segment", F.col("doc_num").alias("old")).distinct()
    gone = [d.select(F.lit(i).alias("segment"), F.col("doc_num").alias("old")) for i, d in enumerate(drops) if d is not None]
    return reduce(DataFrame.unionByName, gone).distinct() if gone else None


def doc_map(segments: list[Segment], drops=None) -> DataFrame:
    """(segment, old, new): survivors numbered densely in (segment, old) order; ``new`` is null for the dropped."""
    every = _stack(segments, "docs").select("segment", F.col("doc_num").alias("old"))
    gone = _losers(drops)
    left = every if gone is None else every.join(gone, ["segment", "old"], "left_anti")
    within = dense(left, ["segment"], "old", "_rank")
    sizes = left.groupBy("segment").agg(F.count("*").alias("_n"))
    before = sizes.select("segment", F.coalesce(F.sum("_n").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    new = within.join(F.broadcast(before), "segment").select("segment", "old", (F.col("_shift") + F.col("_rank")).alias("new"))  # a row a segment
    return new if gone is None else every.join(new, ["segment", "old"], "left")


def _offsets(segments: list[Segment]) -> list[int] | None:
    """What to add to the numbers of each segment, if all are dense from 0."""
    rows = {r["segment"]: r for r in _stack(segments, "docs").groupBy("segment").agg(F.count("*").alias("n"), F.min("doc_num").alias("least"), F.max("doc_num").alias("most")).collect()}
    out, at = [], 0
    for i in range(len(segments)):
        out.append(at)
        if i in rows:
            if rows[i]["least"] != 0 or rows[i]["most"] != rows[i]["n"] - 1:
                return None
            at += rows[i]["n"]
    return out


def updated_options(meta: DataFrame, updates: DataFrame | None) -> DataFrame:
    """Field options after updates (field, deleted, no_index, no_store, no_doc_values): deleted fields go, bits clear."""
    if updates is None:
        return meta
    flags = ("deleted", "no_index", "no_store", "no_doc_values")
    u = updates.groupBy("field").agg(*[F.bool_or(F.coalesce(f, F.lit(False))).alias(f) for f in flags])
    j = meta.join(u, "field", "left").fillna(False, list(flags)).filter("not deleted")
    off = {"indexed": "no_index", "stored": "no_store", "doc_values": "no_doc_values"}
    return j.select(*[(F.col(c) & ~F.col(off[c])).alias(c) if c in off else F.col(c) for c in meta.columns])


def merge(segments: list[Segment], drops=None, updates: DataFrame | None = None, cancelled: Callable[[], bool] = lambda: False) -> tuple[Segment, DataFrame]:
    """One segment of all survivors, and the map of document numbers.

    ``drops``: a frame (doc_num) or None for each segment, or one relation (segment, doc_num). Options of a field are those
    that all segments agree on, after ``updates`` (by default those that the segments carry); what a merged field doesn't
    keep is left out, and only that. Terms whose documents are all gone vanish, as do empty terms. Edges stay where both
    ends do: a child of a dropped parent becomes a root. Vectors and synonyms follow their documents; vec_ids are
    renumbered by document. Segments without documents add nothing; no segments give an error.

    Without drops, segments that are dense from 0 are shifted, without any join. Otherwise the map is cut once and
    broadcast if it was counted small. ``cancelled`` is asked before each step; if it says so, Cancelled is raised.
    """
    if not segments:
        raise ValueError("nothing to merge")
    spark = segments[0].spark

    def step():
        if cancelled():
            raise Cancelled()

    step()
    gone = _losers(drops)
    offsets = _offsets(segments) if gone is None else None
    docmap = doc_map(segments, drops)
    if offsets is None:
        docmap = materialise(docmap)
        kept = docmap.filter("new is not null")
        if docmap.count() <= BROADCAST_ROWS:
            kept = F.broadcast(kept)
    step()
    updates = _stacked_updates(segments) if updates is None else updates
    meta = updated_options(options_and(*[s.fields_meta for s in segments]).drop("differs"), updates)

    def moved(name: str) -> DataFrame:
        step()
        t = _stack(segments, name)
        if offsets is not None:
            return t.withColumn("doc_num", F.col("doc_num") + _shift(offsets)).drop("segment")
        return t.withColumnRenamed("doc_num", "old").join(kept, ["segment", "old"]).withColumnRenamed("new", "doc_num").drop("segment", "old")

    if offsets is not None:
        d = _stack(segments, "docs")
        docs = d.select((F.col("doc_num") + _shift(offsets)).alias("doc_num"), "id", (F.col("parent") + _shift(offsets)).alias("parent"))
    else:
        d = _stack(segments, "docs").withColumnRenamed("doc_num", "old").join(kept, ["segment", "old"])
        up = docmap.filter("new is not null").select("segment", F.col("old").alias("parent"), F.col("new").alias("new_parent"))
        docs = d.join(up, ["segment", "parent"], "left").select(F.col("new").alias("doc_num"), "id", F.col("new_parent").alias("parent"))
    tables = {"docs": docs, "fields_meta": meta}
    for name, section in REGISTRY.items():
        if any(s.has(name) for s in segments):
            tables[name] = section.merge(moved(name), meta).select(*_names(name))
    step()
    return Segment(spark, tables), docmap


def _shift(offsets: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("segment") + 1)


def _stacked_updates(segments: list[Segment]) -> DataFrame | None:
    have = [s.updates for s in segments if s.has("updates")]
    return reduce(DataFrame.unionByName, have) if have else None


def _names(table: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMAS[table]).names


def superseded(segments: list[Segment]) -> DataFrame:
    """(segment, doc_num) of documents whose id occurs in a later segment: the drops of an upsert, as one relation."""
    ids = _stack(segments, "docs").select("segment", "id", "doc_num")
    last = ids.groupBy("id").agg(F.max("segment").alias("last"))
    return ids.join(last, "id").filter("segment < last").select("segment", "doc_num")


def compact(segments: list[Segment], cancelled: Callable[[], bool] = lambda: False) -> tuple[Segment, DataFrame]:
    """Merge in order, the newest version of each id wins. Plan and scans grow in proportion to the segments."""
    return merge(segments, superseded(segments), cancelled=cancelled)
