"""Term dictionary and postings: lookups, enumeration, exclusion, counts, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import norm


def without(rows: DataFrame, docs: DataFrame | None, on: str = "doc_num") -> DataFrame:
    """Rows whose document is not in ``docs``; nothing is joined where there is nothing to exclude."""
    return rows if docs is None else rows.join(docs.select(on).distinct(), on, "left_anti")


def among(rows: DataFrame, docs: DataFrame | None, on: str = "doc_num") -> DataFrame:
    return rows if docs is None else rows.join(docs.select(on).distinct(), on, "left_semi")


def postings_list(postings: DataFrame, field: str, term: str, exclude: DataFrame | None = None, freq: bool = True, norms: bool = True, locations: bool = False) -> DataFrame:
    """Documents with a term; only the asked columns are read. Missing field or term: no rows."""
    found = without(postings.filter((F.col("field") == field) & (F.col("term") == term)), exclude)
    columns = ["doc_num", *(["freq"] if freq else []), *([norm(F.col("field_len")).alias("norm")] if norms else []), *(["locations"] if locations else [])]
    return found.select(*columns)


def advance(postings: DataFrame, doc_num: int, ordered: bool = True) -> DataFrame:
    """Postings from a document number on."""
    got = postings.filter(F.col("doc_num") >= doc_num)
    return got.orderBy("doc_num") if ordered else got


def next_at_or_after(postings: DataFrame, doc_num: int) -> DataFrame:
    """The first posting at or after a document number."""
    return postings.filter(F.col("doc_num") >= doc_num).orderBy("doc_num").limit(1)


def in_range(start: str | None, end: str | None) -> Column:
    """Terms from ``start`` up to, but without, ``end``; None is unbounded."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (F.col("term") >= start)
    return ok if end is None else ok & (F.col("term") < end)


def dictionary(postings: DataFrame, field: str, start: str | None = None, end: str | None = None, prefix: str | None = None, regex: str | None = None, fuzzy: tuple[str, int] | None = None, predicate: Column | None = None) -> DataFrame:
    """Terms of a field with document frequency (deletions don't lower it): (term, df) and ``distance`` if fuzzy.

    ``postings``: postings, or a segment's dictionary table, which is read by row groups of its terms. Bounds, prefix, whole-term regular expression, Levenshtein distance and any column predicate combine.
    """
    if "df" not in postings.columns:  # a dictionary table has a row a term already
        postings = postings.filter(F.col("field") == field).groupBy("field", "term").agg(F.count("*").alias("df"))
    t = postings.filter((F.col("field") == field) & in_range(start, end))
    if prefix is not None:
        t = t.filter(F.col("term").startswith(prefix))
    if regex is not None:
        t = t.filter(F.col("term").rlike(rf"^(?:{regex})\z"))
    if predicate is not None:
        t = t.filter(predicate)
    if fuzzy is None:
        return t.select("term", "df")
    word, most = fuzzy
    return t.select("term", "df", F.levenshtein("term", F.lit(word), most).alias("distance")).filter("distance >= 0")


def contains(postings: DataFrame, field: str, terms: list[str]) -> DataFrame:
    """(term, present) for each asked term."""
    spark = postings.sparkSession
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    have = postings.filter((F.col("field") == field) & F.col("term").isin(terms)).select("term", F.lit(True).alias("present")).distinct()
    return asked.join(F.broadcast(have), "term", "left").select("term", F.coalesce("present", F.lit(False)).alias("present"))


def cardinality(postings: DataFrame) -> DataFrame:
    """Distinct terms of each field, of postings or a dictionary."""
    if "df" in postings.columns:
        return postings.groupBy("field").agg(F.count("*").alias("n_terms"))
    return postings.groupBy("field").agg(F.countDistinct("term").alias("n_terms"))


def union(*lists: DataFrame) -> DataFrame:
    """Documents in any list."""
    out = lists[0].select("doc_num")
    for x in lists[1:]:
        out = out.union(x.select("doc_num"))
    return out.distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return without(a, b)


def intersection_count(a: DataFrame, b: DataFrame) -> DataFrame:
    return among(a, b).agg(F.count("*").alias("n"))


def doc_numbers(postings: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """External ids to (id, doc_num); unknown ids have no row, deletions are not applied."""
    own = postings.filter("field = '_id'").select(F.col("term").alias("id"), "doc_num")
    return own.filter(F.col("id").isin(ids)) if isinstance(ids, list) else own.join(ids.select("id").distinct(), "id", "left_semi")


def merged_terms(*postings: DataFrame) -> DataFrame:
    """The ordered k-way merge of dictionaries as a relation: (field, term, source, df), sources in order."""
    out = None
    for i, p in enumerate(postings):
        d = p.filter("term <> ''").groupBy("field", "term").agg(F.count("*").alias("df")).select("field", "term", F.lit(i).alias("source"), "df")
        out = d if out is None else out.unionByName(d)
    return out
