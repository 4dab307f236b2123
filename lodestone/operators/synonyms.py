"""Thesauri: (thesaurus, term, synonym, doc_num)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.terms import dictionary, without


def thesaurus(synonyms: DataFrame, name: str) -> DataFrame:
    """A missing one is empty."""
    return synonyms.filter(F.col("thesaurus") == name)


def lookup(synonyms: DataFrame, name: str, term: str, exclude: DataFrame | None = None) -> DataFrame:
    """(synonym, doc_num) of a term, without what excluded documents contribute."""
    return without(thesaurus(synonyms, name).filter(F.col("term") == term), exclude).select("synonym", "doc_num").distinct()


def terms(synonyms: DataFrame, name: str, **how) -> DataFrame:
    """Keys of a thesaurus; bounds, prefix, regex and fuzzy as for a dictionary."""
    as_field = thesaurus(synonyms, name).select(F.col("thesaurus").alias("field"), "term")
    return dictionary(as_field, name, **how).select("term")


def contains(synonyms: DataFrame, name: str, term: str) -> bool:
    return not thesaurus(synonyms, name).filter(F.col("term") == term).limit(1).isEmpty()
