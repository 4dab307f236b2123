"""Plug-in surface: index sections by name. Building, writing, opening and merging segments go through the registry."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, IndexSection] = {}


class IndexSection(ABC):
    """A kind of index, one table of a segment. ``claims``: the field kinds that it serves; other sections leave them
    alone. ``schema``: of its table, with the document's number as ``doc_num``."""

    name: str
    schema: str
    claims: tuple[str, ...] = ()

    @abstractmethod
    def build(self, builder) -> DataFrame | None:
        """The table of a builder's rows."""

    def merge(self, moved: DataFrame, meta: DataFrame) -> DataFrame:
        """The table of a merged segment from the survivors' rows of all segments, in which documents are renumbered
        already; ``meta`` has the options of the merged fields."""
        return moved


def register(section: IndexSection) -> IndexSection:
    from lodestone.sources.segment import SCHEMAS

    if section.name in REGISTRY:
        raise ValueError(f"section {section.name!r} is registered already")
    REGISTRY[section.name] = section
    SCHEMAS.setdefault(section.name, section.schema)
    return section


def unregister(name: str) -> None:
    from lodestone.sources.segment import SCHEMAS

    del REGISTRY[name], SCHEMAS[name]


def kinds() -> set[str]:
    """Field kinds that some section claims."""
    return {k for s in REGISTRY.values() for k in s.claims}


class _Core(IndexSection):
    def __init__(self, name: str, claims: tuple[str, ...], flag: str | None = None):
        self.name, self.claims, self.flag, self.schema = name, claims, flag, ""

    def build(self, builder):
        return getattr(builder, self.name)()

    def merge(self, moved, meta):
        if self.flag:  # one row a field name
            moved = moved.join(F.broadcast(meta.filter(self.flag).select("field")), "field", "left_semi")
        if self.name == "postings":
            return moved.filter("term <> ''")
        if self.name == "synonyms":
            return moved.distinct()
        if self.name == "vectors":
            from lodestone.sources.segment import VECTOR_BITS, vec_ids

            return moved.withColumn("vec_id", vec_ids(F.col("doc_num"), F.col("vec_id").bitwiseAND(F.lit((1 << VECTOR_BITS) - 1))))
        return moved


for _name, _claims, _flag in (("postings", ("text", "keyword"), "indexed"), ("doc_values", ("text", "keyword"), "doc_values"), ("stored", ("text", "keyword"), "stored"), ("vectors", ("vector",), None), ("synonyms", ("synonym",), None)):
    REGISTRY[_name] = _Core(_name, _claims, _flag)
