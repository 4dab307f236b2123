"""Which column becomes which field, and what is kept of it."""

from __future__ import annotations

from dataclasses import dataclass, field

FLAGS = ("indexed", "stored", "doc_values", "term_vectors")
ID = "_id"


@dataclass(frozen=True)
class FieldSpec:
    """A field from a SQL expression over the source rows.

    kind: ``text`` (split at single blanks), ``keyword`` (one token), ``vector`` or ``synonym``. A text or keyword
    expression of array type gives one instance an element, with its position. Synonym fields are arrays of words
    (an equivalence set) or structs (terms array<string>, synonyms array<string>).
    """

    name: str
    expr: str
    kind: str = "text"
    indexed: bool = True
    stored: bool = False
    doc_values: bool = False
    term_vectors: bool = True
    similarity: str = "l2"
    typ: str = "t"
    extra: str | None = None  # an expression for bytes that doc values keep beside the terms (an encoded shape)
    optimise: str = "recall"  # what a vector index is chosen for, see scalars.choose_index

    def __post_init__(self):
        from lodestone.operators.sections import kinds

        if self.kind not in kinds():
            raise ValueError(f"unknown kind {self.kind!r} of field {self.name!r}")


@dataclass(frozen=True)
class Mapping:
    id_expr: str
    fields: tuple[FieldSpec, ...]
    composites: dict[str, tuple[str, ...]] = field(default_factory=dict)  # name -> source fields, all texts if empty
    parent_expr: str | None = None
    path_expr: str | None = None  # array of keys from the root on: rows are flattened to trees, which numbers them

    @property
    def texts(self) -> tuple[FieldSpec, ...]:
        return tuple(f for f in self.fields if f.kind in ("text", "keyword"))

    def claimed(self, kinds: tuple[str, ...]) -> bool:
        """Whether a section for these kinds has anything to do; every document has an id, a keyword."""
        return "keyword" in kinds or any(f.kind in kinds for f in self.fields)

    def of(self, kind: str) -> tuple[FieldSpec, ...]:
        return tuple(f for f in self.fields if f.kind == kind)
