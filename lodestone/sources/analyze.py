"""Tokens: text is split at single blanks, case kept; positions count from 1, offsets are bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATION = "struct<field:string,pos:bigint,start:bigint,end:bigint,array_pos:array<bigint>>"


def tokens(value: Column, kind: str = "text") -> Column:
    return F.array(value) if kind == "keyword" else F.split(value, " ", -1)


def distinct_tokens(value: Column, kind: str = "text") -> Column:
    return F.lit(1) if kind == "keyword" else F.size(F.array_distinct(tokens(value)))


#: Bytes of text that are taken apart at once.
CHUNK_BYTES = 4 << 20
#: Places of a block, but for those of its last posting.
BLOCK_PLACES = 1 << 15
BLOCKS = "field string, term string, doc_num long, located boolean, wide boolean, names array<string>, docs array<long>, freqs array<int>, lens array<int>, places array<array<smallint>>"
BLOCK_INPUT = ("doc_num", "field", "term_vectors", "inst")


def _split(values: pa.Array, single: np.ndarray):
    """Tokens of all values by flat arrays, values whole where ``single``: (value, start, end in it, position, term)."""
    values = values.cast(pa.large_string())
    _, offs, data = values.buffers()
    bounds = np.frombuffer(offs, np.int64, len(values) + 1, values.offset * 8)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    cuts = np.flatnonzero(raw == 32)
    owner = np.searchsorted(bounds, cuts, "right") - 1
    split = ~single[owner] if len(cuts) else np.zeros(0, bool)
    cuts, owner = cuts[split], owner[split]
    starts = np.concatenate((bounds[:-1], cuts + 1))
    rows = np.concatenate((np.arange(len(values)), owner))
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.empty_like(starts)
    last = np.concatenate((rows[1:] != rows[:-1], [True]))
    ends[:-1] = starts[1:] - 1
    ends[last] = bounds[rows[last] + 1]
    first = np.searchsorted(rows, np.arange(len(values)))
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)), pa.py_buffer(raw[_spread(starts, ends)].tobytes()))
    return rows, starts - bounds[rows], ends - bounds[rows], np.arange(len(rows)) - first[rows] + 1, terms


def _chunks(batch: pa.RecordBatch):
    """Runs of rows with at most CHUNK_BYTES of text, or one row, as (rows, instances' columns, row of each instance)."""
    inst = batch.column("inst")
    counts = np.asarray(inst.value_lengths().fill_null(0)).astype(np.int64)
    size = np.asarray(pa.compute.binary_length(inst.flatten().field("value")).fill_null(0)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(counts)]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, "right")))
        rows = batch.slice(at, to - at)
        yield rows, dict(zip(("src", "value", "array_pos", "keyword"), rows.column("inst").flatten().flatten())), np.repeat(np.arange(to - at), counts[at:to])
        at = to


def _grouped(rows: pa.RecordBatch, inst: dict[str, pa.Array], owner: np.ndarray):
    """Tokens in the order of (field, term, row, place): their instance, position and start, the places where a posting
    begins and their (field, term) and row, and the rows' numbers of distinct tokens, those of each instance added up."""
    of, start, _, pos, term = _split(inst["value"], np.asarray(inst["keyword"]))
    term, row = term.dictionary_encode(), owner[of]
    code, n = np.asarray(term.indices).astype(np.int64), max(1, len(term.dictionary))
    field = rows.column("field").dictionary_encode()
    key = np.asarray(field.indices).astype(np.int64)[row] * n + code
    if len(owner) == rows.num_rows:  # an instance a row: tokens come in order
        order = np.argsort(key, kind="stable")
    else:
        src = inst["src"].dictionary_encode()
        rank = np.argsort(np.argsort(np.array(src.dictionary.to_pylist(), object)))[np.asarray(src.indices)]
        order = np.lexsort((_first(inst["array_pos"])[of], start, pos, rank[of], row, key))
    key, row, of = key[order], row[order], of[order]
    begins = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
    if len(owner) == rows.num_rows:
        lengths = np.bincount(row[begins], minlength=rows.num_rows)
    else:
        lengths = np.bincount(owner[np.unique(of * n + code[order]) // n], minlength=rows.num_rows)
    key, row = key[begins], row[begins]
    return of, pos[order], start[order], begins, field.dictionary.take(pa.array(key // n)), term.dictionary.cast(pa.string()).take(pa.array(key % n)), key, row, lengths


def _first(array_pos: pa.Array) -> np.ndarray:
    """An instance's place in its array, -1 outside of one."""
    return np.asarray(pa.compute.list_element(pa.compute.if_else(pa.compute.greater(array_pos.value_lengths(), 0), array_pos, pa.scalar([-1], array_pos.type)), 0))


def _counts(batches):
    for batch in batches:
        for rows, inst, owner in _chunks(batch):
            of, _, _, begins, field, term, _, row, lengths = _grouped(rows, inst, owner)
            freq = np.diff(np.append(begins, len(of)))
            yield pa.RecordBatch.from_arrays([field.cast(pa.string()), term, rows.column("doc_num").take(pa.array(row)), pa.array(freq), pa.array(lengths[row])], names=["field", "term", "doc_num", "freq", "field_len"])


def _blocks(batches, sources: tuple[str, ...]):
    for batch in batches:
        for rows, inst, owner in _chunks(batch):
            of, pos, start, begins, field, term, key, row, lengths = _grouped(rows, inst, owner)
            run = np.concatenate(([True], key[1:] != key[:-1]))
            part = (begins - begins[np.flatnonzero(run)][np.cumsum(run) - 1]) // BLOCK_PLACES
            first = np.flatnonzero(run | np.concatenate(([True], part[1:] != part[:-1])))  # posting that begins a block
            by_posting, by_place = np.append(first, len(key)), np.append(begins[first], len(of))
            freq, doc = np.diff(np.append(begins, len(of))), rows.column("doc_num").take(pa.array(row))
            lists = lambda x, offs: pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), x)
            ints = lambda x: pa.array(np.asarray(x).astype(np.int32))
            located = rows.column("term_vectors").take(pa.array(row[first]))
            src = np.asarray(pa.compute.index_in(inst["src"], pa.array(sources)))[of]
            own = pa.compute.index_in(field.cast(pa.string()), pa.array(sources)).fill_null(-1)
            within = np.repeat(np.arange(len(first)), np.diff(by_place))
            at = _first(inst["array_pos"])[of] + 1
            odd = np.zeros(len(first), bool)
            odd[within[(src != np.asarray(own)[first][within]) | (at > 0)]] = True
            wide = np.maximum.reduceat(np.maximum(np.maximum(pos, start), at), begins[first]) > 0xFFFF
            step = 1 + wide[within]
            to = np.concatenate(([0], np.cumsum(np.where(odd, 4, 2)[within] * step)))
            flat = np.zeros(to[-1], np.uint16)
            some, high = odd[within], wide[within]
            for i, x in enumerate((pos, start, src, at)):
                low = slice(None) if i < 2 else some
                flat[(to[:-1] + i * step)[low]] = (x & 0xFFFF)[low]
                low = high if i < 2 else high & some
                flat[(to[:-1] + 2 * i + 1)[low]] = (x >> 16)[low]
            places = lists(lists(pa.array(flat.view(np.int16)), to[np.append(begins, len(of))]), by_posting)
            names = lists(pa.array(sources * int(odd.sum()), pa.string()), np.concatenate(([0], np.cumsum(odd * len(sources)))))
            yield pa.RecordBatch.from_arrays(
                [field.take(pa.array(first)).cast(pa.string()), term.take(pa.array(first)), doc.take(pa.array(first)), located, pa.array(wide), names]
                + [lists(doc, by_posting), lists(ints(freq), by_posting), lists(ints(lengths[row]), by_posting), places],
                names=["field", "term", "doc_num", "located", "wide", "names", "docs", "freqs", "lens", "places"],
            )


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def counted(rows: DataFrame) -> DataFrame:
    """Postings of rows (doc_num, field, inst) without locations, one row a document, field and term."""
    return rows.select("doc_num", "field", "inst").mapInArrow(_counts, "field string, term string, doc_num long, freq long, field_len long")


def blocks(rows: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Postings of rows (doc_num, field, term_vectors, inst) in blocks: a row for each field, term and chunk of text, with
    plain arrays, which travel, sort and are stored at a fraction of the size of rows; ``doc_num`` is a block's first.
    ``places`` has for each posting the position and start of each place in 16 bits, or in twice 16, the lower first, where
    the block is ``wide``; where it has ``names``, also the number of the place's source in them and its place in an array, from 1.
    :func:`unfold` makes rows of them."""
    return rows.select(*BLOCK_INPUT).mapInArrow(blocks_of(sources), BLOCKS)


def blocks_of(sources: tuple[str, ...]):
    return lambda batches: _blocks(batches, sources)


def unfold(blocks: DataFrame) -> DataFrame:
    """Postings (field, term, doc_num, freq, field_len, locations) of blocks, in their order and within a block by row.
    Filters by field and term reach the blocks, and places are read from a posting's own array, if at all."""
    k = "if(size(names) = 0, 2, 4)"
    value = lambda i: f"if(wide, (get(places, 2 * ({k} * p + {i})) & 65535) | shiftleft(cast(get(places, 2 * ({k} * p + {i}) + 1) as int), 16), get(places, {k} * p + {i}) & 65535)"
    where = f"'pos', cast({value(0)} as bigint), 'start', cast({value(1)} as bigint), 'end', cast({value(1)} + octet_length(term) as bigint)"
    plain = f"named_struct('field', field, {where}, 'array_pos', cast(array() as array<bigint>))"
    place = f"named_struct('field', get(names, {value(2)}), {where}, 'array_pos', if({value(3)} > 0, array(cast({value(3)} - 1 as bigint)), cast(array() as array<bigint>)))"
    locations = f"if(located, if(size(names) = 0, transform(sequence(0, freqs - 1), p -> {plain}), transform(sequence(0, freqs - 1), p -> {place})), null) as locations"
    each = blocks.selectExpr("field", "term", "located", "wide", "names", "inline(arrays_zip(docs, freqs, lens, places))")
    return each.selectExpr("field", "term", "docs as doc_num", "cast(freqs as bigint) as freq", "cast(lens as bigint) as field_len", locations)
