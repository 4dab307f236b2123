"""Blocks of postings in the order of (field, term): folded, sorted and dealt to ranges as Arrow batches, so that no block is
shuffled or sorted as a row, and a task holds a range of measured size."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources import analyze

#: Bytes of blocks that a task folds at once before it deals them out, and of a range; a range that is larger than it was
#: estimated is folded in runs of twice as much.
HELD_BYTES, RANGE_BYTES = 32 << 20, 32 << 20
#: A range isn't made smaller than this to give all cores work.
LEAST_BYTES = 8 << 20
#: Bytes of input and rows, at least, from which the borders of ranges are estimated (every row is dealt out by them), and bytes of postings for one point.
SAMPLE_BYTES, SAMPLE_ROWS, POINT_BYTES = 16 << 20, 1000, 4 << 10
KEY = ("field", "term", "doc_num")
LISTS = ("docs", "freqs", "lens", "places")


def _key(field: str, term: str, doc_num: int | None) -> tuple:
    return field, term, doc_num is None, doc_num or 0


def _runs(batches, most: int):
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        del b
        if size >= most:
            yield held
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield held


def _folded(held: list[pa.RecordBatch], places: int) -> pa.RecordBatch:
    """Blocks in the order of KEY, those of a term that are alike as one, up to ``places`` places. Empties ``held``."""
    t = pa.Table.from_batches(held)
    held.clear()
    t = t.combine_chunks().to_batches()[0]
    t = t.take(pa.compute.sort_indices(t, [(c, "ascending") for c in KEY]))
    n, offs = t.num_rows, np.asarray(t.column("docs").offsets)
    run = np.ones(n, bool)
    odd = pa.compute.greater(t.column("names").value_lengths(), 0)
    run[1:] = np.logical_or.reduce([np.asarray(pa.compute.not_equal(x.slice(1), x.slice(0, n - 1))) for x in (*(t.column(c) for c in ("field", "term", "located", "wide")), odd)])
    at = np.concatenate(([0], np.cumsum(np.asarray(t.column("freqs").flatten()).astype(np.int64))))[offs[:-1] - offs[0]]
    part = (at - at[np.flatnonzero(run)][np.cumsum(run) - 1]) // places
    first = np.flatnonzero(run | np.concatenate(([True], part[1:] != part[:-1])))
    to = pa.array((np.append(offs[first], offs[-1]) - offs[0]).astype(np.int32))
    alone = [c for c in t.schema.names if c not in LISTS]
    return pa.RecordBatch.from_arrays([t.column(c).take(pa.array(first)) for c in alone] + [pa.ListArray.from_arrays(to, t.column(c).flatten()) for c in LISTS], names=[*alone, *LISTS])


def _points(batches):
    """A posting for each POINT_BYTES, and of how many such it is."""
    before = np.random.default_rng().integers(POINT_BYTES)
    for b in batches:
        docs = b.column("docs")
        ends = before + np.cumsum(24 + 2 * np.asarray(b.column("places").flatten().value_lengths()).astype(np.int64))
        n = np.diff(ends // POINT_BYTES, prepend=0)
        at, before = np.flatnonzero(n), ends[-1] % POINT_BYTES if len(ends) else before
        row = pa.array(np.searchsorted(np.asarray(docs.offsets) - docs.offsets[0].as_py(), at, "right") - 1)
        yield pa.RecordBatch.from_arrays([b.column("field").take(row), b.column("term").take(row), docs.flatten().take(pa.array(at)), pa.array(n[at])], names=[*KEY, "n"])


def _packed(t: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(t)
    return sink.getvalue().to_pybytes()


def _dealt(batches, borders: list[tuple], places: int):
    for held in _runs(batches, HELD_BYTES):
        t = _folded(held, places)
        columns = [t.column(c) for c in KEY]
        key = lambda i: _key(*(x[i].as_py() for x in columns))  # noqa: E731, B023
        cuts = [0, *(bisect.bisect_left(range(t.num_rows), b, key=key) for b in borders), t.num_rows]
        own = [(i, t.slice(a, b - a)) for i, (a, b) in enumerate(itertools.pairwise(cuts)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([_packed(x) for _, x in own], pa.binary())], names=["part", "data"])


def _gathered(batches, places: int):
    blocks = (b for batch in batches for data in batch.column("data") for b in pa.ipc.open_stream(data.as_buffer()))
    for held in _runs(blocks, 2 * RANGE_BYTES):
        t = _folded(held, places)
        of = 8 * np.arange(t.num_rows) + np.asarray(t.column("docs").offsets)[:-1] >> 16  # so many rows and postings go to Spark at once
        for a, b in itertools.pairwise([*np.flatnonzero(np.diff(of, prepend=-1)), t.num_rows]):
            yield t.slice(a, b - a)


def arranged(rows: DataFrame, made: Callable, size: Column) -> DataFrame:
    """Blocks that ``made`` gives of batches of ``rows``, in ranges and sorted by KEY. ``size``: about how many bytes a row is."""
    places = analyze.BLOCK_PLACES
    n, total = rows.agg(F.count("*"), F.sum(size)).first()
    share = min(1.0, max(SAMPLE_BYTES / max(1, total or 0), SAMPLE_ROWS / max(1, n)))
    some = rows if share == 1 else rows.sample(share, 0)
    points = sorted((_key(*p[:3]), p[3]) for p in some.mapInArrow(lambda batches: _points(made(batches)), "field string, term string, doc_num long, n long").collect())
    whole = sum(n for _, n in points)
    about = whole * POINT_BYTES / share
    ranges = max(1, -int(-about // RANGE_BYTES), min(2 * rows.sparkSession.sparkContext.defaultParallelism, -int(-about // LEAST_BYTES)))
    borders, seen = [], 0
    for key, n in points:
        if seen >= (len(borders) + 1) * whole / ranges and borders[-1:] != [key]:
            borders.append(key)
        seen += n
    packed = rows.mapInArrow(lambda batches: _dealt(made(batches), borders, places), "part int, data binary")
    return packed.repartitionById(len(borders) + 1, "part").mapInArrow(lambda batches: _gathered(batches, places), analyze.BLOCKS)
