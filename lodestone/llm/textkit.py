"""Vectorised text primitives over Arrow batches, shared by the operators.

A *word* is a maximal run of ASCII letters, digits and non-ASCII characters; callers lower-case in the
JVM first, so hashing is case-blind. Text is handled as flat bytes with document offsets: hashing costs
a few nanoseconds a byte and no Python object per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 18  # of text handled at once, so that temporaries stay in cache


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one is set only where none is and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="lodestone-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: lineage ends, executors may be lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its offsets (n + 1); nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Document ranges of at most ``limit`` bytes; a longer document is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def parts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets from 0) for each chunk of documents of a column."""
    data, offsets = flat(column)
    for a, b in chunks(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[128:] = True
    for lo, hi in ((48, 57), (65, 90), (97, 122)):
        table[lo : hi + 1] = True
    return table


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the maximal runs where ``inside`` holds; none spans documents."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    before |= edge[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    after |= edge[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the entropy of a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def byte_table(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


class Hasher:
    """Position-independent polynomial hashes of byte runs, by differences of one prefix sum."""

    def __init__(self, seed: int = 1):
        self.table, self.base, self.powers = byte_table(seed), 0x100000001B3 | (seed << 48), np.ones((2, 1), np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        """Powers of the base and of its inverse modulo 2**64."""
        if self.powers.shape[1] <= n:
            p = np.empty((2, max(n + 1, CHUNK_BYTES + 1)), np.uint64)
            p[0], p[1], p[:, 0] = self.base, pow(self.base, -1, 1 << 64), 1
            self.powers = np.multiply.accumulate(p, axis=1)
        return self.powers

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        up, down = self._powers(n)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * up[:n], out=c[1:])
        return mixed((c[ends] - c[starts]) * down[starts])


def multipliers(k: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)


def grams(words: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hash of the k words from each word on (n - k + 1 values; document borders are the caller's)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = multipliers(k, seed)
    out = words[:n] * m[0]
    for j in range(1, k):
        out += words[j : j + n] * m[j]
    return mixed(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def winnow(hashes: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost minimum of each window of ``w`` hashes that lies in one document.

    ``first``: bounds of the documents in ``hashes`` (n + 1). A document with fewer than ``w`` hashes
    has one window. Spans of w hashes that two documents share select a common one.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(16, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (hashes & ~low) | (low - np.arange(n, dtype=np.uint64))
    chosen = np.zeros(n, bool)
    sizes = np.diff(first)
    if n >= w:
        ok = np.zeros(n + 1, np.int32)  # windows that start here and stay within a document
        long = sizes >= w
        np.add.at(ok, first[:-1][long], 1)
        np.add.at(ok, first[1:][long] - w + 1, -1)
        starts = np.flatnonzero(np.cumsum(ok[:-1])[: n - w + 1])
        chosen[(low - (sliding_min(key, w)[starts] & low)).astype(np.int64)] = True
    short = (sizes > 0) & (sizes < w)
    if short.any():
        least = nonempty_reduce(np.minimum, key, first, 0)[short]
        chosen[(low - (least & low)).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def nonempty_reduce(op, values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """``op.reduceat`` over documents given by bounds, with ``empty`` for documents without values."""
    out = np.full((len(first) - 1, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = op.reduceat(values, first[:-1][full], axis=0)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lowered(text: str = "text"):
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
