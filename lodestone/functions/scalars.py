"""Scalar helpers: norms, sizing policies, packed codes, distances. Column functions stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT_BELOW, QUANTISED_FROM, LARGE_FROM = 1_000, 10_000, 200_000
METRICS = ("l2", "ip", "cosine")


def norm(field_len: Column) -> Column:
    """Field-length norm in single precision, widened; NULL where the length is 0 or unknown."""
    return F.when(field_len > 0, (1 / F.sqrt(field_len.cast("double"))).cast("float").cast("double"))


def nlist(n: int, override: int | None = None) -> int:
    """Number of clusters for n vectors; 0 means no clustering."""
    if override is not None:
        return override
    if n >= LARGE_FROM:
        return int(4 * math.sqrt(n))
    return n // 100 if n >= FLAT_BELOW else 0


def nprobe(clusters: int, low_latency: bool = False) -> int:
    """Clusters visited by a search."""
    probes = math.isqrt(clusters)
    return max(1, probes // 2) if low_latency else probes


def choose_index(n: int, optimise: str = "recall") -> str:
    """Kind of index by size: ``flat`` below 1000 vectors; clustered above, quantised as the goal demands.

    ``optimise``: recall, latency, memory, rabitq, binary_flat or binary_sq8.
    """
    if n < FLAT_BELOW:
        return {"binary_flat": "binary_flat", "binary_sq8": "binary_sq8"}.get(optimise, "flat")
    kind = {"memory": "sq4", "rabitq": "rabitq", "binary_flat": "binary_flat", "binary_sq8": "binary_sq8"}.get(optimise)
    return f"ivf_{nlist(n)}_" + (kind or ("sq8" if n >= QUANTISED_FROM else "flat"))


def chunk_size(mode: int, cardinality: int, max_docs: int) -> int:
    """Postings per chunk: a fixed mode up to 1024, one chunk for small lists (1025), or graded by density (1026)."""
    if mode == 0:
        raise ValueError("chunk mode 0 is not defined")
    if mode <= 1024:
        return mode
    if mode == 1025:
        size = max_docs if cardinality <= 1024 else 1024
    elif mode == 1026:
        size = max_docs if cardinality <= 1024 else max_docs // (cardinality // 1024 + 1)
    else:
        raise ValueError(f"unknown chunk mode {mode}")
    if size <= 0:
        raise ValueError("a chunk would be empty")
    return size


def pack_freq(freq: Column, has_locations: Column) -> Column:
    return F.shiftleft(freq, 1).bitwiseOR(has_locations.cast("long"))


def unpack_freq(packed: Column) -> Column:
    return F.struct(F.shiftright(packed, 1).alias("freq"), (packed.bitwiseAND(F.lit(1)) == 1).alias("has_locations"))


def pack_pair(high: Column, low: Column) -> Column:
    """Two 32-bit values in one long (synonym codes, vector codes, single hits)."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def pack_hit(doc_num: Column, norm_bits: Column) -> Column:
    """A term's only posting (frequency 1, no locations) in one long; null where a part needs more than 31 bits."""
    fits = (doc_num >= 0) & (doc_num < 1 << 31) & (norm_bits >= 0) & (norm_bits < 1 << 31)
    return F.when(fits, F.shiftleft(norm_bits.cast("long"), 31).bitwiseOR(doc_num.cast("long")))


def unpack_pair(code: Column) -> Column:
    return F.struct(F.shiftrightunsigned(code, 32).alias("high"), code.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in double precision from left to right."""
    return _fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def score(metric: str, a: Column, b: Column) -> Column:
    """Score of two vectors. Cosine is the inner product of vectors that the caller has normalised."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {METRICS}")
    return squared_l2(a, b) if metric == "l2" else inner_product(a, b)


def ascending(metric: str) -> bool:
    """Whether smaller scores are better."""
    return metric == "l2"


def hamming(a: Column, b: Column) -> Column:
    """Components whose signs differ (positive or not)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x > 0) != (y > 0), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
