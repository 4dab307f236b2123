"""5. Repeated passages by suffix arrays, built by two-stage sorting.

Suffixes smaller than their successors are sorted directly, all others are induced by one scan over the buckets.
To spread over a cluster, each window of ``min_words`` words is represented by its rightmost minimal k-gram: equal
windows have equal representatives, so windows meet in the group of theirs, and the sort sees only text whose
representative occurs twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.textkit import Hasher, cut, grams, lowered, mixed, parts, runs, signed, sliding_min, word_bytes

MIN_WORDS, K = 50, 8
TOKENS_A_SORT, HOT, BUSY = 1 << 19, 1 << 16, 1 << 20


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Two-stage suffix array of symbols >= 0, where every 0 ends a piece and the last symbol is 0.

    Suffixes are compared up to the end of their piece; equal ones come in no particular order.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(t == 0)
    change = np.flatnonzero(np.concatenate((t[1:] != t[:-1], [True])))  # last positions of equal runs
    run_end = change[np.searchsorted(change, np.arange(n))]
    smaller = np.zeros(n, bool)  # than their successors
    inner = run_end + 1 < n
    smaller[inner] = t[run_end[inner]] < t[run_end[inner] + 1]
    smaller[ends] = False
    direct = np.flatnonzero(smaller)
    buffer = t.astype(">u4").tobytes()
    stop = ends[np.searchsorted(ends, direct)]
    keys = [buffer[4 * i : 4 * e] for i, e in zip(direct.tolist(), stop.tolist())]
    order = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    sizes = np.bincount(t, minlength=int(t.max()) + 1)
    heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    held = np.bincount(t[order], minlength=len(sizes))
    sa = np.full(n, -1, np.int64)
    sa[: len(ends)] = ends
    if len(order):  # sorted suffixes fill the ends of their buckets
        within = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
        sa[np.repeat(heads + sizes - held, held) + within] = order
    out, front, symbols, induced = sa.tolist(), heads.tolist(), t.tolist(), (~smaller & (t != 0)).tolist()
    for p in range(n):
        j = out[p] - 1
        if j >= 0 and induced[j]:
            c = symbols[j]
            q = front[c]
            out[q] = j
            front[c] = q + 1
    return np.array(out, np.int64)


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths, up to ``most``, of the common prefixes of suffix pairs within their pieces."""
    out, live = np.full(len(a), most, np.int64), np.arange(len(a))
    for k in range(most):
        x = t[a[live] + k]
        same = (x == t[b[live] + k]) & (x != 0)
        out[live[~same]] = k
        live = live[same]
        if not len(live):
            break
    return out


def repeated(pieces: list[np.ndarray], several: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece of symbols: which windows of ``length`` also start elsewhere. ``several``: pieces met twice."""
    sizes = np.array([len(p) for p in pieces])
    flat = np.concatenate([x for p in pieces for x in (p, np.zeros(1, p.dtype))])
    ends = np.cumsum(sizes + 1) - 1
    real = np.ones(len(flat), bool)
    real[ends] = False
    t = np.zeros(len(flat), np.int64)
    t[real] = np.unique(flat[real], return_inverse=True)[1] + 1
    sa = suffix_array(t)
    room = ends[np.searchsorted(ends, sa)] - sa
    windows = sa[room >= length]
    found = np.zeros(len(t), bool)
    if len(windows) > 1:
        equal = common_prefixes(t, windows[:-1], windows[1:], length) >= length
        found[windows[:-1][equal]] = True
        found[windows[1:][equal]] = True
    starts = ends - sizes
    return [np.ones(n - length + 1, bool) if twice else found[s : s + n - length + 1] for s, n, twice in zip(starts, sizes, several)]


def anchors(words: np.ndarray, first: np.ndarray, length: int, k: int):
    """(document, first window, windows, hash) of the runs of windows that have the same representative."""
    g, w = grams(words, k), length - k + 1
    sizes = np.maximum(np.diff(first) - length + 1, 0)
    if not sizes.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    bits = np.uint64(max(16, int(len(g)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = sliding_min((g & ~low) | (low - np.arange(len(g), dtype=np.uint64)), w)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(first[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    pick = (low - (least[at] & low)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1]))))
    return owner[new], at[new] - first[owner[new]], np.diff(np.concatenate((new, [len(pick)]))), g[pick[new]]


def _chunk_words(column, hasher, inside):
    for a, b, data, offsets in parts(column):
        starts, ends, owner = runs(inside[data], offsets)
        yield a, hasher(data, starts, ends), np.searchsorted(owner, np.arange(b - a + 1))


PLACES = "h long, doc_id long, v long, start int, n int, many int, sure boolean"


def _placed(h, doc, v, start, n):
    """Rows of PLACES. A hash that this batch has at several places is sure to be met there: its rows needn't meet others,
    but for the first, which stands for them and tells how ``many`` they are. So a hot one meets but once a batch."""
    order = np.lexsort((start, v, doc, h))
    h, doc, v, start, n = (x[order] for x in (h, doc, v, start, n))
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    many = np.zeros(len(h), np.int32)
    sure = np.zeros(len(h), bool)
    if len(at):
        other = np.concatenate(([False], (h[1:] == h[:-1]) & ((doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (start[1:] != start[:-1]))))
        size = np.diff(np.append(at, len(h)))
        several = np.logical_or.reduceat(other, at)
        sure = np.repeat(several, size)
        sure[at] = False
        many[at] = np.where(several, size, 1)
        lone = np.repeat(~several, size)  # one place, perhaps in rows that repeat: one of them is enough
        lone[at] = False
        h, doc, v, start, n, many, sure = (x[~lone] for x in (h, doc, v, start, n, many, sure))
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(v, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(many, pa.int32()), pa.array(sure, pa.bool_())], names=["h", "doc_id", "v", "start", "n", "many", "sure"])


def _anchors(length, k):
    def run(batches):
        hasher, inside = Hasher(), word_bytes()
        for batch in batches:
            ids, vs = np.asarray(batch.column("doc_id")), np.asarray(batch.column("v"))
            found = [(np.zeros(0, np.int64),) * 4]
            for a, words, first in _chunk_words(batch.column("text"), hasher, inside):
                owner, start, n, h = anchors(words, first, length, k)
                found.append((signed(h), a + owner, start, n))
            h, row, start, n = (np.concatenate(x) for x in zip(*found))
            yield _placed(h, ids[row], vs[row], start, n)

    return run


def _met_twice(hot):
    """Rows of PLACES, sorted by h, that are sure or whose h occurs at two places or more; a row waits until its successor
    is known. A row without doc_id tells of a hash with more than ``hot`` places."""

    def run(batches):
        last, last_met, count = None, False, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            sure = table.column("sure").to_numpy()
            if sure.any():
                yield from table.filter(pa.array(sure)).to_batches()
                table = table.filter(pa.array(~sure)).combine_chunks()
                if not len(table):
                    last = None
                    continue
            h, doc, v, start, many = (table.column(c).to_numpy() for c in ("h", "doc_id", "v", "start", "many"))
            other = (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (start[1:] != start[:-1])
            joined = (h[1:] == h[:-1]) & other
            keep = many > 1
            keep[:-1] |= joined
            keep[1:] |= joined
            keep[0] |= last_met
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sums = np.add.reduceat(many.astype(np.int64), at)
            sums[0] += count
            done = sums[:-1] > hot  # the last one may go on
            if done.any():
                yield _told(h[at[:-1][done]])
            last, last_met, count = table.slice(len(h) - 1).to_batches()[0], bool(keep[-1]), int(sums[-1] - many[-1])
            yield from table.slice(0, len(h) - 1).filter(pa.array(keep[:-1])).to_batches()
        if last is not None:
            if count + last.column("many")[0].as_py() > hot:
                yield _told(np.asarray(last.column("h")))
            if last_met:
                yield last

    return run


def _told(h):
    none, zero = pa.nulls(len(h), pa.int64()), pa.array(np.zeros(len(h), np.int32))
    return pa.RecordBatch.from_arrays([pa.array(h), none, none, zero, zero, zero, pa.array(np.zeros(len(h), bool))], names=["h", "doc_id", "v", "start", "n", "many", "sure"])


def _met(places: DataFrame, hot: int) -> DataFrame:
    """Shuffle by hash, sure rows by place, and keep what is met."""
    spread = F.when(F.col("sure"), F.xxhash64("doc_id", "v", "start")).otherwise(F.col("h"))
    return cut(places.repartition(spread).sortWithinPartitions("sure", "h", "doc_id", "v", "start").mapInArrow(_met_twice(hot), PLACES))


def _contexts(length):
    """Anchors with the words that their windows cover. Of a hot anchor each window is a row of its own, with a hash of
    all its words and a context of 8 bytes; those that this batch has at several places are known to be met and told as
    runs, with their number of words as context (4 bytes), but for one row a hash that meets other batches."""

    def run(batches):
        hasher, inside = Hasher(), word_bytes()
        for batch in batches:
            ids, vs, found = batch.column("doc_id").to_pylist(), batch.column("v").to_pylist(), batch.column("found")
            crowd = [(np.zeros(0, np.int64),) * 3]
            for a, words, first in _chunk_words(batch.column("text"), hasher, inside):
                small = (words >> np.uint64(32)).astype("<u4")
                g = None
                h, doc, v, start, context = [], [], [], [], []
                for i in range(len(first) - 1):
                    for x in found[a + i].as_py():
                        lo = first[i] + x["start"]
                        if x["hot"]:
                            g = signed(grams(words, length, 29)) if g is None else g
                            crowd.append((g[lo : lo + x["n"]], np.full(x["n"], a + i), np.arange(x["start"], x["start"] + x["n"])))
                            continue
                        h.append(x["h"])
                        doc.append(ids[a + i])
                        v.append(vs[a + i])
                        start.append(x["start"])
                        context.append(small[lo : lo + x["n"] + length - 1].tobytes())
                yield _context_rows(h, doc, v, start, context)
            if len(crowd) > 1:
                h, row, start = (np.concatenate(x) for x in zip(*crowd))
                yield from _crowded(h, np.array(ids)[row], np.array(vs)[row], start, length)

    return run


def _context_rows(h, doc, v, start, context):
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(v, pa.int64()), pa.array(start, pa.int32()), pa.array(context, pa.binary())], names=["h", "doc_id", "v", "start", "context"])


def _crowded(h, doc, v, start, length):
    order = np.lexsort((start, v, doc, h))
    h, doc, v, start = (x[order] for x in (h, doc, v, start))
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    other = np.concatenate(([False], (h[1:] == h[:-1]) & ((doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (start[1:] != start[:-1]))))
    sure = np.repeat(np.logical_or.reduceat(other, at), np.diff(np.append(at, len(h))))
    yield _context_rows(h[at], doc[at], v[at], start[at], [b"a window"] * len(at))
    order = np.flatnonzero(sure)[np.lexsort((start[sure], v[sure], doc[sure]))]
    if len(order):
        doc, v, start = doc[order], v[order], start[order]
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (start[1:] > start[:-1] + 1))))
        last = np.append(new[1:], len(order)) - 1
        spread = signed(mixed(doc[new].view(np.uint64) + start[new].astype(np.uint64)))
        yield _context_rows(spread, doc[new], v[new], start[new], [x.tobytes() for x in (start[last] - start[new] + length).astype("<i4")])


def _sorted_pieces(length):
    """Rows sorted by (h, context, place): equal contexts are one piece, and its windows are met if it is at two places.
    The other pieces are sorted together, in groups of whole h; one that is alone with its h has met nobody."""

    def spans(rows):
        doc, v, lo, hi = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(v, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["doc_id", "v", "lo", "hi"])

    def solve(pieces, places, several):
        hits, out = repeated([np.frombuffer(p, "<u4") for p in pieces], np.array(several), length), []
        for hit, (d, v, s), told in zip(hits, places, several):
            if not told:
                at = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
                out += [(d, v, s + a, s + b - 1 + length) for a, b in zip(at[::2].tolist(), at[1::2].tolist())]
        return out

    def run(batches):
        pieces, places, several, size, group, begun, out = [], [], [], 0, None, 0, []
        last = None

        def close():
            """Drop a group in which nothing is left to find."""
            nonlocal size
            if all(several[begun:]) or len(pieces) == begun + 1:
                size -= sum(map(len, pieces[begun:])) // 4
                del pieces[begun:], places[begun:], several[begun:]

        for batch in batches:
            for h, d, v, s, c in zip(*(batch.column(x).to_pylist() for x in ("h", "doc_id", "v", "start", "context"))):
                if len(c) == 4:  # a run that was met where it was read
                    out.append((d, v, s, s + int.from_bytes(c, "little")))
                    continue
                n = length if len(c) == 8 else len(c) // 4
                if h != group:
                    close()
                    if size >= TOKENS_A_SORT:
                        out += solve(pieces, places, several)
                        pieces, places, several, size = [], [], [], 0
                    group, begun, last = h, len(pieces), None
                if c == last:
                    if (d, v, s) == place:  # a row that repeats
                        continue
                    if not several[-1]:
                        several[-1] = True
                        out.append((*place, place[2] + n))
                    place = (d, v, s)
                    out.append((d, v, s, s + n))
                else:
                    last = c
                    place = (d, v, s)
                    pieces.append(c)
                    places.append(place)
                    several.append(False)
                    size += len(c) // 4
                if len(out) > 1 << 16:
                    yield spans(out)
                    out = []
        close()
        if pieces:
            out += solve(pieces, places, several)
        if out:
            yield spans(out)

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, hot: int = HOT) -> DataFrame:
    """Maximal spans of words, (doc_id, lo, hi), that consist of windows of ``min_words`` words which occur at another
    place of the corpus as well. Positions count lower-cased words from 0; ``hi`` is exclusive.

    All occurrences are given. Null, empty and shorter texts have none; null ids are dropped; rows that repeat id and text
    are one document, rows of one id with different texts documents of their own, told under that id. Extra columns are
    ignored. An empty table gives no rows. Whole texts are used, and texts may be of any length.

    Windows meet by their rightmost minimal k-gram. One that occurs at more than ``hot`` places is not sorted as a group:
    its windows, each by a hash of all its words, meet like k-grams do, so no task holds a group without a bound.
    """
    d = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), lowered().alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("v"), "text")
    met = _met(d.mapInArrow(_anchors(min_words, k), PLACES), hot)
    busy = met.filter("doc_id is null").select("h")
    met = met.filter("doc_id is not null").select("h", "doc_id", "v", "start", "n")
    n_busy = busy.count()  # at most a 65,536th of the places
    busy = busy.distinct().withColumn("hot", F.lit(True))
    met = met.join(F.broadcast(busy) if n_busy <= BUSY else busy, "h", "left") if n_busy else met.withColumn("hot", F.lit(False))
    found = met.groupBy("doc_id", "v").agg(F.collect_set(F.struct("h", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("found"))
    contexts = found.join(d, ["doc_id", "v"]).select("doc_id", "v", "found", "text").mapInArrow(_contexts(min_words), "h long, doc_id long, v long, start int, context binary")
    spans = contexts.repartition("h").sortWithinPartitions("h", "context", "doc_id", "v", "start").mapInArrow(_sorted_pieces(min_words), "doc_id long, v long, lo long, hi long")
    order = Window.partitionBy("doc_id", "v").orderBy("lo", "hi")
    reach = spans.withColumn("reach", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    island = reach.withColumn("island", F.sum(F.when(F.col("lo") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "v", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("doc_id", "lo", "hi")
