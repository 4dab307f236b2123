"""10. Benchmark decontamination by winnowing: every shared span of at least ``k + w - 1`` words is found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textkit import Hasher, fresh, grams, lowered, parts, runs, signed, winnow, word_bytes

K, W = 6, 5
LONG, SHARE = 13, 0.5  # a span of so many words, or so much of an item, contaminates
BROADCAST_BYTES = 64 << 20
SCHEMA = "doc_id long, item_id long, doc_start int, item_start int, n_words int"


def _tokens(column, hasher, inside):
    """Per chunk of documents: (first row, word hashes, bounds of the documents among the words)."""
    for a, b, data, offsets in parts(column):
        starts, ends, owner = runs(inside[data], offsets)
        yield a, hasher(data, starts, ends), np.searchsorted(owner, np.arange(b - a + 1))


def _winnowed(words, first, k, w):
    """Positions (among the words) and hashes of the selected k-grams, none across documents."""
    g = grams(words, k)
    sizes = np.maximum(np.diff(first) - (k - 1), 0)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    index = np.repeat(first[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
    chosen = winnow(g[index], bounds, w)
    at = index[chosen]
    return at, g[at]


def _spans(words, at, lo, hi, item_words, item_lo, item_at, item_hi, k):
    """Extend one pair of equal k-grams to the maximal common span: (start, item start, length)."""
    back = min(at - lo, item_at - item_lo)
    n = 0
    if back:
        differ = np.flatnonzero(words[at - back : at][::-1] != item_words[item_at - back : item_at][::-1])
        n = int(differ[0]) if len(differ) else back
    ahead = min(hi - at, item_hi - item_at)
    differ = np.flatnonzero(words[at : at + ahead] != item_words[item_at : item_at + ahead])
    m = int(differ[0]) if len(differ) else ahead
    return at - n, item_at - n, n + m


def _extend(words, first, docs_of, positions, items, item_words, item_first, item_ids, item_at_sorted, k, least):
    """Maximal spans of at least ``least`` words from hits (word position, item, item position)."""
    done, out = {}, set()
    for row, at, item, item_at in zip(docs_of, positions, items, item_at_sorted):
        diagonal = (row, item, at - item_at)
        if done.get(diagonal, -1) > at:
            continue
        s, i, n = _spans(words, at, first[row], first[row + 1], item_words, item_first[item], item_at, item_first[item + 1], k)
        done[diagonal] = s + n
        if n >= least:
            out.add((row, int(item_ids[item]), int(s - first[row]), int(i - item_first[item]), int(n)))
    return sorted(out)


class _Bench:
    """Word hashes of all items and an index of their winnowed k-grams, sorted by hash."""

    def __init__(self, ids, texts, k, w):
        hasher, inside = Hasher(), word_bytes()
        words, sizes, prints, places = [], [], [], []
        base = 0
        for a, ws, first in _tokens(texts, hasher, inside):
            at, h = _winnowed(ws, first, k, w)
            words.append(ws)
            sizes.append(np.diff(first))
            prints.append(h)
            places.append(at + base)
            base += len(ws)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.words, self.ids = cat(words, np.uint64), np.asarray(ids)
        self.first = np.concatenate(([0], np.cumsum(cat(sizes, np.int64)))).astype(np.int64)
        prints, places = cat(prints, np.uint64), cat(places, np.int64)
        order = np.argsort(prints, kind="stable")
        self.prints, self.places = prints[order], places[order]
        self.items = np.searchsorted(self.first, self.places, "right") - 1


def _mapper(bench, k, w, least):
    low = np.uint64((1 << 22) - 1)

    def run(batches):
        hasher, inside = Hasher(), word_bytes()
        maybe = np.zeros(1 << 22, bool)  # a first sieve: most k-grams meet no benchmark
        maybe[(bench.prints & low).astype(np.int64)] = True
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            rows = []
            for a, words, first in _tokens(batch.column("text"), hasher, inside):
                at, h = _winnowed(words, first, k, w)
                sieve = maybe[(h & low).astype(np.int64)]
                at, h = at[sieve], h[sieve]
                lo, hi = np.searchsorted(bench.prints, h, "left"), np.searchsorted(bench.prints, h, "right")
                n = hi - lo
                if not n.sum():
                    continue
                which = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                where = np.repeat(at, n)
                owner = np.searchsorted(first, where, "right") - 1
                rows += [(ids[a + r], *x) for r, *x in _extend(words, first, owner, where, bench.items[which], bench.words, bench.first, bench.ids, bench.places[which], k, least)]
            if rows:
                yield _batch(rows)

    return run


def _batch(rows):
    doc, item, s, i, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(s, pa.int32()), pa.array(i, pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "item_id", "doc_start", "item_start", "n_words"])


def _prints(k, w):
    def run(batches):
        hasher, inside = Hasher(), word_bytes()
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for a, words, first in _tokens(batch.column("text"), hasher, inside):
                at, h = _winnowed(words, first, k, w)
                owner = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + owner], pa.int64()), pa.array(at - first[owner], pa.int32()), pa.array(signed(h))], names=["id", "at", "h"])

    return run


def _verify(k, least):
    def run(batches):
        hasher, inside = Hasher(), word_bytes()
        for batch in batches:
            ids, items = batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist()
            theirs = [(w, f) for _, w, f in _pairs(batch.column("item_text"), hasher, inside)]
            rows = []
            for r, words, _ in _pairs(batch.column("text"), hasher, inside):
                iw, _ = theirs[r]
                hits = batch.column("hits")[r].as_py()
                hits.sort(key=lambda x: x["at"])
                got = _extend(words, np.array([0, len(words)]), [0] * len(hits), [x["at"] for x in hits], [0] * len(hits), iw, np.array([0, len(iw)]), [items[r]], [x["item_at"] for x in hits], k, least)
                rows += [(ids[r], *x[1:]) for x in got]
            if rows:
                yield _batch(rows)

    return run


def _pairs(column, hasher, inside):
    for a, words, first in _tokens(column, hasher, inside):
        for r in range(len(first) - 1):
            yield a + r, words[first[r] : first[r + 1]], None


def _items(benchmark: DataFrame):
    """Distinct items with id and text, and their size in bytes."""
    b = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), lowered().alias("text")).distinct()
    return b, b.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, min_words: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Maximal spans shared by a document and a benchmark item: (doc_id, item_id, doc_start, item_start, n_words).

    Texts are lower-cased words (see textkit). Per window of ``w`` consecutive k-grams the rightmost minimal hash
    is kept on both sides; equal ones are extended to both sides. All spans of at least ``min_words`` (default and
    least value ``k + w - 1``) words are found. Positions count words from 0.

    The benchmark's size is measured: up to ``broadcast_bytes`` of text it goes to every task and no document text
    is shuffled; beyond that the fingerprints are joined by shuffle and hits extended after joins by id.

    Null or empty text and texts of fewer than ``min_words`` words share nothing; null ids are dropped. Repeated
    rows give a span once. Extra columns are ignored. Either table may be empty: the result is then empty.
    """
    least = max(min_words or 0, k + w - 1)
    d = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), lowered().alias("text"))
    b, size = _items(benchmark)
    if size <= broadcast_bytes:
        table = b.toArrow()
        bench = _Bench(table.column("item_id").to_numpy(), table.column("text"), k, w)
        shipped = docs.sparkSession.sparkContext.broadcast(bench)
        return d.mapInArrow(lambda batches: _mapper(shipped.value, k, w, least)(batches), SCHEMA).distinct()
    prints = "id long, at int, h long"
    ours = d.select(F.col("doc_id").alias("id"), "text").mapInArrow(_prints(k, w), prints)
    theirs = b.select(F.col("item_id").alias("id"), "text").mapInArrow(_prints(k, w), prints).toDF("item_id", "item_at", "h")
    hits = ours.join(theirs, "h").groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.collect_set(F.struct("at", "item_at")).alias("hits"))
    full = hits.join(d, "doc_id").join(b.withColumnRenamed("text", "item_text"), "item_id")
    return full.select("doc_id", "item_id", "hits", "text", "item_text").mapInArrow(_verify(k, least), SCHEMA).distinct()


def contaminated(spans: DataFrame, benchmark: DataFrame, min_words: int = LONG, min_share: float = SHARE) -> DataFrame:
    """Ids of documents that share a span of ``min_words`` words, or ``min_share`` of an item's words, with an item. Rows
    that repeat an item's id count by the longest; spans of unknown items by ``min_words`` alone."""
    words = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("_item"), F.size(F.regexp_extract_all(lowered(), F.lit(r"([0-9a-z\x{80}-\x{10FFFF}]+)"), 1)).alias("item_words"))
    held = spans.join(words.groupBy("_item").agg(F.max("item_words").alias("item_words")), spans["item_id"] == F.col("_item"), "left")
    return held.filter((F.col("n_words") >= min_words) | (F.col("n_words") >= min_share * F.col("item_words"))).select("doc_id").distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, min_words: int = LONG, min_share: float = SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs``, whole, that share no span of ``min_words`` words, nor ``min_share`` of an item's words, with
    the benchmark. Up to ``broadcast_bytes`` of benchmark text each row is judged where it is read, by its own text,
    whatever its id, and nothing is shuffled; beyond that rows without an id stay and those that share one go together.

    Rows without text stay. Rows that repeat an item's id count by the longest. Either table may be empty. Any columns."""
    b, size = _items(benchmark)
    if size > broadcast_bytes:
        found = contaminated(decontaminate(docs, benchmark, k, w, None, broadcast_bytes), benchmark, min_words, min_share)
        found = found.withColumnRenamed("doc_id", name := fresh(docs, "_found"))
        return docs.join(found, docs["doc_id"] == found[name], "left_anti")
    table = b.toArrow()
    bench = _Bench(table.column("item_id").to_numpy(), table.column("text"), k, w)
    longest = {}
    for item, n in zip(bench.ids.tolist(), np.diff(bench.first).tolist()):
        longest[item] = max(n, longest.get(item, 0))
    need = {item: min(min_words, min_share * n) for item, n in longest.items()}
    shipped = docs.sparkSession.sparkContext.broadcast((bench, need))
    schema, last = docs.schema, len(docs.columns)

    def run(batches):
        bench, need = shipped.value
        judge = _mapper(bench, k, w, k + w - 1)
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(last)], names=["doc_id", "text"])
            keep = np.ones(batch.num_rows, bool)
            for spans in judge([rows]):
                for row, item, n in zip(*(spans.column(c).to_pylist() for c in ("doc_id", "item_id", "n_words"))):
                    keep[row] &= n < need[item]
            yield batch.select(list(range(last))).filter(pa.array(keep))

    return docs.select("*", lowered().alias(fresh(docs, "_lowered"))).mapInArrow(run, schema)
