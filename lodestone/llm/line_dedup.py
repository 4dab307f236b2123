"""4. Line dedup: first occurrences by range-partitioned hashes, kept as run-length bitmaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.textkit import cut, fresh

BROADCAST_BYTES = 32 << 20
SCHEMA = "doc_id long, n_lines long, n_kept long, keep binary"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with anything in them as 128 bits of hash, and the first one of each text: (doc_id, pos, h1, h2, n_lines).
    A blank line has no hash; n_lines is given with position 0."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.split(F.col(text_col), "\n", -1).alias("parts"))
    each = d.select("doc_id", F.size("parts").cast("long").alias("n"), F.posexplode("parts").alias("pos", "line")).select("doc_id", "n", "pos", F.btrim("line", F.lit(" \t\r")).alias("line"))
    some = F.col("line") != ""
    hashed = each.select("doc_id", "pos", F.when(some, F.xxhash64("line")).alias("h1"), F.when(some, F.xxhash64(F.lit("second"), F.col("line"))).alias("h2"), F.when(F.col("pos") == 0, F.col("n")).alias("n_lines"))
    return hashed.filter("h1 is not null or pos = 0")


def _first_occurrences(batches):
    """Rows sorted by (h1, h2, doc_id, pos). edge marks what only its neighbours can decide: the first
    row of the partition and the first row of its last hash."""
    held, previous, head, kept = None, None, True, False
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("keep", pa.bool_()), ("edge", pa.bool_())])

    def emit(doc, pos, a, b, keep, edge):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keep, pa.bool_()), pa.array(edge, pa.bool_())], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        doc, pos, a, b = (np.asarray(batch.column(c)) for c in ("doc_id", "pos", "h1", "h2"))
        new, other = np.empty(len(a), bool), np.empty(len(a), bool)
        new[0] = previous is None or (a[0], b[0]) != previous[:2]
        other[0] = previous is None or (a[0], b[0], doc[0], pos[0]) != previous
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        other[1:] = new[1:] | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
        previous = (a[-1], b[-1], doc[-1], pos[-1])
        origin = np.maximum.accumulate(np.where(other, np.arange(len(a)), -1))  # a repeated row shares its original's fate
        keep = np.where(origin >= 0, new[origin], kept)
        kept = bool(keep[-1])
        edge = np.zeros(len(a), bool)
        edge[0], head = head, False
        starts = np.flatnonzero(new)
        if len(starts):  # the newest hash's first row waits, as it may be the partition's last hash
            if held is not None:
                yield emit(*held)
            i = starts[-1]
            held = tuple(x[i : i + 1] for x in (doc, pos, a, b, keep, edge))
            rest = np.ones(len(a), bool)
            rest[i] = False
            doc, pos, a, b, keep, edge = (x[rest] for x in (doc, pos, a, b, keep, edge))
        if len(doc):
            yield emit(doc, pos, a, b, keep, edge)
    if held is not None:
        yield emit(*held[:5], np.ones(1, bool))


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode_keep(n_lines: int, dropped) -> bytes:
    """Keep bitmap as run lengths, kept first, then dropped, kept, ...: each a little-endian base-128 integer."""
    out, at, i, dropped = [], 0, 0, sorted(dropped)
    while i < len(dropped):
        j = i
        while j + 1 < len(dropped) and dropped[j + 1] == dropped[j] + 1:
            j += 1
        out += [varint(dropped[i] - at), varint(j - i + 1)]
        at, i = dropped[j] + 1, j + 1
    if at < n_lines:
        out.append(varint(n_lines - at))
    return b"".join(out)


def decode_keep(keep: bytes) -> list[bool]:
    out, n, shift, kept = [], 0, 0, True
    for byte in keep:
        n |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out += [kept] * n
            n, shift, kept = 0, 0, not kept
    return out


def _bitmaps(batches):
    for batch in batches:
        n, dropped = batch.column("n_lines").to_pylist(), batch.column("dropped").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array([a - len(d) for a, d in zip(n, dropped)], pa.int64()), pa.array([encode_keep(a, d) for a, d in zip(n, dropped)], pa.binary())],
            names=["doc_id", "n_lines", "n_kept", "keep"],
        )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: (doc_id, n_lines, n_kept, keep).

    A line, without surrounding blanks, is kept where (doc_id, position) is smallest among its equals over
    the whole corpus; blank lines are always kept. ``keep`` holds one bit a line as run lengths
    (:func:`encode_keep`). Lines are range-partitioned by (hash, doc_id, position), so even a line that is
    everywhere spreads over partitions; the few rows at partition borders are settled by a second, tiny step.

    Null text: no row. Empty text: one blank line, kept. A null id is dropped. Rows that repeat an id are
    one document: equal lines at the same position count once, the number of lines is the largest.
    Extra columns are ignored.
    """
    every = cut(lines(docs.filter(F.col(id_col).isNotNull()), id_col, text_col))  # the text is read and split once
    streamed = cut(
        every.filter("h1 is not null")
        .drop("n_lines")
        .repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc_id"), F.col("pos"))
        .sortWithinPartitions("h1", "h2", "doc_id", "pos")
        .mapInArrow(_first_occurrences, "doc_id long, pos int, h1 long, h2 long, keep boolean, edge boolean")
    )
    later = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos"))
    edges = streamed.filter("edge and keep").withColumn("first", F.min(F.struct("doc_id", "pos")).over(Window.partitionBy("h1", "h2")))
    dropped = streamed.filter("not keep").select("doc_id", "pos").unionByName(edges.filter(later).select("doc_id", "pos"))
    counts = every.filter("pos = 0").groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"))
    per_doc = dropped.groupBy("doc_id").agg(F.collect_set("pos").alias("dropped"))
    return counts.join(per_doc, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")).mapInArrow(_bitmaps, SCHEMA)


def _apply(text_at, keep_name):
    def run(batches):
        for batch in batches:
            texts, keeps = batch.column(text_at).to_pylist(), batch.column(keep_name).to_pylist()
            out = [t if t is None or k is None else "\n".join(line for line, keep in zip(t.split("\n"), decode_keep(k)) if keep) for t, k in zip(texts, keeps)]
            yield batch.set_column(text_at, "text", pa.array(out, pa.string())).drop_columns([keep_name])

    return run


def apply_keep(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents with only their kept lines; one that lost lines and has nothing but blanks left goes.

    ``n_chars`` follows the new text. Documents that lost nothing pass unchanged, those without an id or a text among
    them. Rows that share an id lose the same positions. Extra columns are kept, whatever their names. The bitmaps of
    changed documents are measured: up to ``BROADCAST_BYTES`` they are broadcast, beyond that the join shuffles.
    """
    keep, doc, touched = (fresh(docs, n) for n in ("_keep", "_doc", "_touched"))
    changed = cut(bitmaps.filter("n_kept < n_lines").select(F.col("doc_id").alias(doc), F.col("keep").alias(keep)))
    size = changed.agg(F.sum(F.octet_length(keep) + 48)).first()[0] or 0
    joined = docs.join(F.broadcast(changed) if size <= BROADCAST_BYTES else changed, docs["doc_id"] == changed[doc], "left").drop(doc)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{touched}` boolean"
    out = joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(keep).isNotNull().alias(touched), keep).mapInArrow(_apply(docs.columns.index("text"), keep), fields)
    out = out.filter(~F.col(touched) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(touched), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
