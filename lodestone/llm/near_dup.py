"""6. Near duplicates by SetSketch: banded registers, joint likelihood estimate, exact verification.

A register holds ``1 - floor(log_b x)`` of the smallest of a document's exponential variates x, cut to 16 bits:
registers of a union are the maxima of the parts' registers, and they agree with a probability close to the
Jaccard similarity (Ertl, SetSketch, 2021). Sets are hashed shingles of three words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.textkit import Hasher, cut, fresh, grams, lowered, mixed, multipliers, nonempty_reduce, parts, runs, signed, word_bytes

SHINGLE, BANDS, ROWS, THRESHOLD, MARGIN = 3, 32, 4, 0.5, 0.1
BASE, RATE, TOP = 1.001, 20.0, 65535
MEMBERS_A_TASK, MEMBERS_A_BUCKET, WANTED, GONE = 4096, 1 << 16, 1 << 18, 1 << 20


def shingles(data, offsets, hasher, inside, k=SHINGLE):
    """Hashes of the shingles of a chunk and each document's bounds; documents under k words have one shingle."""
    starts, ends, owner = runs(inside[data], offsets)
    words = hasher(data, starts, ends)
    n_docs = len(offsets) - 1
    first = np.searchsorted(owner, np.arange(n_docs + 1))
    n_words = np.diff(first)
    sizes = np.maximum(n_words - (k - 1), (n_words > 0).astype(n_words.dtype))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    index = np.repeat(first[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
    out = grams(padded, k)[index]
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        alone = np.zeros(k, np.uint64)
        alone[: n_words[d]] = words[first[d] : first[d + 1]]
        out[bounds[d]] = grams(alone, k)[0]
    return out, bounds


def registers(hashes, bounds, m=BANDS * ROWS):
    """uint16 registers (documents x m) of hashed sets."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    factors = (multipliers(m, 11) >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
    least = np.full((m, len(bounds) - 1), 2**32 - 1, np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        at, buffer = bounds[:-1][full], np.empty_like(h)
        for i in range(m):
            np.multiply(h, factors[i], out=buffer)
            least[i, full] = np.minimum.reduceat(buffer, at)
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def cardinality(regs):
    m = regs.shape[1]
    return m * (1 - 1 / BASE) / (RATE * np.log(BASE) * np.sum(np.power(BASE, -regs.astype(np.float64)), axis=1))


def joint_jaccard(a, b):
    """Maximum-likelihood Jaccard of row pairs from the counts of larger, smaller and equal registers."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    na, nb = cardinality(a), cardinality(b)
    u, v = na / (na + nb), nb / (na + nb)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(32):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(x) > likelihood(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def _sketch(batches):
    hasher, inside = Hasher(), word_bytes()
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("key")
        for a, b, data, offsets in parts(batch.column("text")):
            h, bounds = shingles(data, offsets, hasher, inside)
            some = np.diff(bounds) > 0
            total = nonempty_reduce(np.add, h, bounds, 0)
            other = nonempty_reduce(np.bitwise_xor, mixed(h + np.uint64(1)), bounds, 0)
            regs = registers(h, bounds)
            out = pa.RecordBatch.from_arrays(
                [keys.slice(a, b - a), ids.slice(a, b - a), pa.array(np.diff(bounds)), pa.array(signed(total)), pa.array(signed(other)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(regs.shape[1] * 2), b - a, [None, pa.py_buffer(regs.tobytes())]).cast(pa.binary())],
                names=["key", "doc_id", "n", "s", "x", "regs"],
            )
            yield out.filter(pa.array(some))


def _matrix(column):
    data, _ = _flat(column)
    return data.view(np.uint16).reshape(len(column), -1)


def _flat(column):
    from lodestone.llm.textkit import flat

    data, offsets = flat(column)
    return np.ascontiguousarray(data), offsets


def _bands(bands, rows):
    def run(batches):
        salt = multipliers(bands, 13)
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _matrix(batch.column("regs"))
            for i in range(bands):
                key = mixed(regs[:, i * rows : (i + 1) * rows].astype(np.uint64) @ multipliers(rows, 17) + salt[i])
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), batch.column("doc_id")], names=["key", "doc_id"])

    return run


def _buckets(most):
    """Sorted (key, doc_id) to buckets of at least two: (key, part, n, sign, members); equal member sets get an equal
    sign. A bucket of more than ``most`` members comes in parts, so that no row or task holds a hot one whole."""

    def pack(key, part, doc, at):
        marks = mixed(doc.view(np.uint64))
        sign = np.add.reduceat(marks, at[:-1]) ^ mixed(np.bitwise_xor.reduceat(marks, at[:-1]))
        members = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(doc))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(part, pa.int32()), pa.array(np.diff(at).astype(np.int64)), pa.array(signed(sign)), members], names=["key", "part", "n", "sign", "members"])

    def complete(key, doc, part):
        """Buckets of whole keys; of the first key ``part`` parts are out already."""
        at = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        sizes = np.diff(at)
        split = sizes > most
        split[0] |= part > 0
        for g in np.flatnonzero(split):
            for i in range(at[g], at[g + 1], most):
                piece = doc[i : min(at[g + 1], i + most)]
                yield pack(key[i : i + 1], [part], piece, np.array([0, len(piece)]))
                part += 1
            part = 0
        many = np.flatnonzero((sizes > 1) & ~split)
        if len(many):
            n = sizes[many]
            bounds = np.concatenate(([0], np.cumsum(n)))
            take = np.repeat(at[:-1][many] - bounds[:-1], n) + np.arange(bounds[-1])
            yield pack(key[at[:-1][many]], np.zeros(len(many), np.int32), doc[take], bounds)

    def run(batches):
        key, doc, part = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = np.concatenate((key, np.asarray(batch.column("key")))), np.concatenate((doc, np.asarray(batch.column("doc_id"))))
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:
                yield from complete(key[:last], doc[:last], part)
                key, doc, part = key[last:], doc[last:], 0
            while len(key) > most:
                yield pack(key[:1], [part], doc[:most], np.array([0, most]))
                key, doc, part = key[most:], doc[most:], part + 1
        if len(key):
            yield from complete(key, doc, part)

    return run


def _grouped(batches, column):
    """Rows sorted by a column, as concatenated tables that never split a value."""
    waiting = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(column))
        if waiting and waiting[-1].column(column)[-1].as_py() == key[-1] and key[0] == key[-1]:
            waiting.append(batch)
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        whole = [*waiting, batch.slice(0, last)] if last else waiting
        if last or (waiting and waiting[-1].column(column)[-1].as_py() != key[0]):
            yield pa.Table.from_batches(whole).combine_chunks()
            waiting = [batch.slice(last)]
        else:
            waiting = [*waiting, batch]
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _meet(regs, root, least, patience):
    """Pairs of one bucket (of unequal root, with an estimate of at least ``least``) and its open members.

    Leaders are compared with every member of another root that has not led. A member waits to lead until ``patience``
    leaders have reached it; then it stays open: no pair of two open members was compared. Roots with few members
    lead first, so that a large group and a few strangers cost what the strangers do."""
    _, group, sizes = np.unique(root, return_inverse=True, return_counts=True)
    order = np.argsort(sizes[group], kind="stable")
    group, back = group[order], order
    done, met = np.zeros(len(root), bool), np.zeros(len(root), np.int64)
    ones, twos = [], []
    while (waiting := ~done & (met < patience)).any():
        lead = int(np.argmax(waiting))
        own = ~done & (group == group[lead])
        others = np.flatnonzero(~done & ~own)
        if not len(others):
            done |= own
            continue
        if len(others) < own.sum():
            lead = int(others[0])
            others = np.flatnonzero(~done & (group != group[lead]))
        done[lead] = True
        for i in range(0, len(others), 4096):
            x = others[i : i + 4096]
            rows = regs[back[x]]
            near = x[joint_jaccard(rows, np.broadcast_to(regs[back[lead]], rows.shape)) >= least]
            met[near] += 1
            ones.append(np.full(len(near), back[lead]))
            twos.append(back[near])
    rest = np.flatnonzero(~done)
    rest = rest if len(rest) and (group[rest] != group[rest[0]]).any() else rest[:0]
    return [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (ones, twos)] + [back[rest]]


def _leaders(least, patience):
    """Rows sorted by bucket, turn: candidate pairs (a, b, null), and open members (doc_id, null, bucket)."""

    def run(batches):
        for rows in _grouped(batches, "bucket"):
            bucket, doc, root = (rows.column(c).to_numpy() for c in ("bucket", "doc_id", "root"))
            regs = _matrix(rows.column("regs"))
            at = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
            ones, twos, open_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            two = at[:-1][np.diff(at) == 2]
            for i in range(0, len(two), 4096):
                x = two[i : i + 4096]
                good = x[joint_jaccard(regs[x], regs[x + 1]) >= least]
                ones.append(good)
                twos.append(good + 1)
            for lo, hi in zip(at[:-1], at[1:]):
                if hi - lo > 2:
                    for found, out in zip(_meet(regs[lo:hi], root[lo:hi], least, patience), (ones, twos, open_)):
                        out.append(lo + found)
            one, two, rest = (np.concatenate(x) for x in (ones, twos, open_))
            a, b = np.minimum(doc[one], doc[two]), np.maximum(doc[one], doc[two])
            for cells in ((pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())), (pa.array(doc[rest], pa.int64()), pa.nulls(len(rest), pa.int64()), pa.array(bucket[rest], pa.int64()))):
                yield pa.RecordBatch.from_arrays(list(cells), names=["a", "b", "bucket"])

    return run


def _verify(least):
    """Rows (lead, salt, own, doc_id, text) sorted so that each leader's text precedes its members'."""

    def run(batches):
        hasher, inside = Hasher(), word_bytes()
        lead, mine = None, None
        for batch in batches:
            leads, salts, own, ids = (batch.column(c).to_pylist() for c in ("lead", "salt", "own", "doc_id"))
            a_out, b_out, j_out = [], [], []
            for a, _b, data, offsets in parts(batch.column("text")):
                h, bounds = shingles(data, offsets, hasher, inside)
                for i in range(len(bounds) - 1):
                    r, s = a + i, np.unique(h[bounds[i] : bounds[i + 1]])
                    if own[r]:
                        lead, mine = (leads[r], salts[r]), s
                    elif lead == (leads[r], salts[r]):
                        both = len(np.intersect1d(mine, s, assume_unique=True))
                        j = both / max(1, len(mine) + len(s) - both)
                        if j >= least:
                            a_out.append(leads[r])
                            b_out.append(ids[r])
                            j_out.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(j_out, pa.float64())], names=["a", "b", "jaccard"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): ``key`` tells rows apart by id and lower-cased text, so ids that clash are not mixed up."""
    d = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), lowered().alias("text"))
    return d.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def sketches(docs: DataFrame) -> DataFrame:
    return keyed(docs).mapInArrow(_sketch, "key long, doc_id long, n long, s long, x long, regs binary")


def verified(docs: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of distinct candidate pairs (a, b) of keys whose whole texts pass: (a, b, jaccard)."""
    heat = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_A_TASK).cast("int").alias("salts"))
    leads = heat.select(F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("own"), F.col("a").alias("key"))
    members = pairs.join(heat, "a").select(F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.col("salts").cast("long")).cast("int").alias("salt"), F.lit(False).alias("own"), F.col("b").alias("key"))
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    texts = keyed(docs).drop("doc_id")
    if wanted.limit(WANTED + 1).count() <= WANTED:  # else the join by shuffle alone selects them
        texts = texts.join(F.broadcast(wanted), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))  # rows that repeat meet before the shuffle
    full = leads.unionByName(members).join(texts, "key").withColumnRenamed("key", "doc_id")
    ordered = full.repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.desc("own"), "doc_id")
    return ordered.select("lead", "salt", "own", "doc_id", "text").mapInArrow(_verify(threshold), "a long, b long, jaccard double")


def linked(docs: DataFrame, reps: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, most: int = MEMBERS_A_BUCKET) -> DataFrame:
    """(node, root) of representatives (doc_id is their key) that meet in a band and pass the estimate and the exact
    comparison.

    Rounds: only exact links make members of a bucket skip each other for good. Members that are open after a round and
    not of one component then meet again, with four times the patience, until no bucket has such members. A bucket of
    more than ``most`` members is settled part by part; then each part meets the next one, and at last all others, as
    far as they are not of one component yet."""
    band = reps.select("doc_id", "regs").mapInArrow(_bands(bands, rows), "key long, doc_id long")
    found = cut(band.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_buckets(most), "key long, part int, n long, sign long, members array<long>"))
    # two documents meet in many bands: buckets with the same members are one bucket
    buckets = found.groupBy("n", "sign").agg(F.min_by("members", "key").alias("members"), F.min("key").alias("bucket"))
    roots, tried = _settled(docs, reps, buckets.select("bucket", F.explode("members").alias("doc_id")), None, None, threshold)
    split = found.filter("part > 0").select("key").distinct()
    if split.isEmpty():
        return roots
    parts_ = found.join(split, "key", "left_semi").select("key", "part", "members")
    ends = parts_.groupBy("key").agg(F.max("part").alias("last"))
    pairs = parts_.select("key", "part").join(ends, "key").filter("part < last").select("key", F.col("part").alias("one"), F.explode(F.sequence(F.col("part") + 1, F.col("last"))).alias("two"))
    sides = pairs.select("key", "one", "two", F.explode(F.array("one", "two")).alias("part"))
    crossed = sides.join(parts_, ["key", "part"]).select(F.xxhash64("key", "one", "two").alias("bucket"), (F.col("two") - F.col("one")).alias("step"), F.explode("members").alias("doc_id"))
    for stage in ("step = 1", "step > 1"):
        roots, tried = _settled(docs, reps, crossed.filter(stage).drop("step"), roots, tried, threshold)
    return roots


def _settled(docs, reps, seats, roots, tried, threshold):
    """Components after all pairs of each bucket (bucket, doc_id) were compared or found to be of one component, and the
    pairs that were verified so far."""
    patience = 1
    seats = seats.withColumn("root", F.col("doc_id")) if roots is None else cut(_live(seats, roots))
    while roots is None or not seats.isEmpty():
        seated = seats.join(reps.select("doc_id", "regs"), "doc_id").withColumn("turn", F.xxhash64("doc_id", "bucket"))
        met = cut(seated.repartition("bucket").sortWithinPartitions("bucket", "turn").select("bucket", "doc_id", "root", "regs").mapInArrow(_leaders(threshold - MARGIN, patience), "a long, b long, bucket long"))
        pairs = met.filter("bucket is null").select("a", "b").distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        links = verified(docs, pairs, threshold).select("a", "b")
        roots = components(links if roots is None else links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        seats = cut(_live(met.filter("bucket is not null").select("bucket", F.col("a").alias("doc_id")), roots))
        patience *= 4
    return roots, tried


def _live(seats, roots):
    """Seats (bucket, doc_id, root) in buckets whose members are not all of one component."""
    now = seats.join(roots, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    live = now.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("bucket")
    return now.join(live, "bucket", "left_semi")


def _groups(docs, threshold, bands, rows, most):
    """(key, doc_id, first, exact): members of groups; ``first`` is the struct (doc_id, key) of the one to keep."""
    sk = cut(sketches(docs).dropDuplicates(["key", "n", "s", "x"]))
    same = sk.groupBy("n", "s", "x").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("regs").alias("regs"), F.count("*").alias("copies"))
    reps = cut(same)
    roots = linked(docs, reps.select(F.col("first.key").alias("doc_id"), "regs"), threshold, bands, rows, most)
    kept = reps.select("n", "s", "x", "first", "copies").join(roots, F.col("first.key") == F.col("node"), "left").filter("copies > 1 or root is not null")
    kept = kept.withColumn("root", F.coalesce("root", "first.key"))
    best = kept.groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.drop("first").join(best, "root").select("n", "s", "x", "first", (F.col("copies") > 1).alias("exact"))
    return sk.select("key", "doc_id", "n", "s", "x").join(kept, ["n", "s", "x"]).select("key", "doc_id", "first", "exact")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, most: int = MEMBERS_A_BUCKET) -> DataFrame:
    """Groups of near duplicates: (doc_id, keep_id, exact) for every document of a group of two or more.

    Similarity is the Jaccard index of sets of three lower-cased words; a group is a connected component of pairs
    at or above ``threshold``; ``keep_id`` is its smallest doc_id; ``exact`` tells that the document has the same
    words as one with a smaller id or, for the smallest of them, that it has such a copy. Copies with equal words
    are folded before the search; of the rest every document is a query. Pairs of a band bucket are left out only if
    exact links already connect them, or if their estimate is below ``threshold - MARGIN``; all pairs that are linked
    were verified on whole texts. A task holds the registers of two parts of a bucket, of ``most`` members each.

    Null or empty text and texts without a word are in no group. Texts under three words are one shingle. Null ids
    are dropped; rows that repeat id and text count once; rows of one id with different texts are documents of their own,
    told under that id. Extra columns are ignored. An empty table gives no rows.
    """
    return _groups(docs, threshold, bands, rows, most).select("doc_id", F.col("first.doc_id").alias("keep_id"), "exact")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """Rows of documents in no group, and each group's document of the smallest id (of rows that share this id, one
    text). Rows without id, text or word stay; rows that repeat id and text stay or go together. Any columns are kept.

    The keys of those that go are counted: up to ``GONE`` they are broadcast, beyond that the join shuffles."""
    groups = _groups(docs, **({"threshold": THRESHOLD, "bands": BANDS, "rows": ROWS, "most": MEMBERS_A_BUCKET} | how))
    gone = cut(groups.filter(F.col("key") != F.col("first.key")).select(F.col("key").alias(name := fresh(docs, "_gone"))))
    few = gone.limit(GONE + 1).count() <= GONE
    own = F.when(docs["doc_id"].isNotNull() & docs["text"].isNotNull(), F.xxhash64(docs["doc_id"].cast("long"), F.lower(docs["text"])))
    return docs.join(F.broadcast(gone) if few else gone, own == gone[name], "left_anti")
