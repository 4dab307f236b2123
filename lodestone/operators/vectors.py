"""Nearest neighbours over (vec_id, doc_num, embedding): exact, clustered, binary and scalar-quantised."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators.terms import among, without

MAX_ROUNDS, OVERSAMPLE = 100, 4


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def _order(metric: str, *ties: str) -> list[Column]:
    return [F.col("score").asc() if scalars.ascending(metric) else F.col("score").desc(), *[F.col(t) for t in ties]]


def _best(metric: str, column: str = "score") -> Column:
    return (F.min if scalars.ascending(metric) else F.max)(column)


def scored(vectors: DataFrame, query: list[float], metric: str = "l2", exclude: DataFrame | None = None, eligible: DataFrame | None = None) -> DataFrame:
    """(vec_id, doc_num, score) of candidates. A query of another dimension, or empty, has none.

    ``exclude`` holds on the filtered path too, which the caller may count on."""
    v = among(without(vectors, exclude), eligible).filter(F.size("embedding") == len(query))
    if not query:
        v = v.filter(F.lit(False))
    return v.select("vec_id", "doc_num", scalars.score(metric, F.col("embedding"), vector(query)).alias("score"))


def nearest_vectors(candidates: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The k best vectors: a distributed top-k, ties by vec_id."""
    return candidates.orderBy(*_order(metric, "vec_id")).limit(k)


def knn_raw(candidates: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Documents of the first m vectors, each with its best score: (doc_num, score).

    m is the least multiple of k whose vectors cover k documents (or all vectors, or 100 k); up to 2k - 1 documents
    come back. At most 100 k vectors are ranked, after a distributed top-k.
    """
    top = nearest_vectors(candidates, MAX_ROUNDS * k, metric)
    rank = Window.orderBy(*_order(metric, "vec_id"))
    r = top.withColumn("rn", F.row_number().over(rank)).withColumn("is_first", (F.row_number().over(Window.partitionBy("doc_num").orderBy("rn")) == 1).cast("int"))
    r = r.withColumn("docs", F.sum("is_first").over(Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
    reach = r.agg(F.ceil(F.min(F.when(F.col("docs") >= k, F.col("rn"))) / k).alias("rounds"))
    kept = r.crossJoin(F.broadcast(reach)).filter(F.col("rounds").isNull() | (F.col("rn") <= F.col("rounds") * k))  # one row
    return kept.groupBy("doc_num").agg(_best(metric).alias("score"))


def knn_topk(candidates: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The k best documents by best vector: partial aggregation, then a distributed top-k."""
    return candidates.groupBy("doc_num").agg(_best(metric).alias("score")).orderBy(*_order(metric, "doc_num")).limit(k)


def roll_up(hits: DataFrame, nodes: DataFrame, metric: str = "l2") -> DataFrame:
    """Best score of each root document: (root_num, score)."""
    return hits.join(nodes.select("doc_num", "root_num"), "doc_num").groupBy("root_num").agg(_best(metric).alias("score"))


def knn_batch(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", block_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, vec_id, doc_num, score, rank) for a table (query_id, embedding) of queries.

    Queries are small or not: they are cut into blocks of at most ``block_bytes``; each block meets every partition of
    the vectors by tiles of at most TILE scores, and only the k best of a partition and query are shuffled. Tiles are
    products in single precision, whose error is bounded; what they leave in doubt is scored in double precision, value
    after value, so equal vectors have equal scores. The work is that of all pairs.
    """
    spark = vectors.sparkSession
    sizes = queries.agg(F.sum(F.size("embedding")).alias("n"), F.count("*").alias("rows")).first()
    blocks = max(1, -(-int(sizes["n"] or 0) * 8 // block_bytes))
    up = scalars.ascending(metric)
    schema = "query_id long, vec_id long, doc_num long, score double"
    against = vectors.select(F.col("vec_id").cast("long"), F.col("doc_num").cast("long"), "embedding")
    parts = None
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select(F.col("query_id").cast("long"), "embedding").toArrow().combine_chunks()
        if not len(own):
            continue
        asked = own.column("embedding").combine_chunks()
        at, q = dense_rows(asked, max(0, pa.compute.max(pa.compute.list_value_length(asked)).as_py() or 0))
        matrix = spark.sparkContext.broadcast((own.column("query_id").to_numpy()[at], q.astype(np.float32)))
        part = against.mapInArrow(_best_of(matrix, k, up), schema)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order(metric, "vec_id")))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Scores that a task of knn_batch holds at once, and pairs that it scores again at once.
TILE, AGAIN = 1 << 21, 1 << 15


def _best_of(matrix, k: int, up: bool):
    def run(batches):
        qid, q = matrix.value
        norm, dim = (q.astype(np.float64) ** 2).sum(1), q.shape[1]
        best = np.full((len(q), k), np.inf)  # keys: distances, or negative products
        best_vec, best_doc = np.full((len(q), k), np.iinfo(np.int64).max), np.zeros((len(q), k), np.int64)
        for batch in batches:
            rows, x = dense_rows(batch.column("embedding"), dim)
            if not len(rows) or not len(q):
                continue
            vec, doc = (np.asarray(batch.column(c))[rows] for c in ("vec_id", "doc_num"))
            for lo in range(0, len(x), 4096):
                y, v, d = x[lo : lo + 4096], vec[lo : lo + 4096], doc[lo : lo + 4096]
                single, length = y.astype(np.float32), (y**2).sum(1)
                high = max(1, TILE // len(y))
                for at in range(0, len(q), high):
                    own = slice(at, at + high)
                    s = q[own] @ single.T
                    s = (norm[own, None] - 2.0 * s + length[None]).astype(np.float32) if up else -s
                    # rounding of dim products and sums, twice for distances
                    doubt = 4 * (dim + 4) * 2.0**-24 * (norm[own] + length.max() if up else np.sqrt(norm[own] * length.max()))
                    limit = best[own, -1]
                    if np.isinf(limit).any() and len(y) > k:
                        limit = np.minimum(limit, np.partition(s, k - 1, axis=1)[:, k - 1] + doubt)
                    i, j = np.nonzero(s <= (limit + doubt)[:, None])
                    if not len(i):
                        continue
                    key = np.concatenate([_exact(q[at + i[z : z + AGAIN]], y[j[z : z + AGAIN]], up) for z in range(0, len(i), AGAIN)])
                    touched = np.unique(i)
                    all_i = np.concatenate((i, np.repeat(touched, k)))
                    all_key = np.concatenate((key, best[at + touched].ravel()))
                    all_vec, all_doc = np.concatenate((v[j], best_vec[at + touched].ravel())), np.concatenate((d[j], best_doc[at + touched].ravel()))
                    order = np.lexsort((all_vec, all_key, all_i))
                    starts = np.searchsorted(all_i[order], touched)
                    pick = order[(starts[:, None] + np.arange(k)).ravel()]
                    for kept, found in ((best, all_key), (best_vec, all_vec), (best_doc, all_doc)):
                        kept[at + touched] = found[pick].reshape(-1, k)
        at_q, at_k = np.nonzero(np.isfinite(best))
        for z in range(0, len(at_q), 1 << 16):
            a, c = at_q[z : z + (1 << 16)], at_k[z : z + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(best_vec[a, c]), pa.array(best_doc[a, c]), pa.array(best[a, c] if up else -best[a, c])], names=["query_id", "vec_id", "doc_num", "score"])

    return run


def _exact(a: np.ndarray, b: np.ndarray, up: bool) -> np.ndarray:
    """Keys of pairs of rows, summed value after value as scores are elsewhere."""
    a, out = a.astype(np.float64), np.zeros(len(a))
    for i in range(a.shape[1]):
        out += (a[:, i] - b[:, i]) ** 2 if up else a[:, i] * b[:, i]
    return out if up else -out


def mean_centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Deterministic centroids: component means of given groups. (centroid, embedding array<double>)"""
    e = vectors.select(F.col(by).cast("long").alias("centroid"), F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("centroid", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("centroid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def kmeans_centroids(vectors: DataFrame, k: int, seed: int = 1, iterations: int = 20) -> DataFrame:
    """Trained centroids by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="f").fit(vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("f")))
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "centroid long, embedding array<double>")


def assign(vectors: DataFrame, centroids: DataFrame, metric: str = "l2", block_bytes: int = 32 << 20) -> DataFrame:
    """Vectors with their nearest centroid, the first of equally near ones; null without a vector of the centroids'
    dimension. Centroids travel in measured blocks of at most ``block_bytes``, each one matrix product with a batch."""
    dim = centroids.select(F.max(F.size("embedding"))).first()[0] or 1
    total = centroids.count()
    a_block = max(1, block_bytes // (8 * dim))
    blocks = max(1, -(-total // a_block))
    best = (vectors.drop("centroid") if "centroid" in vectors.columns else vectors).withColumns({"centroid": F.lit(None).cast("long"), "_least": F.lit(None).cast("double")})
    up, context = scalars.ascending(metric), vectors.sparkSession.sparkContext
    bounds = [r["centroid"] for r in centroids.select("centroid").orderBy("centroid").toLocalIterator()][::a_block] if blocks > 1 else []
    for i in range(blocks):
        own = centroids if blocks == 1 else centroids.filter((F.col("centroid") >= bounds[i]) & (F.lit(True) if i + 1 == blocks else F.col("centroid") < bounds[i + 1]))
        rows = sorted((r["centroid"], r["embedding"]) for r in own.select("centroid", "embedding").collect())
        if not rows:
            continue
        shipped = context.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)))
        best = best.mapInArrow(_nearest(shipped, up), best.schema)
    return best.drop("_least")


def _nearest(shipped, up):
    def run(batches):
        ids, centers = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, x = dense_rows(batch.column("embedding"), centers.shape[1])
            found, least = batch.column("centroid").to_numpy(zero_copy_only=False).copy(), batch.column("_least").to_numpy(zero_copy_only=False).astype(np.float64)
            before = np.where(np.isnan(least), np.inf, least)
            chosen = np.array([None] * batch.num_rows, object) if found.dtype == object else np.array([None if f != f else int(f) for f in found.tolist()], object)
            for lo in range(0, len(rows), 1024):
                own, y = rows[lo : lo + 1024], x[lo : lo + 1024]
                d = -2 * (y @ centers.T) + (centers**2).sum(1)[None] + (y**2).sum(1)[:, None] if up else -(y @ centers.T)
                at = d.argmin(1)
                score = d[np.arange(len(own)), at]
                better = score < before[own]
                chosen[own[better]] = ids[at[better]]
                before[own[better]] = score[better]
            out = {"centroid": pa.array(chosen.tolist(), pa.int64()), "_least": pa.array(np.where(np.isinf(before), np.nan, before), pa.float64(), from_pandas=True)}
            yield pa.RecordBatch.from_arrays([out.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], schema=batch.schema)

    return run


def dense_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that hold ``dim`` values, and those as one matrix."""
    right = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), dim), False)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    return rows, column.filter(right).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)


def centroid_cardinalities(assigned: DataFrame, limit: int | None = None, largest: bool = True) -> DataFrame:
    """(centroid, n), optionally only the largest or smallest."""
    n = assigned.groupBy("centroid").agg(F.count("*").alias("n"))
    return n if limit is None else n.orderBy(F.col("n").desc() if largest else F.col("n").asc(), "centroid").limit(limit)


def eligible_counts(assigned: DataFrame, eligible: DataFrame) -> DataFrame:
    return among(assigned, eligible).groupBy("centroid").agg(F.count("*").alias("n"))


def probe_plan(assigned: DataFrame, centroids: DataFrame, query: list[float], k: int, eligible: DataFrame | None = None, probes: int | None = None, metric: str = "l2") -> DataFrame:
    """Clusters to visit: the nearest with eligible vectors, until they hold k of them and are at least ``probes``.

    (centroid, distance, n, place); one row a cluster, so the ordered running sum is small."""
    n = eligible_counts(assigned, eligible) if eligible is not None else centroid_cardinalities(assigned)
    probes = scalars.nprobe(centroids.count()) if probes is None else probes
    d = centroids.join(n, "centroid").select("centroid", scalars.score(metric, F.col("embedding"), vector(query)).alias("distance"), "n")
    order = Window.orderBy(F.col("distance").asc() if scalars.ascending(metric) else F.col("distance").desc(), "centroid")
    r = d.withColumn("place", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return r.filter((F.col("before") < k) | (F.col("place") <= probes)).select("centroid", "distance", "n", "place")


def grown(current: int, total: int) -> int:
    """Clusters visited in the next round, from the third on."""
    return min(total, current + max((total - current) // 2, 1))


def ivf_search(assigned: DataFrame, centroids: DataFrame, query: list[float], k: int, eligible: DataFrame | None = None, exclude: DataFrame | None = None, probes: int | None = None, metric: str = "l2") -> DataFrame:
    """k nearest vectors among the visited clusters: (vec_id, doc_num, score). For documents, see vector_index."""
    plan = probe_plan(assigned, centroids, query, k, eligible, probes, metric)
    near = assigned.join(F.broadcast(plan.select("centroid")), "centroid", "left_semi")  # at most nlist rows
    return nearest_vectors(scored(near, query, metric, exclude, eligible), k, metric)


def by_number(hits: DataFrame) -> DataFrame:
    """Hits in the order of document numbers, as a search returns them."""
    return hits.orderBy("doc_num")


def count_hits(hits: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Documents among hits, without excluded ones: (n)."""
    return without(hits, exclude).agg(F.countDistinct("doc_num").alias("n"))


def binary_search(vectors: DataFrame, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """Candidates by sign bits (4 k of least Hamming distance, ties by vec_id), ranked again by exact score."""
    h = vectors.filter(F.size("embedding") == len(query)).withColumn("hamming", scalars.hamming(F.col("embedding"), vector(query)))
    near = h.orderBy("hamming", "vec_id").limit(OVERSAMPLE * k)
    exact = near.select("vec_id", "doc_num", "hamming", scalars.score(metric, F.col("embedding"), vector(query)).alias("score"))
    return exact.orderBy(*_order(metric, "vec_id")).limit(k)


def train_sq(vectors: DataFrame, bits: int = 8) -> DataFrame:
    """One row: bounds of each component, (lows, steps)."""
    e = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    s = F.array_sort(F.collect_list(F.struct("i", "lo", ((F.col("hi") - F.col("lo")) / ((1 << bits) - 1)).alias("step"))))
    return e.agg(s.alias("s")).select(F.transform("s", lambda x: x["lo"]).alias("lows"), F.transform("s", lambda x: x["step"]).alias("steps"))


def sq_encode(vectors: DataFrame, trained: DataFrame) -> DataFrame:
    """Adds ``codes``: components rounded to steps."""
    code = F.transform("embedding", lambda x, i: F.when(F.get("steps", i) > 0, F.floor((x.cast("double") - F.get("lows", i)) / F.get("steps", i) + 0.5)).otherwise(0).cast("int"))
    return vectors.crossJoin(F.broadcast(trained)).withColumn("codes", code).drop("lows", "steps")


def sq_decode(coded: DataFrame, trained: DataFrame) -> DataFrame:
    """Adds ``restored``: components from their codes."""
    back = F.transform("codes", lambda c, i: F.get("lows", i) + c * F.get("steps", i))
    return coded.crossJoin(F.broadcast(trained)).withColumn("restored", back).drop("lows", "steps")


def random_rotation(dim: int, seed: int = 7) -> np.ndarray:
    """Orthogonal matrix for rotated binary codes."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def one_bit(rot: np.ndarray, centers: dict, q: np.ndarray, k: int):
    """Arrow batches (vec_id, doc_num, embedding, centroid) to (vec_id, doc_num, score), the k best of the batches
    among them: exact scores of the k best estimates set a limit, and of every vector whose lower bound is not above it.

    A residual's angles to its code and of the code to the query differ by at most the residual's angle to the query."""

    def run(batches):
        best = np.full(k, np.inf)
        for batch in batches:
            batch = batch.filter(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(batch.column("embedding")), len(q)), False))
            if not batch.num_rows or not k:
                continue
            c = np.array([centers[x] for x in batch.column("centroid").to_pylist()])
            o = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), len(q)) - c
            size = np.linalg.norm(o, axis=1)
            unit = o / np.maximum(size, 1e-12)[:, None] @ rot
            bits = np.where(unit > 0, 1.0, -1.0) / np.sqrt(len(q))
            align = np.maximum((bits * unit).sum(1), 1e-6)
            r = q[None] - c
            rn = np.linalg.norm(r, axis=1)
            seen = (bits * (r / np.maximum(rn, 1e-12)[:, None] @ rot)).sum(1)
            guess = size**2 + rn**2 - 2 * size * rn * seen / align
            most = np.cos(np.arccos(np.clip(align, -1, 1)) - np.arccos(np.clip(seen, -1, 1)))
            lower = size**2 + rn**2 - 2 * size * rn * most - 1e-6 * (size**2 + rn**2)
            score = np.full(len(c), np.inf)
            first = np.argpartition(guess, k - 1)[:k] if k < len(guess) else np.arange(len(guess))
            score[first] = ((o[first] - r[first]) ** 2).sum(1)
            limit = np.sort(np.concatenate((best, score[first])))[k - 1]
            rest = np.setdiff1d(np.flatnonzero(~(lower > limit)), first)
            score[rest] = ((o[rest] - r[rest]) ** 2).sum(1)
            known = np.concatenate((first, rest))
            best = np.sort(np.concatenate((best, score[known])))[:k]
            kept = pa.array(known[~(score[known] > best[-1])])  # ties come along, vec_id decides later
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(kept), batch.column("doc_num").take(kept), pa.array(score[kept.to_numpy()])], names=["vec_id", "doc_num", "score"])

    return run


def rabitq_search(assigned: DataFrame, centroids: DataFrame, query: list[float], k: int, seed: int = 7) -> DataFrame:
    """k nearest by L2 from one-bit codes of rotated residuals (RaBitQ, Gao and Long 2024): the unbiased estimate tells
    which exact scores come first, a bound that always holds which others are needed. The rows are those of exact search."""
    rot = random_rotation(len(query), seed)
    centers = {r["centroid"]: np.array(r["embedding"]) for r in centroids.collect()}  # nlist rows
    shipped = assigned.sparkSession.sparkContext.broadcast((rot, centers, np.array(query, np.float64)))

    def search(batches):
        yield from one_bit(*shipped.value, k)(batches)

    got = assigned.select(F.col("vec_id").cast("long"), F.col("doc_num").cast("long"), "embedding", "centroid").mapInArrow(search, "vec_id long, doc_num long, score double")
    return got.orderBy("score", "vec_id").limit(k)


def stats(vectors: DataFrame) -> DataFrame:
    """(field, n_vectors, n_docs, dim)"""
    return vectors.groupBy("field").agg(F.count("*").alias("n_vectors"), F.countDistinct("doc_num").alias("n_docs"), F.max(F.size("embedding")).alias("dim"))


def reconstruct(vectors: DataFrame, ids: list[int]) -> DataFrame:
    return vectors.filter(F.col("vec_id").isin(ids)).select("vec_id", "embedding")
