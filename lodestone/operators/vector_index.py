"""Vector indexes of segments: chosen by size and goal, trained, stored with the segment, searched by documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import vectors as ops
from lodestone.operators.terms import among, without
from lodestone.session import materialise
from lodestone.sources.segment import SCHEMAS, Segment

#: Rounds before a filtered search visits more clusters.
STEADY_ROUNDS = 2


@dataclass
class VectorIndex:
    """A field's vectors with what their kind of index needs. ``kind``: flat, ivf_N_flat, ivf_N_sq8, ivf_N_sq4,
    ivf_N_rabitq, binary_flat, binary_sq8, ivf_N_binary_flat or ivf_N_binary_sq8 (N clusters)."""

    field: str
    kind: str
    metric: str
    vectors: DataFrame
    centroids: DataFrame | None = None
    bounds: DataFrame | None = None
    optimise: str = "recall"

    @property
    def clustered(self) -> bool:
        return self.kind.startswith("ivf_")

    @property
    def coding(self) -> str:
        return self.kind.split("_", 2)[2] if self.clustered else self.kind

    def candidates(self, rows: DataFrame, query: list[float]) -> DataFrame:
        """(vec_id, doc_num, score): of quantised vectors the score of what their codes restore."""
        if self.coding in ("sq8", "sq4"):
            rows = ops.sq_decode(rows, self.bounds).drop("embedding").withColumnRenamed("restored", "embedding")
        if not query:
            rows = rows.filter(F.lit(False))
        asked = F.array(*[F.lit(float(x)) for x in query]) if self.coding in ("sq8", "sq4") else ops.vector(query)
        return rows.filter(F.size("embedding") == len(query)).select("vec_id", "doc_num", scalars.score(self.metric, F.col("embedding"), asked).alias("score"))

    def plan(self, query: list[float], k: int, eligible: DataFrame | None = None, probes: int | None = None) -> list[int]:
        """All clusters with eligible vectors, nearest first, and how many of them a search visits at least."""
        n = ops.eligible_counts(self.vectors, eligible) if eligible is not None else ops.centroid_cardinalities(self.vectors)
        probes = scalars.nprobe(int(self.kind.split("_")[1]), self.optimise == "latency") if probes is None else probes
        near = _hamming(self.centroids, query) if self.coding.startswith("binary") else self.centroids.withColumn("distance", scalars.score(self.metric, F.col("embedding"), ops.vector(query)))
        least = scalars.ascending(self.metric) or self.coding.startswith("binary")
        rows = near.join(n, "centroid").select("centroid", "distance", "n").orderBy(F.col("distance").asc() if least else F.col("distance").desc(), "centroid").collect()  # nlist at most
        held, first = 0, 0
        while first < len(rows) and (held < k or first < probes):
            held, first = held + rows[first]["n"], first + 1
        return [r["centroid"] for r in rows], first

    def search(self, query: list[float], k: int, eligible: DataFrame | None = None, exclude: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """(doc_num, score) of documents by their best vector, in the order of doc_num: rounds of the k best vectors not
        seen yet, until k documents are found, fewer than k vectors are left or 100 rounds were made.

        A clustered index visits the nearest clusters that hold k vectors and are at least ``probes``; a filtered search
        (``eligible``) visits more from the third round on. Each step reads the folders of new clusters only, and the
        driver holds at most 100 k candidates of a step. One-bit (rabitq) indexes are exact, binary ones rank the least
        Hamming distances (4 k of them without clusters) by exact scores. No documents: no rows."""
        rows = among(without(self.vectors, exclude), eligible)
        if self.coding.startswith("binary") and not self.clustered:
            found = ops.binary_search(rows, query, k, self.metric)
            return ops.by_number(found.groupBy("doc_num").agg(ops._best(self.metric).alias("score")))
        if self.coding == "rabitq" and scalars.ascending(self.metric):
            found = ops.rabitq_search(rows, self.centroids, query, ops.MAX_ROUNDS * k)
            return ops.by_number(ops.knn_raw(found, k, self.metric))
        if not self.clustered:
            return ops.by_number(ops.knn_raw(self.candidates(rows, query), k, self.metric))
        return self._visit(rows, query, k, eligible, probes)

    def _visit(self, rows, query, k, eligible, probes):
        order, visited = self.plan(query, k, eligible, probes)
        sign = 1 if scalars.ascending(self.metric) else -1
        pool, best, done, rounds, reach = [], {}, visited == 0, 0, 0
        while not done and rounds < ops.MAX_ROUNDS:
            if reach < visited:
                own = rows.filter(F.col("centroid").isin(order[reach:visited]))
                if self.coding.startswith("binary"):
                    own = _hamming(own.filter(F.size("embedding") == len(query)), query).orderBy("distance", "vec_id").limit(ops.MAX_ROUNDS * k)
                    near = own.select("vec_id", "doc_num", "distance", scalars.score(self.metric, F.col("embedding"), ops.vector(query)).alias("score")).collect()
                    pool += [((r["distance"], r["vec_id"]), r["doc_num"], r["score"]) for r in near]
                else:
                    near = ops.nearest_vectors(self.candidates(own, query), ops.MAX_ROUNDS * k, self.metric).collect()
                    pool += [((sign * r["score"], r["vec_id"]), r["doc_num"], r["score"]) for r in near]
                pool.sort()
                reach = visited
            taken, pool = pool[:k], pool[k:]
            rounds += 1
            for _, doc, score in taken:
                best[doc] = score if doc not in best else min(best[doc], score) if sign > 0 else max(best[doc], score)
            done = len(taken) < k or len(best) >= k
            if eligible is not None and rounds >= STEADY_ROUNDS:
                visited = ops.grown(visited, len(order))
        return ops.by_number(rows.sparkSession.createDataFrame(list(best.items()), "doc_num long, score double"))

    def reconstruct(self, ids: list[int]) -> DataFrame:
        return ops.reconstruct(self.vectors, ids)

    def close(self) -> None:
        self.vectors.unpersist()


def _hamming(rows: DataFrame, query: list[float]) -> DataFrame:
    return rows.withColumn("distance", scalars.hamming(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))


def build(vectors: DataFrame, field: str, optimise: str = "recall", metric: str = "l2", template: DataFrame | None = None, clusters: int | None = None) -> VectorIndex:
    """Index of (vec_id, doc_num, embedding). Its kind follows from the number of vectors and the goal. ``template``:
    trained centroids to assign to, instead of training new ones; ``clusters`` overrides their number."""
    own = vectors.select("vec_id", "doc_num", "embedding")
    n = own.count()
    kind = scalars.choose_index(n, optimise)
    if clusters and not kind.startswith("ivf_"):
        kind = f"ivf_{clusters}_{kind if kind != 'flat' or optimise in ('recall', 'latency') else 'flat'}"
    elif clusters:
        kind = f"ivf_{clusters}_" + kind.split("_", 2)[2]
    centroids, bounds, metric = None, None, "ip" if metric == "cosine" else metric
    if kind.startswith("ivf_"):
        centroids = template if template is not None else ops.kmeans_centroids(own, int(kind.split("_")[1]))
        own = _by_sign(own, centroids) if "binary" in kind else ops.assign(own, centroids, metric)
    if kind.endswith(("_sq8", "_sq4")) and "binary" not in kind:
        bounds = ops.train_sq(own, 8 if kind.endswith("8") else 4)
        own = ops.sq_encode(own, bounds)
    return VectorIndex(field, kind, metric, own, centroids, bounds, optimise)


def _by_sign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Vectors with the centroid that differs in the fewest signs, the first of equals."""
    sign = lambda c: F.transform(c, lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
    signs = vectors.withColumn("_own", F.col("embedding")).withColumn("embedding", sign(F.col("embedding")))
    near = ops.assign(signs, centroids.withColumn("embedding", sign(F.col("embedding"))), "l2")
    return near.drop("embedding").withColumnRenamed("_own", "embedding")


def index_segment(segment: Segment, mapping, templates: dict[str, DataFrame] | None = None, clusters: int | None = None) -> Segment:
    """The segment with its vector fields indexed: tables vectors (with centroid and codes), centroids and vector_meta."""
    spark, parts, centers, meta = segment.spark, [], [], []
    for f in mapping.of("vector"):
        own = segment.vectors.filter(F.col("field") == f.name)
        index = build(own, f.name, f.optimise, f.similarity, (templates or {}).get(f.name), clusters)
        rows = index.vectors.withColumn("field", F.lit(f.name))
        for c, t in (("centroid", "long"), ("codes", "array<int>")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(t))
        parts.append(rows.select("field", "vec_id", "doc_num", "embedding", "centroid", "codes"))
        if index.centroids is not None:
            centers.append(index.centroids.select(F.lit(f.name).alias("field"), F.col("centroid").cast("long"), F.col("embedding").cast("array<double>")))
        b = index.bounds.first() if index.bounds is not None else None
        size = own.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
        meta.append((f.name, index.kind, index.metric, f.optimise, size["n"], size["dim"], b and list(b["lows"]), b and list(b["steps"])))
    if not parts:
        return segment
    tables = {"vectors": _all(parts), "vector_meta": spark.createDataFrame(meta, SCHEMAS["vector_meta"])}
    return segment.replace(**tables, **({"centroids": materialise(_all(centers))} if centers else {}))


def _all(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def open_index(segment: Segment, field: str) -> VectorIndex:
    """Handle of a field's index; one of a missing field finds nothing."""
    meta = segment.vector_meta.filter(F.col("field") == field).first()
    rows = segment.vectors.filter(F.col("field") == field)
    if meta is None:
        return VectorIndex(field, "flat", "l2", rows)
    bounds = segment.spark.createDataFrame([(list(meta["lows"]), list(meta["steps"]))], "lows array<double>, steps array<double>") if meta["lows"] is not None else None
    centroids = trained(segment, field) if meta["kind"].startswith("ivf_") else None
    return VectorIndex(field, meta["kind"], meta["metric"], rows, centroids, bounds, meta["optimise"])


def trained(segment: Segment, field: str) -> DataFrame:
    """Trained centroids of a field, (centroid, embedding); a field without any is an error."""
    found = segment.centroids.filter(F.col("field") == field).select("centroid", "embedding")
    if found.isEmpty():
        raise KeyError(f"field {field!r} has no trained index")
    return found


def merge_indexes(segments: list[Segment], merged: Segment, mapping, dropped: bool) -> Segment:
    """Index the vectors of a merged segment. Without drops, and if all segments were trained alike (the same centroids),
    their centroids serve as template; otherwise each field is trained anew. The goal is the mapping's."""
    templates = {}
    for f in mapping.of("vector"):
        each = [s.centroids.filter(F.col("field") == f.name) for s in segments if s.has("centroids")]
        if not dropped and len(each) == len(segments) and each:
            marks = {tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("centroid", "embedding"))).first()) for e in each}
            if len(marks) == 1 and marks != {(0, None)}:
                templates[f.name] = each[0].select("centroid", "embedding")
    counts = {name: t.count() for name, t in templates.items()}
    return index_segment(merged, mapping, templates, next(iter(counts.values()), None))
