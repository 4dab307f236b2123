"""1. Language ID: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.textkit import checkpoint_dir, cut, fresh, lowered, parts

BITS, ORDERS = 15, (1, 2, 3)
TRAIN_ROWS = 2400  # bound on the labelled rows that the classifier is fitted on, over all languages
MIN_CONFIDENCE = 0.5
UNDETERMINED = "und"


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk, with every ASCII character but letters a blank, and character offsets."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    blank = (codes < 128) & ~(((codes >= 97) & (codes <= 122)) | ((codes >= 65) & (codes <= 90)))
    return np.where(blank, np.uint32(32), codes), ends[offsets]


def features(codes: np.ndarray, bounds: np.ndarray):
    """n-grams of each document by one sort of a chunk: (bounds of the documents among them, hash buckets, counts).
    n-grams never span documents; one without letters has none."""
    factors = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
    n, n_docs = len(codes), len(bounds) - 1
    wide = np.uint32 if n_docs < 1 << (32 - BITS) else np.uint64
    owner = np.repeat(np.arange(n_docs, dtype=wide), np.diff(bounds))
    lettered = np.zeros(n_docs, bool)
    lettered[owner[codes != 32]] = True
    keys = [np.zeros(0, wide)]
    for k in ORDERS:
        if n < k:
            continue
        h = np.full(n - k + 1, k * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            h = (h ^ codes[j : j + n - k + 1]) * factors[j]
            h ^= h >> np.uint32(15)
        bucket = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        whole = (owner[: n - k + 1] == owner[k - 1 :]) & lettered[owner[: n - k + 1]]
        keys.append(((owner[: n - k + 1] << wide(BITS)) | bucket)[whole])
    keys = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts, keys = np.diff(np.append(new, len(keys))), keys[new]
    return np.searchsorted(keys >> wide(BITS), np.arange(n_docs + 1)), (keys & wide((1 << BITS) - 1)).astype(np.int64), counts


def tfidf(where, counts, idf):
    x = (1 + np.log(counts)) * idf[where]
    return x / max(1e-12, math.sqrt(float(x @ x)))


def _survey(batches):
    """Per task: the document frequencies of all its documents; and the features of the sampled ones."""
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        pick, lang, rank = np.asarray(batch.column("pick")), batch.column("lang"), batch.column("rank")
        kinds, langs, ranks, payloads = [], [], [], []
        for a, b, data, offsets in parts(batch.column("text")):
            first, where, counts = features(*letters(data, offsets))
            df += np.bincount(where, minlength=1 << BITS)
            some = np.diff(first) > 0
            n += int(some.sum())
            for i in np.flatnonzero(some & pick[a:b]).tolist():
                langs.append(lang[a + i].as_py())
                ranks.append(rank[a + i].as_py())
                kinds.append(1)
                payloads.append(np.concatenate((where[first[i] : first[i + 1]], counts[first[i] : first[i + 1]])).astype(np.int32).tobytes())
        if kinds:
            yield _rows(kinds, langs, ranks, payloads)
    yield _rows([0], [None], [n], [df.tobytes()])


def _rows(kinds, langs, ranks, payloads):
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(langs, pa.string()), pa.array(ranks, pa.int64()), pa.array(payloads, pa.binary())], names=["kind", "lang", "rank", "payload"])


def _added(batches):
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for rank, payload in zip(batch.column("rank").to_pylist(), batch.column("payload").to_pylist()):
            df += np.frombuffer(payload, np.int64)
            n += rank
    yield _rows([0], [None], [n], [df.tobytes()])


def ftrl(examples, labels, n_classes, epochs=3, alpha=0.5, beta=1.0, l1=2e-4, l2=1e-4, seed=0):
    """FTRL-proximal with elastic net: per-coordinate rates, weights that are zero unless |z| exceeds l1."""
    z, n = np.zeros((1 << BITS, n_classes)), np.zeros((1 << BITS, n_classes))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            where, x = examples[i]
            zi, ni = z[where], n[where]
            w = weights(zi, ni)
            p = softmax((x @ w)[None])[0]
            p[labels[i]] -= 1
            g = x[:, None] * p
            grown = ni + g * g
            z[where] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[where] = grown
    return weights(z, n)


def softmax(logits):
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def temperature(logits, labels) -> float:
    """The temperature with the least negative log-likelihood, by golden section in its logarithm. The targets are
    smoothed as in Platt scaling, (n + 1) / (n + 2): else a perfect held-out set would drive the temperature to 0."""
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    rows, ratio = np.arange(len(labels)), (math.sqrt(5) - 1) / 2
    sure = (np.bincount(labels, minlength=logits.shape[1])[labels] + 1) / (np.bincount(labels, minlength=logits.shape[1])[labels] + 2)
    targets = np.repeat((1 - sure)[:, None] / (logits.shape[1] - 1), logits.shape[1], 1)
    targets[rows, labels] = sure

    def loss(t):
        return -(targets * np.log(softmax(logits / math.exp(t)) + 1e-12)).sum(1).mean()

    lo, hi = math.log(0.05), math.log(20)
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Document frequencies of all documents; weights from a hash sample of at most ``train_rows`` labelled rows,
    shared evenly by the languages (of more languages than that, the most frequent count); temperature from the fifth
    of the sample that the weights never saw. Ids play no part: null and repeated ones are sampled like others."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    counted = docs.filter("lang is not null and text is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(train_rows)
    labelled = {r["lang"]: r["count"] for r in counted.collect()}
    langs = sorted(labelled)
    if not langs:
        return {"langs": [], "idf": np.zeros(1 << BITS, np.float32), "weights": np.zeros((1 << BITS, 0), np.float32), "temperature": 1.0, "held_out": None}
    each = max(1, train_rows // len(langs))
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, (1.2 * each + 20) / labelled[lang]))])
    rank = F.xxhash64("doc_id", "text", F.lit("sample")).bitwiseAND(F.lit((1 << 40) - 1))
    marked = docs.select("lang", rank.alias("rank"), lowered().alias("text"), F.coalesce(F.col("lang").isNotNull() & (rank < F.element_at(rate, F.col("lang")) * (1 << 40)), F.lit(False)).alias("pick"))
    seen = cut(marked.mapInArrow(_survey, "kind int, lang string, rank long, payload binary"))
    total = seen.filter("kind = 0").repartition(16).mapInArrow(_added, seen.schema).coalesce(1).mapInArrow(_added, seen.schema).first()
    idf = (np.log((1 + total["rank"]) / (1 + np.frombuffer(total["payload"], np.int64))) + 1).astype(np.float32)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "payload"))
    sample = seen.filter("kind = 1").select("lang", "rank", "payload").withColumn("place", place).filter(F.col("place") <= each).collect()
    by_lang = {lang: sorted((r["rank"], bytes(r["payload"])) for r in sample if r["lang"] == lang) for lang in langs}
    fit, held = [], []
    for c, lang in enumerate(langs):
        for i, (_, payload) in enumerate(by_lang[lang]):
            both = np.frombuffer(payload, np.int32)
            where, counts = both[: len(both) // 2], both[len(both) // 2 :]
            (held if i % 5 == 4 else fit).append((where, tfidf(where, counts, idf), c))
    weights = ftrl([(w, x) for w, x, _ in fit], [c for _, _, c in fit], len(langs)).astype(np.float32)
    logits = np.array([x @ weights[w] for w, x, _ in held]).reshape(len(held), len(langs))
    truth = np.array([c for _, _, c in held], int)
    return {"langs": langs, "idf": idf, "weights": weights, "temperature": temperature(logits, truth), "held_out": float((logits.argmax(1) == truth).mean()) if len(held) else None}


def _predict(m, column):
    """Class (the number of languages, if undetermined) and confidence of each lower-cased text."""
    best, sure = np.full(len(column), len(m["langs"])), np.zeros(len(column))
    for a, _b, data, offsets in parts(column):
        first, where, counts = features(*letters(data, offsets))
        full = np.flatnonzero(np.diff(first) > 0)
        if not len(full) or not m["langs"]:
            continue
        x, at = (1 + np.log(counts)) * m["idf"][where], first[:-1][full]
        size = np.sqrt(np.add.reduceat(x * x, at))
        logits = np.stack([np.add.reduceat(x * m["weights"][where, c], at) for c in range(len(m["langs"]))], 1)
        p = softmax(logits / size[:, None] / m["temperature"])
        best[a + full], sure[a + full] = p.argmax(1), p.max(1)
    return best, sure


def _classify(model):
    def run(batches):
        m = model.value
        names = np.array([*m["langs"], UNDETERMINED], object)
        for batch in batches:
            best, sure = _predict(m, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "confidence"])

    return run


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS, min_confidence: float = MIN_CONFIDENCE, model: dict | None = None) -> DataFrame:
    """(doc_id, lang_pred, confidence, accepted) for every row.

    Features are hashed n-grams of one to three lower-cased characters of whole texts, weighted by
    ``(1 + log count) * idf`` and scaled to unit length. ``confidence`` is the calibrated probability of ``lang_pred``.

    Null, empty and letterless texts are "und" with confidence 0 and not accepted; so is everything if no row has a
    label. Rows that repeat give a row each. A null id stays null. Ties go to the first language by name. Extra
    columns are ignored. ``model``: from :func:`train`; by default trained on ``docs``.
    """
    model = train(docs, train_rows) if model is None else model
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size, whatever the corpus
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered().alias("text")).mapInArrow(_classify(shipped), "doc_id long, lang_pred string, confidence double")
    return got.withColumn("accepted", (F.col("confidence") >= min_confidence) & (F.col("lang_pred") != UNDETERMINED))


def keep_accepted(docs: DataFrame, min_confidence: float = MIN_CONFIDENCE, model: dict | None = None) -> DataFrame:
    """The rows of ``docs``, whole, that :func:`identify` accepts: each by its own text, whatever its id."""
    model = train(docs) if model is None else model
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        told = np.array([*(x != UNDETERMINED for x in m["langs"]), False])
        for batch in batches:
            best, sure = _predict(m, batch.column(batch.num_columns - 1))
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array((sure >= min_confidence) & told[best]))

    return docs.select("*", lowered().alias(fresh(docs, "_lowered"))).mapInArrow(run, docs.schema)
