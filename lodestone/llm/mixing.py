"""2. Mixing sources: temperature-scaled shares, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.textkit import cut

ENTROPY, REPEATS, BLOCK_TOKENS, STEPS = 0.95, 4.0, 1_000_000, 50
DOCS_A_BUCKET = 20_000


def scaled(tokens: list[float], exponent: float) -> list[float]:
    total = math.fsum(tokens)
    powers = [math.pow(t / total, exponent) for t in tokens]
    z = math.fsum(powers)
    return [p / z for p in powers]


def exponent_for(tokens: list[float], budget: float, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The largest exponent in [0, 1] whose entropy is at least ``entropy`` times the logarithm of the number of
    sources; if a source would then be repeated more than ``repeats`` times, the smallest larger one that keeps to
    the limit (1 if none does). Rounded to nine digits."""
    target = entropy * math.log(len(tokens))

    def enough(a):
        return -math.fsum(q * math.log(q) for q in scaled(tokens, a) if q > 0) >= target

    def within(a):
        return max(q * budget / t for q, t in zip(scaled(tokens, a), tokens)) <= repeats

    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if enough(mid) else (lo, mid)
    if not within(lo):
        hi = 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if within(mid) else (mid, hi)
        lo = hi
    return round(lo, 9)


def weights(tokens: dict, budget: float, entropy: float = ENTROPY, repeats: float = REPEATS) -> dict:
    """Normalised weight of each source."""
    if not tokens:
        return {}
    names = sorted(tokens)
    counts = [float(tokens[n]) for n in names]
    return dict(zip(names, scaled(counts, exponent_for(counts, budget, entropy, repeats))))


def mix(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, seed: str = "mix") -> DataFrame:
    """Training order: (doc_id, source, tokens, epoch, block, slot), one row for each use of a document.

    Tokens are runs of non-blanks. Each source's stream is one hash permutation of its documents after another; a
    use is taken while the stream's tokens before it are under the source's quota, ``floor(weight * budget)``
    (budget: by default all tokens), and lies in the block that this position falls in when quota and budget are
    cut into blocks of about ``block_tokens``. Blocks thus all have the target mixture; ``slot`` permutes a block.

    If no exponent keeps a source to ``repeats`` uses (a budget of more than so many times all tokens), the shares are
    those of the tokens themselves and the limit is exceeded by all sources alike.

    Positions come from sums by hash bucket, so that no source, however hot, is sorted by one task.

    Null or blank text has no tokens and is left out, as are null ids; a null source is the source "". Repeated rows
    are uses of their own. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    counted = cut(
        docs.filter(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("tokens"))
        .filter("tokens > 0")
    )
    totals = {r["source"]: (r["tokens"], r["docs"]) for r in counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    total = sum(t for t, _ in totals.values())
    budget = total if budget is None else budget
    shares = weights({s: t for s, (t, _) in totals.items()}, budget, entropy, repeats)
    quotas = [(s, int(math.floor(shares[s] * budget)), t) for s, (t, _) in totals.items()]
    blocks = max(1, -(-budget // block_tokens))
    plan = spark.createDataFrame(quotas, "source string, quota long, source_tokens long").filter("quota > 0")
    most = max([d for _, d in totals.values()], default=0)
    digits = max(1, min(8, math.ceil(math.log(max(1, most / DOCS_A_BUCKET), 16))))

    uses = counted.join(F.broadcast(plan) if len(quotas) <= 100_000 else plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("quota") / F.col("source_tokens")) - 1).cast("int"))))
    uses = uses.withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), "epoch", "doc_id"))).withColumn("bucket", F.substring("key", 1, digits))
    sums = uses.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("held"))
    before = sums.select("source", "epoch", "bucket", F.coalesce(F.sum("held").over(Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("source", "epoch", "bucket").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = uses.withColumn("inside", F.coalesce(F.sum("tokens").over(own), F.lit(0))).join(before, ["source", "epoch", "bucket"])
    start = F.col("epoch") * F.col("source_tokens") + F.col("earlier") + F.col("inside")
    taken = placed.withColumn("start", start).filter("start < quota").withColumn("block", F.expr(f"cast((cast(start as decimal(38,0)) * {blocks}) div quota as long)"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.lit("slot"), "key")), "doc_id", "epoch"))
    return taken.withColumn("slot", slot).select("doc_id", "source", "tokens", "epoch", "block", "slot")


def mix_sql(documents: str = "documents", entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, seed: str = "mix") -> str:
    """DuckDB SQL for :func:`mix` with the budget of all tokens: common table expressions, then the query."""
    entropy_at = "(SELECT ln(sum(pow(p, mid))) - mid * sum(pow(p, mid) * ln(p)) / sum(pow(p, mid)) FROM shares)"
    repeat_at = "(SELECT max(pow(p, {a}) / z / p) FROM shares, (SELECT sum(pow(p, {a})) AS z FROM shares))"
    return rf"""
WITH RECURSIVE counted AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS tokens
  FROM {documents} WHERE text IS NOT NULL AND doc_id IS NOT NULL AND len(regexp_extract_all(text, '\S+')) > 0),
totals AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS t FROM counted GROUP BY source),
shares AS (SELECT source, t, CAST(t AS DOUBLE) / (SELECT sum(t) FROM totals) AS p FROM totals),
goal AS (SELECT {entropy} * ln(count(*)) AS h FROM shares),
e(i, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
  SELECT i + 1, CASE WHEN ent >= h THEN mid ELSE lo END, CASE WHEN ent >= h THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid, {entropy_at} AS ent FROM (SELECT *, (lo + hi) / 2 AS mid FROM e WHERE i < {STEPS})), goal),
a0 AS (SELECT lo AS a FROM e WHERE i = {STEPS}),
r(i, lo, hi) AS (SELECT 0, a, CAST(1 AS DOUBLE) FROM a0 UNION ALL
  SELECT i + 1, CASE WHEN rep <= {repeats} THEN lo ELSE mid END, CASE WHEN rep <= {repeats} THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, mid, {repeat_at.format(a="mid")} AS rep FROM (SELECT *, (lo + hi) / 2 AS mid FROM r WHERE i < {STEPS}))),
a1 AS (SELECT round(CASE WHEN (SELECT rep FROM (SELECT {repeat_at.format(a="a")} AS rep FROM a0)) <= {repeats} THEN (SELECT a FROM a0)
  ELSE (SELECT hi FROM r WHERE i = {STEPS}) END, 9) AS a),
plan AS (SELECT source, t, CAST(floor(pow(p, a) / (SELECT sum(pow(p, a)) FROM shares) * (SELECT sum(t) FROM totals)) AS BIGINT) AS quota FROM shares, a1),
n AS (SELECT greatest(1, CAST(ceil((SELECT sum(t) FROM totals) / {block_tokens}.0) AS BIGINT)) AS blocks),
uses AS (SELECT doc_id, source, tokens, t, quota, unnest(range(0, CAST(ceil(quota / t) AS BIGINT))) AS epoch FROM counted JOIN plan USING (source) WHERE quota > 0),
keyed AS (SELECT *, md5('{seed}|' || epoch || '|' || doc_id) AS key FROM uses),
placed AS (SELECT *, epoch * t + coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM keyed),
taken AS (SELECT *, CAST((CAST(start AS HUGEINT) * blocks) // quota AS BIGINT) AS block FROM placed, n WHERE start < quota)
SELECT doc_id, source, tokens, CAST(epoch AS INTEGER) AS epoch, block,
  CAST(row_number() OVER (PARTITION BY block ORDER BY md5('{seed}|slot|' || key), doc_id, epoch) AS INTEGER) AS slot FROM taken
"""
