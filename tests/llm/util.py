"""Small document tables with awkward rows, and texts with planted content."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def prose(rng, n, alphabet="abcdefghijklmnopqrstuvwxyz"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def table(spark, texts, extra=True):
    """Documents of texts, with null and empty ones, a repeated row and columns whose names operators use inside."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("keep", "h", "pos", "n", "s", "key", "tokens", "block", "score", "label", "_doc", "_touched", "found", "start"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
    return df


def awkward(rng, n=12):
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(n)]
    return [*texts, None, "", "   ", "\n\n", "...", "é", texts[0], texts[1].upper(), prose(rng, 30_000)]


def seeded(n=1):
    return random.Random(n)
