"""From documents to a training order: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, language_id, line_dedup, mixing, near_dup
from lodestone.llm.textkit import checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose language can't be told: no text, no letters, or a calibrated confidence below the limit.

    Each row is judged by its own text: a null or repeated id changes nothing, and rows that repeat share their fate. A
    table without labels tells no language, so nothing stays. Extra columns are kept. Nothing is shuffled."""
    return language_id.keep_accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; documents that have nothing left go.

    Rows with a null id or text pass unchanged and take no line from others. Rows that share an id count as one document:
    they lose the same positions. Extra columns are kept. An empty table gives none."""
    return line_dedup.apply_keep(docs, line_dedup.line_dedup(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id.

    Rows with a null id, no text or no word are in no group and stay. Rows that repeat id and text are one document;
    rows of one id with different texts are documents of their own. Extra columns are kept. An empty table gives none."""
    return near_dup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a long span with a benchmark item.

    Each row is judged by its own text, whatever its id (see :func:`lodestone.llm.decontam.keep_clean` for a benchmark
    beyond the broadcast bound); null and empty texts stay. Extra columns are kept. Either table may be empty."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order of what is left. Rows with a null id or without a token are no part of it; a null source is the
    source ""; rows that repeat are uses of their own. Extra columns are ignored. An empty table gives none."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]
ORACLE_SQL = None  # language ID and near dedup are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the tables between them are deleted once the last stage has its own copy of what it needs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    mixed = STAGES[-1][1](spark, docs, sf_dir)  # reads its checkpoint only
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return mixed
