"""Micro-batches to segments: each batch is a segment; newer versions of an id win when segments are compacted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.merge import compact
from lodestone.sources.mapping import Mapping
from lodestone.sources.segment import Segment, build_segment, number, open_segment


def segment_name(batch: int) -> str:
    return f"segment-{batch:012d}"


def ingest(stream: DataFrame, mapping: Mapping, path: str, checkpoint: str, version: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a segment for each micro-batch under ``path``. Of an id's rows in a batch the one with the largest
    ``version`` is kept, of equal ones that with the largest hash of all its columns. A batch that is tried again overwrites its segment, so each counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = Window.partitionBy(F.expr(mapping.id_expr)).orderBy(F.col(version).desc(), F.xxhash64(*[F.to_json(F.struct(c)) for c in batch.columns]).desc())
        rows = batch.withColumn("_newest", F.row_number().over(newest)).filter("_newest = 1").drop("_newest")
        if not rows.isEmpty():
            build_segment(number(rows, version), mapping).persist(f"{path}/{segment_name(batch_id)}", overwrite=True)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """Written segments in the order of their batches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return [open_segment(spark, f"{path}/{n}") for n in names if n.startswith("segment-") and not n.endswith(".tmp")]


def compacted(spark: SparkSession, path: str) -> Segment:
    return compact(segments(spark, path))[0]
