"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "lodestone", **conf) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides. Without a master, the cluster's."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is named and the master is local (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, which survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
