"""Session settings that the engine is tuned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; cluster settings are left to the submitter."""
    b = SparkSession.builder.appName("veclattice")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # files of checkpoints that nothing refers to go
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a temporary one on one machine, and an error on a cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise EngineError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
