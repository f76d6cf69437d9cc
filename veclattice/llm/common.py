"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcodes import release

#: A word is a maximal run of anything but U+0020 and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, its lineage cut.

    The folder is the session's spark.checkpoint.dir; where that is unset, a
    temporary folder is set on one machine, as in tests, and a cluster refused.
    """
    _shared(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    _tidy(out.sparkSession)
    return out


def _tidy(spark: SparkSession) -> None:
    """Shuffle and checkpoint files of steps that nothing refers to any more go only when the driver collects garbage."""
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to a new folder in the shared checkpoint folder, and read again."""
    spark = df.sparkSession
    shared = _shared(spark)
    path = f"{shared}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    _tidy(spark)
    return spark.read.schema(schema).parquet(path)


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()
