"""Sinks beside the index: its state as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state(index) -> DataFrame:
    """totalDocuments, totalEmbeddings and lastModified (ISO 8601) of an index."""
    return index.state().select(F.col("num_documents").alias("totalDocuments"), F.col("num_embeddings").alias("totalEmbeddings"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastModified"))


def write_state(index, path: str) -> None:
    state(index).coalesce(1).write.mode("overwrite").json(path)
