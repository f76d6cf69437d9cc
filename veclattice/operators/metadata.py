"""Chunk metadata: lookup in request order, grouping, enrichment and the JSON payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display as D
from ..schema import CHUNKS
from .predicate import where


def register(rows: DataFrame, index_name: str = "index") -> DataFrame:
    """rows as chunk metadata; missing optional columns are null, one creation time holds for the batch, blank paths are null."""
    defaults = {"chunk_index": F.lit(0), "embedding_count": F.lit(0), "file_path": F.lit(None), "index_name": F.lit(index_name), "created_at": F.date_trunc("second", F.current_timestamp()), "metadata_json": F.lit(None)}
    columns = []
    for f in CHUNKS.fields:
        c = F.col(f.name) if f.name in rows.columns else defaults[f.name]
        c = F.expr("nullif(file_path, '')") if f.name == "file_path" and f.name in rows.columns else c
        columns.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*columns)


def get(chunks: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """Chunks in the order of the request, missing ids left out; ids: pos and doc_id, or a list."""
    if isinstance(ids, list):
        ids = chunks.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, doc_id long")
    return ids.join(chunks, "doc_id").orderBy("pos")


def by_name(chunks: DataFrame, name: str) -> DataFrame:
    return where(chunks, "document_name = ?", [name]).orderBy("doc_id")


def documents(chunks: DataFrame) -> DataFrame:
    """document_name, chunk_count, embedding_count, file_path (the first not null by id) and created_at, by name."""
    first = F.min_by("file_path", F.when(F.col("file_path").isNotNull(), F.col("doc_id")))
    agg = [F.count(F.lit(1)).alias("chunk_count"), F.sum(F.col("embedding_count").cast("long")).alias("embedding_count"), first.alias("file_path"), F.min("created_at").alias("created_at")]
    return chunks.groupBy("document_name").agg(*agg).orderBy("document_name")


def enrich(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits(query_id, rank, doc_id, score) with name, text, index, path and preview; hits without metadata are dropped.

    Hits are the small side: the chunks of a large store are filtered by them and not shuffled for them.
    """
    meta = chunks.select("doc_id", "document_name", "chunk_text", "chunk_index", "file_path").dropDuplicates(["doc_id"])
    out = hits.join(meta, "doc_id")
    return out.withColumns({"preview": D.preview(F.col("chunk_text")), "score_percentage": D.score_percentage(F.col("score"))})


def payload(doc_id: Column | str = "doc_id") -> Column:
    """Stored JSON of a chunk, keys sorted."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    fields = [c.alias("_subset_"), F.col("chunk_index").alias("chunkIndex"), F.col("chunk_text").alias("chunkText"), F.unix_timestamp("created_at").alias("createdAt"), F.col("document_name").alias("documentName"), F.col("embedding_count").alias("embeddingCount"), F.coalesce("file_path", F.lit("")).alias("filePath")]
    return F.to_json(F.struct(*fields))


PAYLOAD = "_subset_ string, chunkIndex string, chunkText string, createdAt string, documentName string, embeddingCount string, filePath string"


def from_payload(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Chunks of JSON payloads; numbers may be strings; rows without an id are dropped; missing texts are empty, numbers 0."""
    p = F.from_json(column, PAYLOAD)

    def number(name: str) -> Column:
        return F.expr(f"cast(try_cast(p.{name} as double) as bigint)")

    out = rows.select(p.alias("p")).select(
        number("_subset_").alias("doc_id"),
        F.coalesce("p.documentName", F.lit("")).alias("document_name"),
        F.coalesce("p.chunkText", F.lit("")).alias("chunk_text"),
        F.coalesce(number("chunkIndex"), F.lit(0)).cast("int").alias("chunk_index"),
        F.coalesce(number("embeddingCount"), F.lit(0)).cast("int").alias("embedding_count"),
        F.expr("nullif(p.filePath, '')").alias("file_path"),
        F.timestamp_seconds(F.coalesce(number("createdAt"), F.lit(0))).alias("created_at"),
    )
    return out.where("doc_id is not null")
