"""A search service: folders in, ranked chunks out."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexNotFound
from ..functions import display as D
from ..plans import params
from ..schema import IndexConfig, ModelConfig
from ..sources import ingest, sink
from ..streaming.ingest import chunked
from . import encode, metadata, mutate
from .segments import SegmentIndex


class SnapshotCache:
    """Open indexes by path; a newer published snapshot replaces the one held."""

    def __init__(self):
        self._lock, self._open = threading.Lock(), {}

    def open(self, spark: SparkSession, path: str) -> SegmentIndex:
        with self._lock:
            held = self._open.get(path)
            latest = SegmentIndex._latest(spark, path)
            if latest is None:
                self._open.pop(path, None)
                raise IndexNotFound(path)
            if held is None or held.version != latest:
                held = self._open[path] = SegmentIndex.open(spark, path)
            return held

    def drop(self, path: str) -> None:
        with self._lock:
            self._open.pop(path, None)


@dataclass
class SearchService:
    spark: SparkSession
    path: str
    encoder: encode.Encoder
    model: ModelConfig
    config: IndexConfig = field(default_factory=IndexConfig)
    size: int = 180
    overlap: int = 64
    cache: SnapshotCache = field(default_factory=SnapshotCache)
    model_id: str = "hash"

    def index_directory(self, folder: str) -> SegmentIndex:
        return self.index_documents(ingest.directory(self.spark, folder))

    def index_documents(self, documents: DataFrame) -> SegmentIndex:
        """A new index of documents(document_name, text, file_path), one row a chunk."""
        pieces = chunked(documents.select("document_name", "text"), self.size, self.overlap)
        pieces = pieces.withColumn("key", F.concat_ws("\u0001", "document_name", F.lpad(F.col("chunk_index").cast("string"), 12, "0")))
        rows = mutate.append_ids(pieces, 0, "key").drop("key")
        tokens = encode.encode_documents(rows, self.encoder, self.model)
        counts = tokens.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("embedding_count"))
        chunks = rows.join(counts, "doc_id")
        if "file_path" in documents.columns:
            chunks = chunks.join(documents.select("document_name", "file_path").dropDuplicates(["document_name"]), "document_name", "left")
        self.cache.drop(self.path)
        index = SegmentIndex.create(self.spark, self.path, tokens, self.config, chunks, self.model_id)
        sink.write_state(index, f"{self.path}/state")
        return index

    def search(self, text: str, top_k: int = 5) -> DataFrame:
        """rank, doc_id, name, preview and score, divided by the query's real rows; parameters follow the index's size."""
        index = self.cache.open(self.spark, self.path)
        rows = encode.encode_query(text, self.encoder, self.model.query_length)
        real = int((rows != 0).any(1).sum())
        queries = self.spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(rows)], "query_id long, qtok int, v array<double>")
        hits = index.search(queries, params.adaptive(index.num_documents, top_k))
        out = metadata.enrich(hits, index.chunks()).withColumn("score", D.normalized(F.col("score"), F.lit(real)))
        return out.select("rank", "doc_id", D.display_name(F.col("document_name"), F.col("chunk_index")).alias("name"), "preview", "score", D.score_percentage(F.col("score")).alias("percentage"), D.score_band(F.col("score")).alias("band")).orderBy("rank")

    def documents(self) -> DataFrame:
        return self.cache.open(self.spark, self.path).documents()

    def delete_document(self, name: str) -> int:
        """How many chunks went; all of them drop the index."""
        index, gone = self.cache.open(self.spark, self.path).delete_named(name)
        if index is None:
            self.cache.drop(self.path)
        else:
            sink.write_state(index, f"{self.path}/state")
        return gone.count()

    def delete_index(self) -> None:
        """Removes the index; one that is not there is no error."""
        self.cache.drop(self.path)
        SegmentIndex.drop(self.spark, self.path)

    def switch_model(self, model_id: str, encoder: encode.Encoder, model: ModelConfig) -> bool:
        """Another model for what comes; vectors of one model mean nothing to another, so a change removes the index."""
        changed = model_id != self.model_id
        if changed:
            self.delete_index()
        self.model_id, self.encoder, self.model = model_id, encoder, model
        return changed
