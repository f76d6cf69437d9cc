"""Index snapshots on a file system that Spark reads.

An index is a folder of immutable snapshots v0, v1, ... of Parquet tables and
a table `current` whose greatest version counts.  Append and delete write a
new snapshot and then publish it; a reader keeps the one it opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConcurrentWrite, DimensionMismatch, EmptyEmbeddingSet, IndexNotFound, InvalidDocumentId, ModelMismatch
from ..functions import vectors as V
from ..schema import IndexConfig, SearchParameters
from . import codec, metadata, mutate, search
from .predicate import where

META = "version long, model_id string, dim int, nbits int, num_partitions long, num_documents long, num_embeddings long, avg_doclen double, seed long, cutoffs array<double>, weights array<double>, centroids string, every long, last_batch string"


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    version: int
    meta: dict

    # -- opening and publishing

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    @classmethod
    def _latest(cls, spark: SparkSession, path: str) -> int | None:
        fs, make = cls._fs(spark, path)
        found = fs.globStatus(make(f"{path}/published/v*")) or []
        versions = [int(s.getPath().getName()[1:]) for s in found]
        return max(versions) if versions else None

    @classmethod
    def open(cls, spark: SparkSession, path: str, model_id: str | None = None) -> VectorIndex:
        version = cls._latest(spark, path)
        if version is None:
            raise IndexNotFound(path)
        meta = spark.read.parquet(f"{path}/v{version}/meta").first().asDict()
        if model_id is not None and meta["model_id"] != model_id:
            raise ModelMismatch(f"the index was made with {meta['model_id']}, not {model_id}")
        return cls(spark, path, version, meta)

    @classmethod
    def drop(cls, spark: SparkSession, path: str) -> None:
        """Removes the whole index; one that is not there is no error."""
        fs, make = cls._fs(spark, path)
        fs.delete(make(path), True)

    @classmethod
    def _publish(cls, spark: SparkSession, path: str, version: int) -> None:
        fs, make = cls._fs(spark, path)
        if not fs.mkdirs(make(f"{path}/published")) or not fs.createNewFile(make(f"{path}/published/v{version}")):
            raise ConcurrentWrite(f"version {version} was published by another writer")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version}/{name}")

    # -- building

    @classmethod
    def create(cls, spark: SparkSession, path: str, tokens: DataFrame, config: IndexConfig | None = None, chunks: DataFrame | None = None, model_id: str = "hash", dim: int | None = None, batch: str | None = None) -> VectorIndex:
        """From token rows (doc_id, token_pos, v) with dense ids; replaces an index at the path."""
        cls.drop(spark, path)
        return cls._build(spark, path, 0, tokens, config or IndexConfig(), chunks, model_id, dim, batch)

    @classmethod
    def _build(cls, spark, path, version, tokens, config, chunks, model_id, dim, batch=None) -> VectorIndex:
        at = f"{path}/v{version}"
        unit = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_pos").cast("int").alias("token_pos"), V.normalize(V.doubles("v")).alias("v"))
        unit.write.parquet(f"{at}/raw")
        unit = spark.read.parquet(f"{at}/raw")
        n, docs, least, most = unit.agg(F.count(F.lit(1)), F.max("doc_id"), F.min(F.size("v")), F.max(F.size("v"))).first()
        if not n:
            raise EmptyEmbeddingSet("an index needs at least one document")
        if least != most or (dim is not None and dim != most):
            raise DimensionMismatch(dim or most, least)
        k = codec.partitions_for(n)
        centroids = codec.deterministic_centroids(codec.numbered(unit), config.every or max(1, n // k)) if config.centroids == "deterministic" else codec.kmeans_centroids(unit, k, config.kmeans_iterations, config.max_points_per_centroid, config.seed)
        centroids.write.parquet(f"{at}/centroids")
        centroids = spark.read.parquet(f"{at}/centroids")
        block = codec.centroid_block(centroids)
        codec.residuals(codec.assign(unit, block), centroids).write.parquet(f"{at}/residuals")
        rest = spark.read.parquet(f"{at}/residuals")
        edges, weights = codec.cutoffs(rest, config.nbits)
        cls._write_codes(spark, at, rest, edges)
        fs, make = cls._fs(spark, path)
        fs.delete(make(f"{at}/residuals"), True)
        chunks_out = metadata.register(chunks) if chunks is not None else None
        if chunks_out is not None:
            chunks_out.write.parquet(f"{at}/chunks")
        if docs + 1 > config.rebuild_up_to:
            fs.delete(make(f"{at}/raw"), True)
        row = (version, model_id, most, config.nbits, len(block[0]), docs + 1, n, n / (docs + 1), config.seed, edges, weights, config.centroids, config.every, batch)
        return cls._finish(spark, path, version, row)

    @classmethod
    def _write_codes(cls, spark, at, rest, edges) -> None:
        codec.codes(rest, edges).select("doc_id", "token_pos", "centroid_id", F.transform("code", lambda c: c.cast("smallint")).alias("code")).write.parquet(f"{at}/codes")
        coded = spark.read.parquet(f"{at}/codes")
        codec.inverted_lists(coded).write.parquet(f"{at}/ivf")
        codec.document_lengths(coded).write.parquet(f"{at}/doclens")

    @classmethod
    def _finish(cls, spark, path, version, row) -> VectorIndex:
        spark.createDataFrame([row], META).coalesce(1).write.parquet(f"{path}/v{version}/meta")
        cls._publish(spark, path, version)
        return cls.open(spark, path)

    def _config(self) -> IndexConfig:
        return IndexConfig(nbits=self.meta["nbits"], seed=self.meta["seed"], centroids=self.meta["centroids"], every=self.meta["every"])

    def _exists(self, name: str) -> bool:
        fs, make = self._fs(self.spark, self.path)
        return fs.exists(make(f"{self.path}/v{self.version}/{name}"))

    # -- reading

    @property
    def num_documents(self) -> int:
        return self.meta["num_documents"]

    @property
    def num_embeddings(self) -> int:
        return self.meta["num_embeddings"]

    @property
    def dim(self) -> int:
        return self.meta["dim"]

    def chunks(self) -> DataFrame | None:
        return self.table("chunks") if self._exists("chunks") else None

    def tokens(self) -> DataFrame:
        """De-quantised unit vectors of all tokens."""
        return codec.reconstruct(self.table("codes"), self.table("centroids"), self.meta["weights"])

    def reconstruct(self, ids: list[int]) -> DataFrame:
        bad = [i for i in ids if not 0 <= i < self.num_documents]
        if bad:
            raise InvalidDocumentId(bad[0])
        coded = self.table("codes").where(F.col("doc_id").isin(ids))
        return codec.reconstruct(coded, self.table("centroids"), self.meta["weights"]).select("doc_id", "token_pos", "v").orderBy("doc_id", "token_pos")

    def search(self, queries: DataFrame, params: SearchParameters, subset: DataFrame | None = None) -> DataFrame:
        """query_id, rank, doc_id and score of queries(query_id, qtok, v)."""
        unit = queries.select("query_id", "qtok", V.normalize(V.doubles("v")).alias("v"))
        return search.staged(self.tokens(), self.table("codes"), self.table("ivf"), self.table("centroids"), unit, params, subset)

    def query(self, condition: str, params: list | tuple = ()) -> DataFrame:
        """Chunk metadata that satisfies a predicate, by id."""
        return where(self.chunks(), condition, params).orderBy("doc_id")

    # -- changing

    def append(self, tokens: DataFrame, chunks: DataFrame | None = None, batch: str | None = None) -> tuple[VectorIndex, list[int]]:
        """Token rows of new documents, numbered from 0; returns the new index and their ids (a contiguous range).

        Small indexes are rebuilt from their raw vectors, larger ones keep their centroids and codec.
        `batch` names what is appended; it is kept with the version, so that a replay can be told.
        """
        if tokens.isEmpty():
            return self, []
        n, version = self.num_documents, self.version + 1
        new = tokens.select((F.col("doc_id") + n).cast("long").alias("doc_id"), F.col("token_pos").cast("int").alias("token_pos"), "v")
        added = new.agg(F.max("doc_id")).first()[0] - n + 1
        all_chunks = self.chunks()
        if chunks is not None:
            more = metadata.register(chunks.withColumn("doc_id", (F.col("doc_id") + n).cast("long")))
            all_chunks = more if all_chunks is None else all_chunks.unionByName(more)
        if self._exists("raw"):
            old = self.table("raw")
            index = self._build(self.spark, self.path, version, old.unionByName(new.withColumn("v", V.doubles("v"))), self._config(), all_chunks, self.meta["model_id"], self.dim, batch)
            return index, list(range(n, n + added))
        at = f"{self.path}/v{version}"
        centroids = self.table("centroids")
        centroids.write.parquet(f"{at}/centroids")
        unit = new.select("doc_id", "token_pos", V.normalize(V.doubles("v")).alias("v"))
        rest = codec.residuals(codec.assign(unit, centroids), centroids)
        coded = codec.codes(rest, self.meta["cutoffs"]).select("doc_id", "token_pos", "centroid_id", F.transform("code", lambda c: c.cast("smallint")).alias("code"))
        self._write_tables(at, self.table("codes").unionByName(coded), all_chunks)
        return self._count_and_finish(version, batch), list(range(n, n + added))

    def _write_tables(self, at: str, coded: DataFrame, chunks: DataFrame | None) -> None:
        coded.write.parquet(f"{at}/codes")
        coded = self.spark.read.parquet(f"{at}/codes")
        codec.inverted_lists(coded).write.parquet(f"{at}/ivf")
        codec.document_lengths(coded).write.parquet(f"{at}/doclens")
        if chunks is not None:
            chunks.write.parquet(f"{at}/chunks")

    def _count_and_finish(self, version: int, batch: str | None = None) -> VectorIndex:
        docs, n = self.spark.read.parquet(f"{self.path}/v{version}/doclens").agg(F.max("doc_id"), F.sum("n_tokens")).first()
        m = self.meta
        row = (version, m["model_id"], m["dim"], m["nbits"], m["num_partitions"], docs + 1, n, n / (docs + 1), m["seed"], m["cutoffs"], m["weights"], m["centroids"], m["every"], batch or m["last_batch"])
        return self._finish(self.spark, self.path, version, row)

    def delete(self, ids: DataFrame | list[int]) -> tuple[VectorIndex | None, DataFrame]:
        """The index without the documents, survivors renumbered in order, and the ids deleted, ascending.

        Unknown ids are ignored; without any left the index stays; with all of them it is dropped.
        """
        if isinstance(ids, list):
            ids = self.spark.createDataFrame([(i,) for i in ids], "doc_id long")
        gone = mutate.sanitize(ids, self.num_documents).orderBy("doc_id").cache()
        n = gone.count()
        if not n:
            return self, gone
        if n == self.num_documents:
            self.drop(self.spark, self.path)
            return None, gone
        version = self.version + 1
        at = f"{self.path}/v{version}"
        self.table("centroids").write.parquet(f"{at}/centroids")
        if self._exists("raw"):
            mutate.remap(self.table("raw"), gone).write.parquet(f"{at}/raw")
        chunks = self.chunks()
        self._write_tables(at, mutate.remap(self.table("codes"), gone), None if chunks is None else mutate.remap(chunks, gone))
        return self._count_and_finish(version), gone

    def delete_named(self, name: str) -> tuple[VectorIndex | None, DataFrame]:
        return self.delete(metadata.by_name(self.chunks(), name).select("doc_id"))

    def documents(self) -> DataFrame:
        return metadata.documents(self.chunks())

    def state(self) -> DataFrame:
        """Totals of the index: chunks and embeddings."""
        return self.table("meta").select("num_documents", "num_embeddings", "dim", "num_partitions", "avg_doclen")
