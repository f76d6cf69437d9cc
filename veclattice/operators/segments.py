"""An index of packed segments: appends write what they bring, deletes write bitmaps, searches read what they probe.

The folder of an index holds tables of which each segment has its own part:

  docs/seg/block      a row a document: its tokens' centroids, packed codes, lengths and distances
  vectors/seg/block   the unit vectors, if they are kept
  lists/seg/bucket    postings (centroid, block, documents and how far their tokens lie from it), laid out by centroid
  reach/seg           the farthest token of each centroid
  alive/seg/state     a row a block: survivors before it, and a bitmap of deleted documents
  chunks/seg          metadata

A document's place is its segment, block (`block` documents) and number in the
block; its id is dense: the rank of its place among the survivors, computed
from the bitmaps where it is read.  A version's manifest names the segments and
the state of each one's bitmaps; publishing it is one rename that fails if
the version is there, so a failed or late writer changes nothing.  The manifest also lists every batch
that a segment has taken, so a stream's batch is stored once, whatever the
order in which batches come again.  Of segments of one size (powers of `fan`)
the last `fan` are merged, so a document is rewritten as often as the index
has sizes; deleted ones go then.

Searches: `search` is staged search (probe, scores by centroids, cap, full
scores) over packed codes; `certified` gives the result of exact search.  Both
read the lists of the probed centroids (a partition filter on `bucket`) and the
blocks that hold candidates (one on `seg` and `block`).

Defined results: unknown ids are ignored by deletes; equal scores go to the
lower id; queries without a row other than zeros have no hits; documents
without tokens keep their id and are never found.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConcurrentWrite, DimensionMismatch, EmptyEmbeddingSet, EngineError, IndexNotFound, InvalidDocumentId, ModelMismatch
from ..functions import vectors as V
from ..schema import IndexConfig, SearchParameters
from . import codec, metadata, mutate
from .index import META, VectorIndex
from .packed import Encoder, Scorer
from .score import DECIMALS, QueryBlock, restrict, top_k

SEGMENT = "struct<seg: string, docs: bigint, alive: bigint, tokens: bigint, state: int, batches: array<string>>"
MANIFEST = f"{META}, codebook string, rebuild_up_to long, block int, bucket int, keep_vectors boolean, fan int, segments array<{SEGMENT}>"
DOCS = "block int, doc int, n_tokens int, centroids array<int>, codes binary, lengths array<double>, errors array<double>, near array<int>, reach array<double>"
VECTORS = "block int, doc int, n_tokens int, v binary"
LISTS = "bucket int, centroid_id int, block int, docs array<int>, reach array<double>"
ALIVE = "state int, block int, n int, before long, words array<bigint>"
#: Literals of a filter on blocks; more blocks than this are most of a table.
BLOCKS = 10_000
#: What rounding may add to a score or take from a bound.
SLACK = 2e-6


# -- bitmaps of deleted documents, 64 to a word; null where none is


def bit(doc: str) -> Column:
    """Whether a document of a block is deleted."""
    return F.expr(f"coalesce(shiftright(get(words, {doc} div 64), {doc} % 64) & 1L, 0L) = 1L")


def below(doc: str) -> Column:
    """How many documents before it in the block are deleted."""
    return F.expr(f"if(words is null, 0L, aggregate(slice(words, 1, cast({doc} div 64 as int)), 0L, (a, w) -> a + bit_count(w)) + bit_count(get(words, {doc} div 64) & (shiftleft(1L, {doc} % 64) - 1L)))")


def select_and_set(block: int, n: int, words: list[int] | None, ranks: list[int]) -> tuple[list[int], int]:
    """The bitmap after the survivors of such ranks go, and how many are left."""
    gone = np.zeros(block + 63 & ~63, dtype=bool)
    if words is not None:
        gone = np.unpackbits(np.array(words, dtype="<i8").view(np.uint8), bitorder="little").astype(bool)
    gone[np.flatnonzero(~gone[:n])[ranks]] = True
    return np.packbits(gone, bitorder="little").view("<i8").tolist(), int(n - gone[:n].sum())


@dataclass
class SegmentIndex(VectorIndex):
    # -- what a version holds

    @classmethod
    def open(cls, spark: SparkSession, path: str, model_id: str | None = None) -> SegmentIndex:
        version = cls._latest(spark, path)
        if version is None:
            raise IndexNotFound(path)
        fs, make = cls._fs(spark, path)
        marker = fs.open(make(f"{path}/published/v{version}"))
        meta = spark.read.parquet(f"{path}/{marker.readLine()}").first().asDict()
        marker.close()
        if model_id is not None and meta["model_id"] != model_id:
            raise ModelMismatch(f"the index was made with {meta['model_id']}, not {model_id}")
        return cls(spark, path, version, meta)

    @classmethod
    def _publish_manifest(cls, spark: SparkSession, path: str, version: int, manifest: str) -> None:
        """Names the manifest of a version by renaming a finished file, which fails if another writer was first."""
        fs, make = cls._fs(spark, path)
        draft, final = make(f"{path}/drafts/{uuid.uuid4().hex}"), make(f"{path}/published/v{version}")
        out = fs.create(draft, False)
        out.writeBytes(f"{manifest}\n")
        out.close()
        fs.mkdirs(final.getParent())
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        plain = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), plain)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            fs.delete(draft, False)
            raise ConcurrentWrite(f"version {version} was published by another writer") from None

    @property
    def segments(self) -> list:
        return self.meta["segments"]

    @property
    def batches(self) -> set[str]:
        """Names of all batches that were stored."""
        return {b for s in self.segments for b in s["batches"]}

    def _config(self) -> IndexConfig:
        m = self.meta
        return IndexConfig(nbits=m["nbits"], seed=m["seed"], centroids=m["centroids"], every=m["every"], rebuild_up_to=m["rebuild_up_to"], block=m["block"], bucket=m["bucket"], keep_vectors=m["keep_vectors"], fan=m["fan"])

    def _read(self, name: str, schema: str, segments: list | None = None) -> DataFrame:
        own = self.segments if segments is None else segments
        paths = [f"{self.path}/{name}/seg={s['seg']}" + (f"/state={s['state']}" if name == "alive" else "") for s in own]
        fs, make = self._fs(self.spark, self.path)
        paths = [p for p in paths if name != "chunks" or fs.exists(make(p))]
        if not paths:
            return self.spark.createDataFrame([], f"seg string, {schema}")
        return self.spark.read.schema(f"seg string, {schema}").option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _base(self, seg: Column) -> Column:
        """Survivors of the segments before."""
        pairs, at = [], 0
        for s in self.segments:
            pairs += [F.lit(s["seg"]), F.lit(at).cast("long")]
            at += s["alive"]
        return F.element_at(F.create_map(*pairs), seg)

    def alive(self, segments: list | None = None) -> DataFrame:
        """seg, block, n, base (survivors before the block) and words; a row for `block` documents."""
        return self._read("alive", ALIVE, segments).select("seg", "block", "n", (self._base(F.col("seg")) + F.col("before")).alias("base"), "words")

    def placed(self, rows: DataFrame, segments: list | None = None) -> DataFrame:
        """rows(seg, block, doc, ...) of survivors, with their dense doc_id."""
        both = rows.join(self.alive(segments), ["seg", "block"]).where(~bit("doc"))
        return both.withColumn("doc_id", F.col("base") + F.col("doc") - below("doc")).drop("n", "base", "words")

    def encoder(self) -> Encoder:
        _, matrix = codec.centroid_block(self.spark.read.parquet(f"{self.path}/{self.meta['codebook']}"))
        return Encoder(matrix, self.meta["cutoffs"], self.meta["weights"], self.meta["nbits"])

    def table(self, name: str) -> DataFrame:
        """Tables of a snapshot, by dense ids: doclens, ivf, centroids and meta."""
        if name == "doclens":
            return self.placed(self._read("docs", DOCS).select("seg", "block", "doc", "n_tokens")).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))
        if name == "ivf":
            rows = self._read("lists", LISTS).select("seg", "centroid_id", "block", F.explode("docs").alias("doc"))
            return self.placed(rows).groupBy(F.col("centroid_id").cast("long").alias("centroid_id")).agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"), F.count(F.lit(1)).alias("n"))
        if name == "centroids":
            return self.spark.read.parquet(f"{self.path}/{self.meta['codebook']}")
        if name == "meta":
            return self.spark.createDataFrame([tuple(self.meta[k] for k in ("num_documents", "num_embeddings", "dim", "num_partitions", "avg_doclen"))], "num_documents long, num_embeddings long, dim int, num_partitions long, avg_doclen double")
        raise EngineError(f"no table {name}")

    # -- building

    @classmethod
    def start(cls, spark: SparkSession, path: str, tokens: DataFrame, config: IndexConfig | None = None, chunks: DataFrame | None = None, model_id: str = "hash", dim: int | None = None, batch: str | None = None) -> SegmentIndex:
        """Like create, but an index that is there meanwhile stays, and is a concurrent write."""
        return cls._build(spark, path, 0, tokens, config or IndexConfig(), chunks, model_id, dim, batch)

    @classmethod
    def holds(cls, spark: SparkSession, path: str, batch: str) -> bool:
        """Whether there is an index at the path that has taken a batch."""
        try:
            return batch in cls.open(spark, path).batches
        except IndexNotFound:
            return False

    @classmethod
    def _build(cls, spark, path, version, tokens, config, chunks, model_id, dim, batch=None, batches: list[str] | None = None) -> SegmentIndex:
        unit = codec.units(tokens).persist()
        n, docs, least, most = unit.agg(F.count(F.lit(1)), F.max("doc_id"), F.min(F.size("v")), F.max(F.size("v"))).first()
        if not n:
            raise EmptyEmbeddingSet("an index needs at least one document")
        if least != most or (dim is not None and dim != most):
            raise DimensionMismatch(dim or most, least)
        k = codec.partitions_for(n)
        centroids = codec.every_nth(unit, config.every or max(1, n // k)) if config.centroids == "deterministic" else codec.kmeans_centroids(unit, k, config.kmeans_iterations, config.max_points_per_centroid, config.seed)
        codebook = f"codebook-{uuid.uuid4().hex}"
        # ids are places in the matrix
        centroids.orderBy("centroid_id").write.parquet(f"{path}/{codebook}")
        centroids = spark.read.parquet(f"{path}/{codebook}")
        ids, matrix = codec.centroid_block(centroids)
        if len(ids) and ids[-1] != len(ids) - 1:
            raise EngineError("centroid ids must be dense")
        rest = f"{path}/{codebook}-residuals"
        codec.rests(unit, (ids, matrix)).write.parquet(rest)
        edges, weights = codec.cutoffs(spark.read.parquet(rest), config.nbits)
        fs, make = cls._fs(spark, path)
        fs.delete(make(rest), True)
        row = {"version": version, "model_id": model_id, "dim": most, "nbits": config.nbits, "num_partitions": len(ids), "seed": config.seed, "cutoffs": edges, "weights": weights, "centroids": config.centroids, "every": config.every, "last_batch": batch, "codebook": codebook, "rebuild_up_to": config.rebuild_up_to, "block": config.block, "bucket": config.bucket, "keep_vectors": config.keep_vectors, "fan": config.fan, "segments": []}
        made = cls(spark, path, version, row)
        names = [*(batches or []), *([batch] if batch is not None else [])]
        segment = made._write_segment(unit, Encoder(matrix, edges, weights, config.nbits), docs + 1, chunks, names)
        unit.unpersist()
        return made._publish_with([segment], version, batch)

    def _write_segment(self, unit: DataFrame, encoder: Encoder, n_docs: int, chunks: DataFrame | None, batches: list[str]) -> dict:
        """Token rows of documents numbered from 0 as a new segment; nothing else of the index is read or written."""
        seg, block, keep = f"s{self.version}-{uuid.uuid4().hex[:12]}", self.meta["block"], self.meta["keep_vectors"]
        rows = unit.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token_pos", "v"))).alias("t"))
        rows = rows.select(F.expr(f"cast(doc_id div {block} as int)").alias("block"), F.expr(f"cast(doc_id % {block} as int)").alias("doc"), F.size("t").alias("n_tokens"), F.flatten(F.transform("t", lambda x: x["v"])).alias("flat"))
        coded = rows.mapInArrow(_encoding(encoder), f"{DOCS}, v binary").persist()
        self._write_docs(seg, coded)
        coded.unpersist()
        if chunks is not None:
            metadata.register(chunks).write.parquet(f"{self.path}/chunks/seg={seg}")
        return self._finish_segment(seg, n_docs, batches)

    def _write_docs(self, seg: str, coded: DataFrame) -> None:
        columns = [c for c in coded.columns if c not in ("v", "seg")]
        self._by_part(coded.select(*columns), "block", "doc").parquet(f"{self.path}/docs/seg={seg}")
        if self.meta["keep_vectors"]:
            self._by_part(coded.select("block", "doc", "n_tokens", "v"), "block", "doc").parquet(f"{self.path}/vectors/seg={seg}")

    @staticmethod
    def _by_part(rows: DataFrame, part: str, *order: str):
        # the number is named: parts are many small files, and few bytes would else be one task's
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(tasks, part).sortWithinPartitions(part, *order).write.partitionBy(part)

    def _finish_segment(self, seg: str, n_docs: int, batches: list[str]) -> dict:
        """Lists, reach and survivors of a segment whose documents are written."""
        block, bucket = self.meta["block"], self.meta["bucket"]
        docs = self._read("docs", DOCS, [{"seg": seg}])
        near = docs.select("block", "doc", F.explode(F.arrays_zip("near", "reach")).alias("x")).select("block", "doc", F.col("x.near").alias("centroid_id"), F.col("x.reach").alias("r"))
        # a posting holds one block's documents at most, however common the centroid
        lists = near.groupBy("centroid_id", "block").agg(F.array_sort(F.collect_list(F.struct("doc", "r"))).alias("x")).select(F.expr(f"cast(centroid_id div {bucket} as int)").alias("bucket"), "centroid_id", "block", F.col("x.doc").alias("docs"), F.col("x.r").alias("reach"))
        self._by_part(lists, "bucket", "centroid_id", "block").parquet(f"{self.path}/lists/seg={seg}")
        # from the documents: there are far more files of lists
        reach = near.groupBy("centroid_id").agg(F.max("r").alias("reach"))
        reach.write.parquet(f"{self.path}/reach/seg={seg}")
        fresh = self.spark.range(0, -(-n_docs // block)).select(F.col("id").cast("int").alias("block"), F.least(F.lit(block), n_docs - F.col("id") * block).cast("int").alias("n"), (F.col("id") * block).alias("before"), F.lit(None).cast("array<bigint>").alias("words"))
        fresh.coalesce(max(1, n_docs // block // 4096)).write.parquet(f"{self.path}/alive/seg={seg}/state=0")
        tokens = docs.agg(F.sum("n_tokens")).first()[0] or 0
        return {"seg": seg, "docs": n_docs, "alive": n_docs, "tokens": tokens, "state": 0, "batches": batches}

    def _publish_with(self, segments: list[dict], version: int, batch: str | None = None) -> SegmentIndex:
        docs, n = sum(s["alive"] for s in segments), sum(s["tokens"] for s in segments)
        row = self.meta | {"version": version, "num_documents": docs, "num_embeddings": n, "avg_doclen": n / max(1, docs), "last_batch": batch or self.meta["last_batch"], "segments": [{k: s[k] for k in ("seg", "docs", "alive", "tokens", "state", "batches")} for s in segments]}
        names = [f.strip().split(" ")[0].rstrip(":") for f in f"{META}, codebook string, rebuild_up_to long, block int, bucket int, keep_vectors boolean, fan int".split(", ")]
        values = tuple(row[k] for k in names) + ([tuple(s.values()) for s in row["segments"]],)
        manifest = f"manifests/v{version}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([values], MANIFEST).coalesce(1).write.parquet(f"{self.path}/{manifest}")
        self._publish_manifest(self.spark, self.path, version, manifest)
        return type(self).open(self.spark, self.path)

    # -- changing

    def append(self, tokens: DataFrame, chunks: DataFrame | None = None, batch: str | None = None) -> tuple[SegmentIndex, list[int]]:
        """Token rows of new documents, numbered from 0; returns the new index and their ids (a contiguous range).

        A batch that is in the ledger is not stored again and gets no ids.  While the index has at most rebuild_up_to
        documents and its vectors, it is built anew; else the codebook stays and one segment is written.
        """
        if batch is not None and batch in self.batches:
            return self, []
        n, version = self.num_documents, self.version + 1
        unit = codec.units(tokens).persist()
        added, least, most = unit.agg(F.max("doc_id") + 1, F.min(F.size("v")), F.max(F.size("v"))).first()
        if added is None:
            unit.unpersist()
            return self, []
        if least != self.dim or most != self.dim:
            raise DimensionMismatch(self.dim, most if least == self.dim else least)
        if n + added <= self.meta["rebuild_up_to"] and self.meta["keep_vectors"]:
            old, every = self.vectors(), self.chunks()
            more = None if chunks is None else metadata.register(chunks.withColumn("doc_id", (F.col("doc_id") + n).cast("long")))
            every = more if every is None else every if more is None else every.unionByName(more)
            both = old.unionByName(unit.withColumn("doc_id", F.col("doc_id") + n))
            index = self._build(self.spark, self.path, version, both, self._config(), every, self.meta["model_id"], self.dim, batch, sorted(self.batches))
            unit.unpersist()
            return index, list(range(n, n + added))
        made = replace(self, version=version)
        segment = made._write_segment(unit, self.encoder(), added, chunks, [batch] if batch is not None else [])
        unit.unpersist()
        index = self._publish_with([*map(_plain, self.segments), segment], version, batch)
        return index.compact(), list(range(n, n + added))

    def due(self) -> int:
        """How many of the last segments are to be merged: `fan` of one size, with the smaller ones after them."""
        fan = self.meta["fan"]
        sizes = [int(math.log(max(1, s["alive"]), fan)) for s in self.segments]
        for size in sorted(set(sizes)):
            k = next((i for i, x in enumerate(reversed(sizes)) if x > size), len(sizes))
            if sum(x == size for x in sizes[len(sizes) - k :]) >= fan:
                return k
        return 0

    def compact(self, last: int | None = None) -> SegmentIndex:
        """The last segments (those that are due, or so many) merged into one, without what is deleted."""
        k = self.due() if last is None else min(last, len(self.segments))
        if not k or (k == 1 and self.segments[-1]["alive"] == self.segments[-1]["docs"]):
            return self
        own, version, block = self.segments[-k:], self.version + 1, self.meta["block"]
        base, n = sum(s["alive"] for s in self.segments[:-k]), sum(s["alive"] for s in own)
        seg = f"s{version}-{uuid.uuid4().hex[:12]}"
        at = (F.col("doc_id") - base).alias("at")

        def moved(rows: DataFrame) -> DataFrame:
            out = self.placed(rows, own).withColumn("at", at).drop("seg", "block", "doc", "doc_id")
            return out.withColumn("block", F.expr(f"cast(at div {block} as int)")).withColumn("doc", F.expr(f"cast(at % {block} as int)")).drop("at")

        self._by_part(moved(self._read("docs", DOCS, own)), "block", "doc").parquet(f"{self.path}/docs/seg={seg}")
        if self.meta["keep_vectors"]:
            self._by_part(moved(self._read("vectors", VECTORS, own)), "block", "doc").parquet(f"{self.path}/vectors/seg={seg}")
        chunks = self.chunks(own)
        if chunks is not None:
            chunks.withColumn("doc_id", at).write.parquet(f"{self.path}/chunks/seg={seg}")
        segment = self._finish_segment(seg, n, sorted({b for s in own for b in s["batches"]}))
        return self._publish_with([*map(_plain, self.segments[:-k]), segment], version).compact()

    def delete(self, ids: DataFrame | list[int]) -> tuple[SegmentIndex | None, DataFrame]:
        """The index without the documents, survivors renumbered in order, and the ids deleted, ascending.

        Only bitmaps of the segments concerned are written.  Without any id left the index stays; with all it is dropped.
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
        version, block = self.version + 1, self.meta["block"]
        # ids meet blocks by the stretch of `block` ids in which both lie; survivors of a block reach into two at most
        alive = self.alive()
        left = F.col("n") - F.expr("if(words is null, 0L, aggregate(words, 0L, (a, w) -> a + bit_count(w)))")
        spans = alive.withColumn("left", left).where("left > 0").withColumn("stretch", F.explode(F.expr(f"sequence(base div {block}, (base + left - 1) div {block})")))
        found = gone.withColumn("stretch", F.expr(f"doc_id div {block}")).join(spans, "stretch").where("doc_id >= base and doc_id < base + left")
        ranks = found.groupBy("seg", "block").agg(F.collect_list((F.col("doc_id") - F.col("base")).cast("int")).alias("ranks"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(seg, b, *select_and_set(block, size, words, hit)) for seg, b, size, words, hit in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int64()))], ["seg", "block", "set", "kept"])

        new = alive.join(ranks, ["seg", "block"]).select("seg", "block", "n", "words", "ranks").mapInArrow(run, "seg string, block int, set array<bigint>, kept long")
        touched = {r[0] for r in ranks.select("seg").distinct().collect()}  # names of segments
        both = alive.where(F.col("seg").isin(touched)).withColumn("left", left).join(new, ["seg", "block"], "left")
        both = both.select("seg", F.lit(version).alias("state"), "block", "n", F.coalesce("set", "words").alias("words"), F.coalesce("kept", "left").alias("left"))
        # a row for `block` documents: their sums are small
        before = F.sum("left").over(Window.partitionBy("seg").orderBy("block")) - F.col("left")
        both.withColumn("before", before).drop("left").write.mode("append").partitionBy("seg", "state").parquet(f"{self.path}/alive")
        segments = [_plain(s) | ({"state": version} if s["seg"] in touched else {}) for s in self.segments]
        lost = dict(found.groupBy("seg").agg(F.count(F.lit(1))).collect())
        segments = [s | {"alive": s["alive"] - lost.get(s["seg"], 0)} for s in segments]
        made = replace(self, meta=self.meta | {"segments": segments})
        kept = dict(made.placed(made._read("docs", DOCS).select("seg", "block", "doc", "n_tokens")).groupBy("seg").agg(F.sum("n_tokens")).collect())
        segments = [s | {"tokens": kept.get(s["seg"], 0)} for s in segments if s["alive"]]
        return made._publish_with(segments, version), gone

    def vacuum(self) -> int:
        """Removes files that this version does not name; older versions can't be opened then.  How many folders went."""
        fs, make = self._fs(self.spark, self.path)
        live, gone = {s["seg"]: s["state"] for s in self.segments}, 0
        for name in ("docs", "vectors", "lists", "reach", "alive", "chunks"):
            for at in fs.globStatus(make(f"{self.path}/{name}/seg=*")) or []:
                seg = at.getPath().getName()[4:]
                parts = fs.globStatus(make(f"{self.path}/alive/seg={seg}/state=*")) if name == "alive" and seg in live else []
                for p in [p.getPath() for p in parts if int(p.getPath().getName()[6:]) != live[seg]] + ([at.getPath()] if seg not in live else []):
                    gone += bool(fs.delete(p, True))
        for at in fs.globStatus(make(f"{self.path}/manifests/v*")) or []:
            if int(at.getPath().getName()[1:].split("-")[0]) < self.version:
                fs.delete(at.getPath(), True)
        for v in range(self.version):
            fs.delete(make(f"{self.path}/published/v{v}"), False)
        return gone

    # -- reading

    def chunks(self, segments: list | None = None) -> DataFrame | None:
        own = self.segments if segments is None else segments
        fs, make = self._fs(self.spark, self.path)
        if not any(fs.exists(make(f"{self.path}/chunks/seg={s['seg']}")) for s in own):
            return None
        from ..schema import CHUNKS

        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNKS)
        rows, block = self._read("chunks", kind, own), self.meta["block"]
        rows = rows.withColumn("block", F.expr(f"cast(doc_id div {block} as int)")).withColumn("doc", F.expr(f"cast(doc_id % {block} as int)")).drop("doc_id")
        return self.placed(rows, own).select(*[f.name for f in CHUNKS])

    def _token_rows(self, rows: DataFrame, decode: Callable) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    counts = part.column(1).to_numpy()
                    v = decode(part, counts)
                    pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), counts)), pa.array(pos.astype(np.int32)), pa.array(list(v), pa.list_(pa.float64()))], ["doc_id", "token_pos", "v"])

        return rows.mapInArrow(run, "doc_id long, token_pos int, v array<double>")

    def vectors(self) -> DataFrame:
        """The unit vectors that were stored, one row a token, numbered anew in each document."""
        if not self.meta["keep_vectors"]:
            raise EngineError("the index does not keep vectors")
        dim = self.dim
        rows = self.placed(self._read("vectors", VECTORS)).select("doc_id", "n_tokens", "v")
        return self._token_rows(rows, lambda part, counts: _bytes(part.column(2), np.float64).reshape(-1, dim))

    def tokens(self) -> DataFrame:
        """De-quantised unit vectors of all tokens."""
        encoder = self.encoder()
        rows = self.placed(self._read("docs", DOCS).select("seg", "block", "doc", "n_tokens", "centroids", "codes", "lengths")).select("doc_id", "n_tokens", "centroids", "codes", "lengths")
        return self._token_rows(rows, lambda part, counts: encoder.decode(*_coded(part, 2)))

    def reconstruct(self, ids: list[int]) -> DataFrame:
        bad = [i for i in ids if not 0 <= i < self.num_documents]
        if bad:
            raise InvalidDocumentId(bad[0])
        return self.tokens().where(F.col("doc_id").isin(ids)).orderBy("doc_id", "token_pos")

    def _queries(self, queries: DataFrame) -> QueryBlock:
        block = QueryBlock(queries.select("query_id", "qtok", V.normalize(V.doubles("v")).alias("v")))
        if len(block.query) and block.dim != self.dim:
            raise DimensionMismatch(self.dim, block.dim)
        return block

    def _scorers(self, queries: DataFrame) -> Iterator[tuple[Scorer, np.ndarray]]:
        """The scorer of the queries that have a row other than zeros, and the queries' tokens; none without such queries."""
        block = self._queries(queries)
        ids = [i for i in block.ids if block.real_rows[i]]
        if ids:
            yield Scorer.of(ids, block.query, block.matrix, self.encoder()), block.matrix

    def candidates(self, probed: dict[int, list[int]] | DataFrame, scorer: Scorer, subset: DataFrame | None = None) -> DataFrame:
        """seg, block, doc, doc_id and qs (queries, by their place) of the survivors in the lists of probed centroids.

        probed: the queries that probe a centroid (as rows: centroid_id, qs).  Only the files of their buckets are read.
        """
        bucket = self.meta["bucket"]
        wanted = self.spark.createDataFrame(list(probed.items()), "centroid_id int, qs array<int>") if isinstance(probed, dict) else probed
        ids = sorted(probed) if isinstance(probed, dict) else sorted(r[0] for r in wanted.select("centroid_id").limit(BLOCKS + 1).collect())
        lists = self._read("lists", LISTS)
        if len(ids) <= BLOCKS:
            lists = lists.where(F.col("bucket").isin(sorted({c // bucket for c in ids})) & F.col("centroid_id").isin(ids))
        rows = lists.join(wanted, "centroid_id").select("seg", "block", F.explode("docs").alias("doc"), "qs")
        # a document has as many rows as centroids: queries meet in arrays and never as pairs
        rows = rows.groupBy("seg", "block", "doc").agg(F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
        return self._seen_by(self.placed(rows), scorer, subset)

    def _all(self, queries: list[int], scorer: Scorer, subset: DataFrame | None) -> DataFrame:
        """Like candidates of queries that probe all lists, with the documents' own columns; no list is read."""
        rows = self.placed(self._read("docs", DOCS)).withColumn("qs", F.lit(queries).cast("array<int>"))
        # small blocks are many small parts of a scan, each of which would get the scorer
        return self._seen_by(rows.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))), scorer, subset)

    def _seen_by(self, rows: DataFrame, scorer: Scorer, subset: DataFrame | None) -> DataFrame:
        """rows whose qs are those that may see the document; queries that subset does not list see all."""
        if subset is None:
            return rows
        place = self.spark.createDataFrame([*enumerate(map(int, scorer.ids))], "q int, query_id long")
        allowed = subset.select("query_id", "doc_id").join(F.broadcast(place), "query_id").select("q", "doc_id")
        listed = [r[0] for r in subset.select("query_id").distinct().join(F.broadcast(place), "query_id").select("q").collect()]  # queries of the scorer
        own = allowed.groupBy("doc_id").agg(F.collect_set("q").alias("own"))
        bound = F.lit(listed).cast("array<int>") if listed else F.array().cast("array<int>")
        qs = F.concat(F.array_except("qs", bound), F.array_intersect("qs", F.coalesce("own", F.array().cast("array<int>"))))
        return rows.join(own, "doc_id", "left").withColumn("qs", qs).drop("own").where("size(qs) > 0")

    def _at(self, name: str, schema: str, wanted: DataFrame) -> DataFrame:
        """Rows of a table of blocks for wanted(seg, block, doc, ...): only the blocks that hold any are read."""
        rows = self._read(name, schema)
        parts = wanted.select("seg", "block").distinct().limit(BLOCKS + 1).collect()
        if len(parts) <= BLOCKS:
            by: dict[str, list[int]] = {}
            for seg, block in parts:
                by.setdefault(seg, []).append(block)
            near = F.lit(False)
            for seg, blocks in sorted(by.items()):
                near = near | ((F.col("seg") == seg) & F.col("block").isin(sorted(blocks)))
            rows = rows.where(near)
        return rows.join(wanted, ["seg", "block", "doc"])

    def _scored(self, rows: DataFrame, columns: list[str], sums: Callable[[pa.RecordBatch, np.ndarray, Scorer], np.ndarray], scorer: Scorer, best: int | None = None, floors: np.ndarray | None = None) -> DataFrame:
        """q, seg, block, doc, doc_id and score of the wanted pairs, from what `sums` makes of a batch's documents for a tile of queries.

        best: of each query no more pairs than so many leave a part of a batch.  floors: lesser scores of a query don't.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch, row, q, total in scorer.pairs(whole, 4, 5, sums):
                    kept = np.arange(len(q)) if floors is None else np.flatnonzero(total >= floors[q])
                    if best is not None:
                        kept = kept[_leading(q[kept], total[kept], batch.column(3).to_numpy()[row[kept]], best)]
                    yield pa.RecordBatch.from_arrays([pa.array(q[kept]), *(batch.column(c).take(pa.array(row[kept])) for c in range(4)), pa.array(total[kept])], ["q", "seg", "block", "doc", "doc_id", "score"])

        return rows.select("seg", "block", "doc", "doc_id", "qs", "n_tokens", *columns).mapInArrow(run, "q int, seg string, block int, doc int, doc_id long, score double")

    def _named(self, scores: DataFrame, scorer: Scorer) -> DataFrame:
        names = self.spark.createDataFrame([*enumerate(map(int, scorer.ids))], "q int, query_id long")
        return scores.join(F.broadcast(names), "q").select("query_id", "doc_id", F.round("score", DECIMALS).alias("score"))

    def search(self, queries: DataFrame, params: SearchParameters, subset: DataFrame | None = None) -> DataFrame:
        """query_id, rank, doc_id and score of queries(query_id, qtok, v) by staged search over packed codes."""
        out = None
        for scorer, _ in self._scorers(queries):
            part = top_k(self._named(self._staged(scorer, params, subset), scorer), params.top_k)
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], "query_id long, rank long, doc_id long, score double") if out is None else out

    def _probes(self, scorer: Scorer, queries: list[int], n: int, radius: np.ndarray | None = None) -> DataFrame:
        """centroid_id and q (null: a row with `rest`) of each query token's n best centroids.

        Best by product, or, with a radius of each centroid, by the greatest product that a token so far from it may have;
        rest is then the sum of the best bounds that were not probed.
        """
        spans, encoder, matrix, lengths = scorer.spans(), scorer.encoder, scorer.matrix, scorer.lengths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q in batch.column(0).to_pylist():
                    a, b = spans[q]
                    found, rest = [], 0.0
                    for t in range(a, b):
                        worth = encoder.centroids @ matrix[t]
                        worth = np.round(worth, 9) if radius is None else worth + radius * lengths[t]
                        order = np.argsort(-worth, kind="stable")
                        found.append(order[:n])
                        rest += worth[order[n]] if n < len(order) else -np.inf
                    ids = np.unique(np.concatenate(found))
                    yield pa.RecordBatch.from_arrays([pa.array([*ids.tolist(), None], pa.int32()), pa.array(np.full(len(ids) + 1, q, dtype=np.int32)), pa.array([*[None] * len(ids), float(rest)], pa.float64())], ["centroid_id", "q", "rest"])

        rows = self.spark.createDataFrame([(q,) for q in queries], "q int").repartition(max(1, min(len(queries), int(self.spark.conf.get("spark.sql.shuffle.partitions")))))
        return rows.mapInArrow(run, "centroid_id int, q int, rest double")

    def _left(self, scorer: Scorer, counts: list[int], radius: np.ndarray) -> dict[tuple[int, int], float]:
        """Of each query and number of probes, the sum of the best bounds that are not probed, as `_probes` has it."""
        spans, encoder, matrix, lengths = scorer.spans(), scorer.encoder, scorer.matrix, scorer.lengths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q in batch.column(0).to_pylist():
                    rest = np.zeros(len(counts))
                    for t in range(*spans[q]):
                        rest += -np.sort(-(encoder.centroids @ matrix[t] + radius * lengths[t]))[counts]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), q, dtype=np.int32)), pa.array(counts, pa.int32()), pa.array(rest)], ["q", "n", "rest"])

        rows = self.spark.createDataFrame([(q,) for q in range(len(spans))], "q int").repartition(max(1, min(len(spans), int(self.spark.conf.get("spark.sql.shuffle.partitions")))))
        return {(q, n): rest for q, n, rest in rows.mapInArrow(run, "q int, n int, rest double").collect()}

    def _staged(self, scorer: Scorer, params: SearchParameters, subset: DataFrame | None) -> DataFrame:
        probed = self._probes(scorer, list(range(len(scorer.ids))), params.n_ivf_probe).where("centroid_id is not null").groupBy("centroid_id").agg(F.collect_list("q").alias("qs")).persist()
        candidates = self.candidates(probed, scorer, subset)
        threshold = params.centroid_score_threshold

        def rough(part: pa.RecordBatch, counts: np.ndarray, tile: Scorer) -> np.ndarray:
            column = part.column(6)
            ids, where = np.unique(column.flatten().to_numpy(), return_inverse=True)
            return np.round(tile.sums(tile.near(ids, threshold)[where], np.diff(column.offsets.to_numpy())), DECIMALS)

        first = self._scored(self._at("docs", DOCS, candidates), ["near"], rough, scorer, params.n_full_scores)
        w = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
        kept = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= params.n_full_scores)
        kept = kept.groupBy("seg", "block", "doc", "doc_id").agg(F.collect_list("q").alias("qs")).persist()
        return self._scored(self._at("docs", DOCS, kept), ["centroids", "codes", "lengths"], lambda part, counts, tile: tile.sums(tile.products(*_coded(part, 6)), counts), scorer)

    def certified(self, queries: DataFrame, k: int = 5, probes: int = 8, subset: DataFrame | None = None) -> tuple[DataFrame, list[dict]]:
        """Exactly the k best of exact search, and for each query how many documents were candidates and how many were scored.

        A token lies within its distance from its packed form, and within its centroid's reach from the centroid.  So a
        candidate's score is at most the sum of best packed products plus distances; candidates are scored by falling
        bound until the k-th score passes what is left.  A document in no probed list scores at most the sum of the best
        unprobed bounds; while that could enter the k best, four times as many lists are probed.  Where those bounds reach
        the greatest score that a query can have, no document is scored for it until more lists are probed.
        """
        if not self.meta["keep_vectors"]:
            raise EngineError("exact scores need an index that keeps vectors")
        reach = dict(self._read("reach", "centroid_id int, reach double").groupBy("centroid_id").agg(F.max("reach")).collect())  # as many as centroids
        out, reports = None, []
        for scorer, _ in self._scorers(queries):
            radius = np.full(len(scorer.encoder.centroids), -np.inf)
            radius[list(reach)] = list(reach.values())
            out, reports = self._certify(scorer, radius, len(reach), k, probes, subset)
        empty = self.spark.createDataFrame([], "query_id long, rank long, doc_id long, score double")
        return (empty if out is None else out), reports

    def _certify(self, scorer: Scorer, radius: np.ndarray, lists: int, k: int, probes: int, subset: DataFrame | None) -> tuple[DataFrame, list[dict]]:
        open_, n, out, report, total = list(range(len(scorer.ids))), probes, None, [], self.num_documents

        def exact(part: pa.RecordBatch, counts: np.ndarray, tile: Scorer) -> np.ndarray:
            return tile.sums(_bytes(part.column(6), np.float64).reshape(-1, tile.matrix.shape[1]) @ tile.matrix.T, counts)

        def upper(part: pa.RecordBatch, counts: np.ndarray, tile: Scorer) -> np.ndarray:
            products = tile.products(*_coded(part, 6))
            return tile.sums(products + part.column(9).flatten().to_numpy()[:, None] * tile.lengths, counts)

        coded = ["centroids", "codes", "lengths", "errors"]
        rounds = []
        while 2 * n <= lists:  # beyond half of the lists, all documents are read as they lie
            rounds.append(n)
            n *= 4
        # no vector is longer than one: a query's score is at most the sum of its tokens' lengths
        ceiling = np.add.reduceat(scorer.lengths, scorer.starts)
        left = self._left(scorer, rounds, radius) if rounds else {}
        for n in [*rounds, lists]:
            now = [q for q in open_ if n == lists or left[q, n] < ceiling[q]]
            if not now:
                continue
            unseen, held = {}, []
            if n < lists:
                probed = self._probes(scorer, now, n, radius).persist()
                unseen = dict(probed.where("centroid_id is null").select("q", "rest").collect())
                wanted = probed.where("centroid_id is not null").groupBy("centroid_id").agg(F.collect_list("q").alias("qs"))
                seen = self.candidates(wanted, scorer, subset).persist()
                held, rows = [probed, seen], self._at("docs", DOCS, seen)
            else:
                # each list is probed by all: the documents are read as they lie
                seen = rows = self._all(now, scorer, subset)
            # of documents seen by the same queries one row is left
            counts = dict(seen.groupBy("qs").count().select(F.explode("qs").alias("q"), "count").groupBy("q").agg(F.sum("count")).collect())
            # bounds are made twice, so that no more of them are kept than lead or reach the floor
            w = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
            first = self._scored(rows, coded, upper, scorer, best=2 * k)
            first = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * k).persist()
            lead = self._exact(first, exact, scorer).persist()
            w = Window.partitionBy("q").orderBy(F.desc("score"))
            least = dict(lead.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("q", "score").collect())
            # all candidates whose bound reaches the k-th score so far; fewer than k leave none out
            floors = np.array([least.get(q, -1e300) - SLACK for q in range(len(scorer.ids))])
            rest = self._scored(rows, coded, upper, scorer, floors=floors).join(first.select("q", "doc_id"), ["q", "doc_id"], "left_anti").persist()
            scores = lead.unionByName(self._exact(rest, exact, scorer)).persist()
            scored = dict(scores.groupBy("q").count().collect())
            ends = dict(scores.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("q", "score").collect())
            done = []
            for q in now:
                if n >= lists or ends.get(q, -np.inf) - SLACK > unseen[q]:
                    done.append(q)
                    report.append({"query_id": int(scorer.ids[q]), "documents": total, "candidates": counts.get(q, 0), "scored": scored.get(q, 0), "probes": n})
            if done:
                part = top_k(self._named(scores.where(F.col("q").isin(done)), scorer), k)
                # few rows: they are kept and what they came from is not
                kept = self.spark.createDataFrame(part.collect(), part.schema)
                out = kept if out is None else out.unionByName(kept)
            for df in (scores, rest, lead, first, *held):
                df.unpersist()
            open_ = [q for q in open_ if q not in done]
        return out, report

    def _exact(self, pairs: DataFrame, exact: Callable, scorer: Scorer) -> DataFrame:
        wanted = pairs.groupBy("seg", "block", "doc", "doc_id").agg(F.collect_list("q").alias("qs"))
        return self._scored(self._at("vectors", VECTORS, wanted), ["v"], exact, scorer)

    def stored_bytes(self, name: str) -> int:
        """Bytes of a table's files, of the segments of this version."""
        fs, make = self._fs(self.spark, self.path)
        return sum(fs.getContentSummary(make(f"{self.path}/{name}/seg={s['seg']}")).getLength() for s in self.segments)


def _plain(segment) -> dict:
    return segment if isinstance(segment, dict) else segment.asDict()


def _leading(q: np.ndarray, score: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Places of each query's n greatest scores; equal ones by document."""
    order = np.lexsort((doc, -score, q))
    starts = np.flatnonzero(np.diff(q[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < n]


def _bytes(column: pa.Array, kind: type) -> np.ndarray:
    """The values of binary rows, one after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].view(kind)


def _coded(part: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids, packed codes and lengths of a batch's tokens, from three columns."""
    best = part.column(at).flatten().to_numpy()
    return best, _bytes(part.column(at + 1), np.uint8).reshape(len(best), -1), part.column(at + 2).flatten().to_numpy()


def _encoding(encoder: Encoder) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = encoder.centroids.shape[1]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                counts = part.column(2).to_numpy()
                v = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                best, packed, length, error, reach = encoder.encode(v)
                ends = np.concatenate([[0], np.cumsum(counts)])
                near, far = [], []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    ids, where = np.unique(best[a:b], return_inverse=True)
                    most = np.zeros(len(ids))
                    np.maximum.at(most, where, reach[a:b])
                    near.append(ids)
                    far.append(most)
                listed = lambda x, t: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x, t))
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in range(3)), listed(best, pa.int32()), cut(packed), listed(length, pa.float64()), listed(error, pa.float64()), pa.array(near, pa.list_(pa.int32())), pa.array(far, pa.list_(pa.float64())), cut(v)],
                    ["block", "doc", "n_tokens", "centroids", "codes", "lengths", "errors", "near", "reach", "v"],
                )

    return run
