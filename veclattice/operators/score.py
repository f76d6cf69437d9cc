"""Late-interaction scores: MaxSim, interaction matrices and top-k.

Query tokens are few and travel with the plan once their number is checked;
document tokens are scored where they lie, in Arrow batches by one matrix
product, reduced to each document's best before anything is shuffled.  Where
query tokens are many, a document's vectors meet in one row instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionMismatch
from ..functions import vectors as V

#: Numbers in the query block that may travel with the plan.
QUERY_BLOCK = 4_000_000
#: Numbers of one block of products.
BLOCK = 1_000_000
DECIMALS = 6
#: Query tokens up to which a document's best products are columns of a plan; of more they would outgrow its vectors.
COLUMNS = 256


def unit_tokens(tokens: DataFrame) -> DataFrame:
    """doc_id, token_pos and v as unit doubles."""
    return tokens.select("doc_id", "token_pos", V.normalize(V.doubles("v")).alias("v"))


def _block_rows(queries: DataFrame) -> list:
    """Query tokens in order; their numbers are counted before any vector comes to the driver."""
    if (queries.agg(F.sum(F.greatest(F.size("v"), F.lit(1)).cast("long"))).first()[0] or 0) > QUERY_BLOCK:
        raise ValueError("too many query tokens for one block; split the queries")
    return queries.select("query_id", "qtok", "v").orderBy("query_id", "qtok").collect()


class QueryBlock:
    """Query tokens as one matrix, ordered by query and token; all-zero rows are padding and score nothing."""

    def __init__(self, queries: DataFrame):
        rows = _block_rows(queries)
        sizes = {len(r[2]) for r in rows}
        if len(sizes) > 1:
            raise DimensionMismatch(*sorted(sizes)[:2])
        self.dim = sizes.pop() if sizes else 0
        real = [r for r in rows if any(r[2])]
        self.ids = sorted({r[0] for r in rows})
        self.query = np.array([r[0] for r in real], dtype=np.int64)
        self.matrix = np.array([r[2] for r in real], dtype=np.float64).reshape(len(real), self.dim)
        self.real_rows = {i: int((self.query == i).sum()) for i in self.ids}


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != dim * len(column):
        raise DimensionMismatch(dim, len(flat) // max(1, len(column)))
    return flat.reshape(-1, dim)


def token_best(documents: DataFrame, block: QueryBlock) -> DataFrame:
    """doc_id and best, the greatest product with each query token over the tokens of one batch."""
    matrix, dim = block.matrix, block.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # products of a part of a batch with all query tokens stay in one block
        room = max(1, BLOCK // max(1, len(matrix)))
        for batch in (b.slice(i, room) for b in batches for i in range(0, b.num_rows, room)):
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            products = _rows(batch.column(1), dim) @ matrix.T
            order = np.argsort(doc, kind="stable")
            doc, products = doc[order], products[order]
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            best = np.maximum.reduceat(products, first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(list(best), pa.list_(pa.float64()))], ["doc_id", "best"])

    return documents.select("doc_id", "v").mapInArrow(run, "doc_id long, best array<double>")


def whole_scores(documents: DataFrame, block: QueryBlock, keep: int | None = None) -> DataFrame:
    """query_id, doc_id and score, for many query tokens: products are made in blocks of whole documents.

    keep: of each part's documents only those that may be among a query's so many best, whatever rounding does to ties.
    """
    matrix, dim, ids = block.matrix, block.dim, np.array(block.ids, dtype=np.int64)
    sizes = np.array([block.real_rows[i] for i in block.ids], dtype=np.int64)
    starts = np.searchsorted(block.query, ids)

    def sums(v: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Document x query; a query's products are added in the order of its tokens."""
        best = np.maximum.reduceat(v @ matrix.T, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
        out = np.zeros((len(counts), len(ids)))
        for t in range(sizes.max()):
            own = np.flatnonzero(sizes > t)
            out[:, own] += best[:, starts[own] + t]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rows = max(1, BLOCK // len(matrix)), max(1, BLOCK // len(ids))
        for part in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
            ends = np.cumsum(part.column(1).to_numpy())
            scores, at = np.zeros((part.num_rows, len(ids))), 0
            while at < part.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + tokens, "right")))
                counts = np.diff(ends[at:to], prepend=before)
                flat = part.column(2).slice(at, to - at).flatten().to_numpy(zero_copy_only=False)
                if len(flat) != dim * counts.sum():
                    raise DimensionMismatch(dim, len(flat) // max(1, counts.sum()))
                scores[at:to] = sums(flat.reshape(-1, dim), counts)
                at = to
            wanted = np.ones(scores.shape, dtype=bool)
            if keep and keep < len(scores):
                # two scores that round to the same number are nearer than two of its last decimals
                wanted = ~(scores < np.partition(scores, -keep, axis=0)[-keep] - 2 * 10.0**-DECIMALS)
            d, q = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), part.column(0).take(pa.array(d)), pa.array(scores[d, q])], ["query_id", "doc_id", "score"])

    own = documents.select("doc_id", V.doubles("v").alias("v")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("v")).alias("v"))
    rows = own.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "v").mapInArrow(run, "query_id long, doc_id long, score double")
    return rows.select("query_id", "doc_id", F.round("score", DECIMALS).alias("score"))


def maxsim(documents: DataFrame, queries: DataFrame | QueryBlock, subset: DataFrame | None = None, keep: int | None = None) -> DataFrame:
    """query_id, doc_id and score: the sum over query tokens of the greatest product.

    documents: doc_id, v (one row a token).  subset(query_id, doc_id): the
    documents that a query may see; queries that it does not list see all.
    keep: documents that cannot be among a query's so many best may be left out.
    """
    block = queries if isinstance(queries, QueryBlock) else QueryBlock(queries)
    if subset is not None:
        # documents that no query may see are not scored, if each query names its own
        listed = {r[0] for r in subset.select("query_id").where(F.col("query_id").isin(block.ids)).distinct().collect()}
        if listed == set(block.ids):
            documents = documents.join(subset.where(F.col("query_id").isin(block.ids)).select("doc_id").distinct(), "doc_id", "left_semi")
    width = len(block.query)
    if width > COLUMNS:
        return restrict(whole_scores(documents, block, keep if subset is None else None), subset)
    best = token_best(documents, block)
    merged = best.groupBy("doc_id").agg(*[F.max(F.get("best", F.lit(k))).alias(f"b{k}") for k in range(width)])
    sums = []
    for i in block.ids:
        own = [F.col(f"b{k}") for k in range(width) if block.query[k] == i]
        sums.append(F.struct(F.lit(int(i)).cast("long").alias("query_id"), F.round(sum(own, F.lit(0.0)), DECIMALS).alias("score")))
    scores = merged.select("doc_id", F.inline(F.array(*sums))).select("query_id", "doc_id", "score") if sums else merged.selectExpr("cast(null as bigint) query_id", "doc_id", "0D score").where("false")
    return restrict(scores, subset)


def restrict(rows: DataFrame, subset: DataFrame | None) -> DataFrame:
    if subset is None:
        return rows
    listed = subset.select("query_id").distinct()
    return rows.join(subset.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").unionByName(rows.join(listed, "query_id", "left_anti"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id and score; ties go to the lower id.  Partial ranks are cut before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def search_exact(documents: DataFrame, queries: DataFrame, k: int, subset: DataFrame | None = None) -> DataFrame:
    return top_k(maxsim(documents, queries, subset, k), k)


def interaction_matrix(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, qtok, doc_id, token_pos and dot of every pair of tokens; queries are a checked block."""
    rows = _block_rows(queries)
    ids = [(r[0], r[1]) for r in rows]
    matrix = np.array([r[2] for r in rows], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, t = np.array([i for i, _ in ids], dtype=np.int64), np.array([j for _, j in ids], dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                products = _rows(part.column(2), matrix.shape[1]) @ matrix.T
                n = part.num_rows
                doc, pos = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(q, n)), pa.array(np.tile(t, n)), pa.array(np.repeat(doc, len(q))), pa.array(np.repeat(pos, len(q)).astype(np.int64)), pa.array(np.round(products, DECIMALS).ravel())], ["query_id", "qtok", "doc_id", "token_pos", "dot"])

    return documents.select("doc_id", "token_pos", "v").mapInArrow(run, "query_id long, qtok long, doc_id long, token_pos long, dot double")
