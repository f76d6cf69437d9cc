"""Staged search: probe centroids, score candidates by their centroids, cap them, score the rest in full.

Query tokens (a checked block) and centroids travel with functions; products are made in blocks where documents lie, and a
document meets its queries as an array, so that no rows of query x centroid or of pairs x tokens are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import SearchParameters
from .codec import centroid_block
from .packed import PRODUCTS, Encoder, Scorer
from .score import DECIMALS, QueryBlock, restrict, top_k


def scorer_of(centroids: DataFrame, queries: DataFrame) -> tuple[Scorer, np.ndarray]:
    """The scorer of the queries with a row other than zeros, and the centroids' ids."""
    block = QueryBlock(queries)
    ids, matrix = centroid_block(centroids)
    return Scorer.of([i for i in block.ids if block.real_rows[i]], block.query, block.matrix, Encoder(matrix, [], [], 8)), ids


def probe(centroids: DataFrame, scorer: Scorer, lists: DataFrame, n_probe: int) -> DataFrame:
    """doc_id and qs, the places of the queries whose candidate it is: documents in the lists of each query token's best centroids."""
    matrix, spans = scorer.matrix, scorer.spans()
    listed = lists.select("centroid_id", "doc_ids")
    if n_probe >= len(scorer.encoder.centroids):  # every list of a known centroid, for every query: nothing to rank
        own = listed.join(centroids.select("centroid_id"), "centroid_id", "left_semi").select(F.explode("doc_ids").alias("doc_id")).distinct()
        return own.select("doc_id", F.sequence(F.lit(0), F.lit(len(spans) - 1)).alias("qs"))
    owner = np.repeat(np.arange(len(spans), dtype=np.int32), [b - a for a, b in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy())
            ids, v = batch.column(0).to_numpy()[order], batch.column(1).flatten().to_numpy().reshape(len(order), -1)[order]
            room = max(1, PRODUCTS // len(ids))
            for i in range(0, len(matrix), room):
                near = np.round(matrix[i : i + room] @ v.T, 9)
                best = np.argsort(-near, axis=1, kind="stable")[:, :n_probe]
                rows = np.repeat(np.arange(i, i + len(best)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(owner[rows]), pa.array(rows.astype(np.int32)), pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(near, best, 1).ravel())], ["q", "row", "centroid_id", "s"])

    near = centroids.select(F.col("centroid_id").cast("long").alias("centroid_id"), V.doubles("v").alias("v")).mapInArrow(run, "q int, row int, centroid_id long, s double")
    w = Window.partitionBy("row").orderBy(F.desc("s"), "centroid_id")
    best = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n_probe)
    probed = best.groupBy("centroid_id").agg(F.collect_set("q").alias("qs"))
    found = probed.join(listed, "centroid_id").select(F.explode("doc_ids").alias("doc_id"), "qs")
    return found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))


def pairs(seen: DataFrame, scorer: Scorer) -> DataFrame:
    """query_id and doc_id of the queries of each document."""
    return seen.select(F.explode("qs").alias("q"), "doc_id").select(_query_id(scorer), "doc_id")


def _query_id(scorer: Scorer):
    return F.get(F.lit([int(i) for i in scorer.ids]).cast("array<bigint>") if scorer.ids else F.array().cast("array<bigint>"), F.col("q")).alias("query_id")


def _seen(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id and qs of rows(query_id, doc_id)."""
    place = rows.sparkSession.createDataFrame([*enumerate(map(int, scorer.ids))], "q int, query_id long")
    return rows.join(F.broadcast(place), "query_id").groupBy("doc_id").agg(F.collect_list("q").alias("qs"))


def _scored(rows: DataFrame, sums: Callable, scorer: Scorer) -> DataFrame:
    """query_id, doc_id and score of the pairs of rows(doc_id, qs, n, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, row, q, total in scorer.pairs(whole, 1, 2, sums):
                yield pa.RecordBatch.from_arrays([pa.array(q), batch.column(0).take(pa.array(row)), pa.array(total)], ["q", "doc_id", "score"])

    return rows.mapInArrow(run, "q int, doc_id long, score double").select(_query_id(scorer), "doc_id", F.round("score", DECIMALS).alias("score"))


def approximate(seen: DataFrame, lists: DataFrame, scorer: Scorer, ids: np.ndarray, threshold: float | None) -> DataFrame:
    """query_id, doc_id and score of candidates from centroid scores alone; tokens of pruned centroids count 0."""
    placed = lists.select(F.explode("doc_ids").alias("doc_id"), F.col("centroid_id").cast("long").alias("centroid_id")).groupBy("doc_id").agg(F.collect_list("centroid_id").alias("near"))

    def rough(part: pa.RecordBatch, counts: np.ndarray, tile: Scorer) -> np.ndarray:
        used, where = np.unique(np.searchsorted(ids, part.column(3).flatten().to_numpy()), return_inverse=True)
        # sums of numbers with nine decimals: the order of adding does not decide ties
        return np.round(tile.sums(tile.near(used, threshold)[where], counts), 9)

    return _scored(seen.join(placed, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "qs", F.size("near").alias("n"), "near"), rough, scorer)


def full(tokens: DataFrame, kept: DataFrame, scorer: Scorer) -> DataFrame:
    """query_id, doc_id and score of the pairs kept(query_id, doc_id), by all tokens(doc_id, v) of the document."""
    own = tokens.select("doc_id", V.doubles("v").alias("v")).join(kept.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("v").alias("t"))
    rows = own.join(_seen(kept, scorer), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "qs", F.size("t").alias("n"), F.flatten("t").alias("v"))
    return _scored(rows, lambda part, counts, tile: tile.sums(part.column(3).flatten().to_numpy().reshape(counts.sum(), -1) @ tile.matrix.T, counts), scorer)


def cap(scored: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def staged(tokens: DataFrame, assigned: DataFrame, lists: DataFrame, centroids: DataFrame, queries: DataFrame, params: SearchParameters, subset: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id and score.

    tokens: the (reconstructed) unit token vectors that are scored in full.  assigned: what the lists were made of.
    Only tokens of capped candidates are scored; with all centroids probed, no
    threshold and no cap the result is that of exact search over tokens.
    """
    scorer, ids = scorer_of(centroids, queries)
    if not scorer.ids:
        return centroids.sparkSession.createDataFrame([], "query_id long, rank long, doc_id long, score double")
    seen = probe(centroids, scorer, lists, params.n_ivf_probe)
    if subset is not None:
        seen = _seen(restrict(pairs(seen, scorer), subset), scorer)
    kept = cap(approximate(seen, lists, scorer, ids, params.centroid_score_threshold), params.n_full_scores)
    return top_k(full(tokens, kept.select("query_id", "doc_id"), scorer), params.top_k)
