"""Ranking quality and the graded corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the topic in each grade.
GRADES = (1.0, 0.82, 0.64, 0.46, 0.28)


def overlap_at_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id and overlap, the share of a's first k documents that are among b's; 1 if both are empty, 0 if a is."""
    x = a.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("doc_id").alias("x"))
    y = b.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("doc_id").alias("y"))
    both = x.join(y, "query_id", "full").select("query_id", F.coalesce("x", F.array().cast("array<bigint>")).alias("x"), F.coalesce("y", F.array().cast("array<bigint>")).alias("y"))
    share = F.size(F.array_intersect("x", "y")) / F.size("x")
    return both.select("query_id", F.when(F.size("x") == 0, F.when(F.size("y") == 0, 1.0).otherwise(0.0)).otherwise(share).alias("overlap"))


def top_1_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.where("rank = 1").select("query_id", F.col("doc_id").alias("x"))
    return x.join(b.where("rank = 1").select("query_id", F.col("doc_id").alias("y")), "query_id", "left").select("query_id", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("agrees"))


def graded_corpus(topics: int = 6, dim: int = 64, tokens: int = 8, seed: int = 42) -> tuple[list[tuple], list[tuple]]:
    """Token rows (doc_id, token_pos, v) and query rows (query_id, qtok, v): the best document of query i is 5 i."""
    rng = np.random.default_rng(seed)
    docs, queries = [], []
    for t in range(topics):
        topic = rng.normal(size=dim)
        topic /= np.linalg.norm(topic)
        other = rng.normal(size=dim)
        other -= (other @ topic) * topic
        other /= np.linalg.norm(other)
        for g, a in enumerate(GRADES):
            base = a * topic + np.sqrt(1 - a * a) * other
            for p in range(tokens):
                v = base + rng.uniform(-0.02, 0.02, dim)
                docs.append((t * len(GRADES) + g, p, (v / np.linalg.norm(v)).tolist()))
        queries.append((t, 0, topic.tolist()))
    return docs, queries
