"""Deletes and dense renumbering.

The new id of a survivor is its old id less the number of deleted ids below
it.  Deleted ids are counted in blocks, so each survivor joins one row of
counts and one short sorted list, whatever share of the index goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

BLOCK = 4096


def sanitize(ids: DataFrame, n: int) -> DataFrame:
    """Distinct ids from 0 up to n."""
    return ids.select(F.col("doc_id").cast("long").alias("doc_id")).where((F.col("doc_id") >= 0) & (F.col("doc_id") < n)).distinct()


def remap(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """rows without the deleted ids, doc_id renumbered."""
    block = F.floor(F.col("doc_id") / BLOCK)
    gone = deleted.select("doc_id").distinct().groupBy(block.alias("b")).agg(F.array_sort(F.collect_list("doc_id")).alias("gone"), F.count(F.lit(1)).alias("n"))
    spark = rows.sparkSession
    last = rows.agg(F.max("doc_id")).first()[0]
    frame = spark.range(0, (last or 0) // BLOCK + 1).select(F.col("id").alias("b")).join(gone, "b", "left")
    counted = frame.select("b", F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"), (F.coalesce(F.sum("n").over(Window.orderBy("b")), F.lit(0)) - F.coalesce("n", F.lit(0))).alias("before"))  # one row for BLOCK ids
    here = rows.withColumn("b", block).join(counted, "b").where(~F.array_contains("gone", F.col("doc_id")))
    new = F.col("doc_id") - F.col("before") - F.size(F.filter("gone", lambda d: d < F.col("doc_id")))
    return here.withColumn("doc_id", new.cast("long")).select(*rows.columns)


def append_ids(rows: DataFrame, n: int, order: str) -> DataFrame:
    """rows with doc_id from n on, in the order of a unique column; ranks are taken in blocks of equal range, not in one task."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the ranges are sampled anew in each run: they are kept
    ranged = checkpointed(rows.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    base, at = {}, n
    for p, size in sorted(map(tuple, ranged.groupBy("part").count().collect())):  # a row for each partition
        base[p] = at
        at += size
    start = F.element_at(F.create_map(*[x for p, b in base.items() for x in (F.lit(p), F.lit(b))]), F.col("part")) if base else F.lit(n)
    return ranged.withColumn("doc_id", (start + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1).cast("long")).drop("part")
