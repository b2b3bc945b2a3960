"""Ranks over whole tables without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.operators.files import cut


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place`` (from 1) in ``order``, which must be total, and ``n_rows``.

    Rows are dealt out by ranges of the order and written once; each range is numbered by itself, and the counts
    of the ranges before it, one row per partition, are added.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    everywhere = Window.orderBy("_part")
    offsets = counts.select("_part", (F.sum("_n").over(everywhere) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n_rows"))
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def first_tile(df: DataFrame, tiles: int, *order: Column) -> DataFrame:
    """The rows of the first of ``tiles`` equal parts in ``order``; the first parts are the larger ones."""
    size = F.floor((F.col("n_rows") + tiles - 1) / tiles)
    return ranked(df, *order).where(F.col("place") <= size).drop("place", "n_rows")
