"""Tasks whose size follows from the rows, not from how many tasks a session likes to have."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Sorts and hash tables of so many narrow rows stay at a few hundred MB.
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys``, with about half a million of its ``rows`` to a task.

    Spark packs what fits its target size in bytes into as few tasks as there are cores, and narrow rows pack well, so
    tasks would grow with the tables. Where that many tasks are enough anyway, Spark is left to choose.
    """
    spark = df.sparkSession
    tasks = -(-rows // ROWS_A_TASK)
    if tasks <= spark.sparkContext.defaultParallelism:
        return df.repartition(*keys)
    # Not under the session's own number, or Spark would deal once more for a join.
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
