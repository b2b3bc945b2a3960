"""The event feeds as streams: daily trips, vote limits, duplicates, counters, latest prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.operators.files import scratch


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of Parquet files as a stream of its files; event times become timestamps, as watermarks need.

    A stream's source is a folder or a pattern, never one file; the pattern's last letter in brackets matches a table
    that is one file as well as one that is a folder.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{folder}/{name}.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, mode: str, spark: SparkSession) -> DataFrame:
    """Runs a stream over what is there and returns its last result.

    Every batch's result replaces the one before (``complete``) or is added (``append``), as Parquet in the
    cluster's shared folder; a repeated batch writes its own folder again, so restarts don't duplicate.
    """
    out = scratch(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/last" if mode == "complete" else f"{out}/data/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data/last" if mode == "complete" else f"{out}/data").select(*stream.columns)


def daily_trips(events: DataFrame) -> DataFrame:
    """Purchases of one user on one day are one trip."""
    bought = events.where("event_type = 'purchase'").withWatermark("ts", "2 days")
    return bought.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("cents"))


def vote_rate(events: DataFrame, most: int) -> DataFrame:
    """Users with more than ``most`` events within some ten minutes, in steps of five."""
    windows = events.withWatermark("ts", "30 minutes").groupBy(F.window("ts", "10 minutes", "5 minutes"), "user_id").agg(F.count("*").alias("n"))
    return windows.where(F.col("n") > most)


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, whatever is delivered again within the watermark."""
    return events.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(keys)


def daily_counters(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))


def latest_state(events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The newest row of each key; what comes late never goes back behind a newer one."""
    return events.groupBy(key).agg(F.max(F.struct("ts", *columns)).alias("last"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def batch_of(build: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str, mode: str = "complete") -> DataFrame:
    return run_available(build(stream_table(spark, folder, "events")), mode, spark)
