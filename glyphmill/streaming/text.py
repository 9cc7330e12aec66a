"""The scalar functions under Structured Streaming.

All of them are stateless, so a streaming DataFrame takes them like a batch one. Keys can be counted
with state; late data is dropped by a watermark if one is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def map_column(stream: DataFrame, column: str, function: Callable[[Column], Column], name: str) -> DataFrame:
    return stream.withColumn(name, function(F.col(column)))


def count_keys(stream: DataFrame, key: Column, *, time_col: str | None = None, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Running counts of a key; with a time column per window and bounded by a watermark."""
    keyed = stream.withColumn("key", key)
    if time_col is None:
        return keyed.groupBy("key").agg(F.count("*").alias("n"))
    return keyed.withWatermark(time_col, delay).groupBy(F.window(time_col, window), "key").agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process what is there, write it, and stop; a later call goes on from the checkpoint."""
    query = stream.writeStream.format(fmt).outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keyed_files(spark: SparkSession, path: str, schema, column: str, function: Callable[[Column], Column], target: str, checkpoint: str) -> DataFrame:
    """New Parquet files in ``path`` with their keys, appended to ``target``."""
    run_once(map_column(spark.readStream.schema(schema).parquet(path), column, function, "key"), target, checkpoint)
    return spark.read.parquet(target)
