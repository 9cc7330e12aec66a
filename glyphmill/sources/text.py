"""Readers and sinks around the column functions: text lines, whole files, raw bytes, and stdin for the command line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of text files; bytes that are not UTF-8 become U+FFFD."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("line"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, data) of whole files as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def read_decoded(spark: SparkSession, path: str, encoding: str | None = None, strict: bool = False) -> DataFrame:
    """(path, text, had_errors) of whole files in the given or detected encoding."""
    out = read_payloads(spark, path).select("path", udfs.decode_to_utf8("data", encoding, strict=strict).alias("d"))
    return out.select("path", "d.text", "d.had_errors")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def to_json(df: DataFrame, column: str, name: str = "json") -> DataFrame:
    """A struct column as JSON text."""
    return df.withColumn(name, F.to_json(column))
