"""Parquet in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def parquet_scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file or a folder of batches. With a schema no file is opened for inference."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def parquet_sink(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Overwrite a folder; with `partition_by` (a column of few values, such as a
    split flag) every part is a sub-folder and the source is scanned once."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def chunked_export(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """Files of at most `rows` rows, written in parallel without a shuffle."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
