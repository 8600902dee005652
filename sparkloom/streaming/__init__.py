"""The relational operators over streams of files: the batch functions apply unchanged; grouping takes a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import Agg


def read_folder(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def windowed(df: DataFrame, time_col: str, size: str, late: str, keys: list[str], *aggs: Agg) -> DataFrame:
    """Tumbling windows: window_start, keys, aggregates; rows later than late are dropped, and state with them."""
    grouped = df.withWatermark(time_col, late).groupBy(F.window(time_col, size).alias("w"), *keys)
    return grouped.agg(*(a.build(df) for a in aggs)).select(F.col("w.start").alias("window_start"), *keys, *(a.name() for a in aggs))
