"""Streams of assets: each content once, and windowed counts of arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def assets(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def fresh(stream: DataFrame, text: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each content within the watermark; state is dropped once it has passed."""
    return stream.withColumn("hash", F.md5(F.coalesce(F.col(text), F.lit("")))).withWatermark(at, late).dropDuplicatesWithinWatermark(["hash"])


def counts(stream: DataFrame, at: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Arrivals by key in tumbling windows."""
    out = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "n")
