"""Pages as a stream, through the same operators as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Crawled pages ``url, html`` as they arrive in a folder; row-wise
    operators such as table extraction apply as they are."""
    stream = spark.readStream.schema("url string, data string").option("maxFilesPerTrigger", files_per_trigger).json(path)
    return stream.select("url", F.col("data").alias("html"))
