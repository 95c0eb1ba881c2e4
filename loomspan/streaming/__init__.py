"""Row-wise operators run unchanged on streams; this module reads the tables of a folder as one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stream(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A folder's files as a stream with the schema of those that are there."""
    schema = spark.read.format(format).load(path).schema
    return spark.readStream.schema(schema).format(format).load(path)


def run_available(df: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Apply a row-wise ``transform`` to what has come since the last call, and append it to ``path`` exactly once."""
    query = transform(df).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
