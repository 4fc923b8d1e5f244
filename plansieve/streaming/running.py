"""An extension: trajectory rows as a stream, with running statistics of each chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "metric string, chain_id int, sample_idx long, value double, ts timestamp"


def read_trajectory_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def running_stats(stream: DataFrame) -> DataFrame:
    """metric, chain_id, n, mean, var (sample): updated as rows arrive; state is one row a chain."""
    return stream.groupBy("metric", "chain_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def windowed_stats(stream: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """The same by event time windows; rows later than `late` are dropped by the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "metric", "chain_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
