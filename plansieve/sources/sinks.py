"""Result tables and run settings written out."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    write_parquet(nodes, f"{folder}/nodes")
    write_parquet(edges, f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def write_run_config(path: str, **settings) -> None:
    with open(path, "w") as f:
        json.dump({"timestamp": time.strftime("%Y-%m-%d %H:%M:%S"), **settings}, f, indent=2)


def baseline_metrics(spark: SparkSession, path: str, plan: str = "enacted") -> dict:
    """The metrics of one named plan of a baseline table, without its name."""
    row = spark.read.parquet(path).where(f"plan = '{plan}'").first()
    return {k: v for k, v in row.asDict().items() if k != "plan"}
