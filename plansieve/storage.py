"""Where intermediate tables go: one folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of its own only where driver and executors are one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


#: open scratch folders, innermost last
_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that cut() writes meanwhile go to one folder, which is deleted at the end.

    For jobs whose result has been written by then: what still reads a cut table fails afterwards.
    """
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{_scratch[-1] if _scratch else shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides and merges them sorted, never a broadcast.

    Spark takes exploded rows (a map's nodes by plans, arrays by places) to be as few as the rows they were made of, so it
    would collect them in the driver to broadcast them.
    """
    return df.hint("merge")


def row_numbers(df: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """Adds `name`, 0..n-1 in the order of one or more columns, without sorting all rows in one task.

    Rows are dealt by ranges of the columns; each range is numbered by itself and moved up by the
    sizes of the ranges before it, a table of one row a range.
    """
    order = [order] if isinstance(order, str) else order
    dealt = cut(df.repartitionByRange(*map(F.col, order)).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(before, "_range").withColumn(name, (F.col("_before") + within).cast("long")).drop("_range", "_before")


BATCH_ROWS, SCAN_ROWS = 1000, 512
_shipped: set[str] = set()


def bound_batches(spark: SparkSession) -> None:
    """Fewer rows a batch, to Python workers and in scans: rows are texts of some KB to some 100 KB, or plans, and
    batches of the default sizes would hold 10,000 and 4,096 of them. A session's own settings are left alone."""
    for key, default, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", "4096", SCAN_ROWS)):
        if spark.conf.get(key) == default:
            spark.conf.set(key, rows)


def ship() -> None:
    """Make this package importable in Python workers that don't have it on their path.

    Spark's own file server hands the zip to each executor, new ones included.
    """
    spark = SparkSession.getActiveSession()
    sc = spark.sparkContext
    bound_batches(spark)
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(), f"{name}_workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
