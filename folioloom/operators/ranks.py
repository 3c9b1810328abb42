"""Ranks over all rows, or over hot keys, without one task for all of them."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; a session on one machine may leave it unset, one on a cluster may not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "folioloom-checkpoint")


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the folder that all executors share, and read from there."""
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """The rows of a small table; more than `most` are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows


def placed(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The place of each row within its key, from 1.

    Rows are range-partitioned by key and order, numbered within their partition, and moved up
    by the number of rows of their key in the partitions before.  `order` has to be unique
    within a key.  The partitions are written, as ranges drawn by sampling differ from one
    evaluation to the next, and both passes must see the same.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()))
    counts = part.groupBy("_slice", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = part.withColumn("_k", F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*order)))
    return local.join(offsets, ["_slice", *keys]).withColumn(name, F.col("_k") + F.col("_o")).drop("_slice", "_k", "_o")
