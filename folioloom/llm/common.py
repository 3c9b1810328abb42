"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of one table; all of them if none is named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per non-null key: a delivery repeats rows with the same key and content."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all workers share: the session's `spark.checkpoint.dir`.

    Where that is unset, a session on one machine uses a temporary folder; on a cluster it is an
    error, as each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "folioloom-checkpoint")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written to the folder that all executors share, and read from there."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", running: str | None = None) -> DataFrame:
    """Adds a 0-based rank within each value of `keys`, without one task per key.

    With `running`, also the sum of that column over the rows before, as `<running>_before`.

    A hot key would put all its rows into one window task.  Rows are range-partitioned by
    (keys, order), ranked inside their partition, and shifted by the number of rows of the
    same key in the partitions before; only one count per key and partition leaves the
    executors.  `order` has to be unique within a key for the result to be deterministic.
    The input is checkpointed after the range partitioning, as both passes must see the same
    partitions.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [*keys, *order]
    part = cut_lineage(df.repartitionByRange(n, *cols).withColumn("_slice", F.spark_partition_id()))
    local = Window.partitionBy("_slice", *keys).orderBy(*order)
    measures = {name: F.lit(1)} | ({f"{running}_before": F.col(running)} if running else {})
    counts = part.groupBy("_slice", *keys).agg(*[F.sum(m).alias(f"_n_{k}") for k, m in measures.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", *keys, *[F.coalesce(F.sum(f"_n_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in measures])
    ahead = local.rowsBetween(Window.unboundedPreceding, -1)
    inner = part.withColumns({f"_l_{k}": F.coalesce(F.sum(m).over(ahead), F.lit(0)) for k, m in measures.items()})
    joined = inner.join(offsets, ["_slice", *keys])
    return joined.withColumns({k: F.col(f"_l_{k}") + F.col(f"_o_{k}") for k in measures}).drop("_slice", *[f"_{x}_{k}" for k in measures for x in "lo"])


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """The rows of a table whose size doesn't grow with the data; more than `limit` is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
