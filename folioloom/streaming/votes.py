"""Counters over streams: the incremental fold of sessions, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioloom.operators.ranks import shared_folder


def vote_stream(events: DataFrame, question: str, version: str) -> DataFrame:
    """(question, version, votes) over all events so far; state has a row for each pair."""
    return events.groupBy(question, version).agg(F.count(F.lit(1)).alias("votes"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(window_start, key, n): tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def first_deliveries(events: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """Rows whose key comes for the first time within the watermark: repeated deliveries fall away."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> StreamingQuery:
    """All that is there now, into a table in memory; for files as streams and for tests.

    Offsets and state go to the folder all executors share.
    """
    checkpoint = checkpoint or f"{shared_folder(stream.sparkSession)}/stream-{name}"
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = writer.option("checkpointLocation", checkpoint).start()
    query.awaitTermination()
    return query


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
