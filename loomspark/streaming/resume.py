"""Append and resume as a stream: files that came since the last run, each exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def run_available(
    spark: SparkSession, source: str, schema: StructType | str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str
) -> None:
    """Process the JSON files that ``source`` has and the checkpoint does not know, then stop.

    The file source's log and the sink's commit log make a rerun after a crash neither
    repeat nor skip a file.
    """
    rows = spark.readStream.schema(schema).json(source)
    query = transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).outputMode("append").start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per time window and key of a stream (or a table), with a bound on lateness."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def first_seen(events: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """The first event of each key within the watermark; state older than that is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
