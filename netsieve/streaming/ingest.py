"""Extensions for streams: new files as they come, and sessions by gaps of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; each is read once, by the checkpoint of the query."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Everything that is there now, transformed and appended as Parquet; a later call takes up where this one stopped."""
    query = each(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def gap_sessions(events: DataFrame, key: str, time: str, value: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n, total) of runs of events with no gap longer than ``gap``; works on streams and tables."""
    timed = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    window = F.session_window("_at", gap)
    out = timed.groupBy(key, window).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")
