"""Structured Streaming forms of stateless operators, keep-first and windowed counts. An extension of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.session import table


def stream_table(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).parquet(folder)


def timed(events: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time with a watermark; times without a zone are taken as UTC."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling(events: DataFrame, width: str = "1 hour", by: str = "event_type", at: str = "ts", slide: str | None = None) -> DataFrame:
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id", at: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "n")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keep-first within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, batch by batch, and stop."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def hourly_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling counts as a batch query over the same code."""
    e = table(spark, sf_dir, "events")
    return tumbling(e.withColumn("ts", F.col("ts").cast("timestamp")))
