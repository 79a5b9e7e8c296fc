"""Structured Streaming: event windows, change feeds and file intake that replays may repeat without harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``<folder>/<name>.parquet`` as a stream, be it one file or a folder of part files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")  # as a pattern: a plain path must be a folder


def events_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    return table_stream(spark, folder, name).withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark takes no other kind of time


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total of event-time windows; for a stream and for a table alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, n: runs of a user's events with gaps below ``gap``."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, to Parquet at ``path``; a restart goes on where the checkpoint ends."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def intake(files: DataFrame, target: str, checkpoint: str, steps: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """New files (file, text) appended once to ``target``: known by the hash of their text, so a replayed batch adds nothing.

    ``steps`` derives further columns (metadata, chunks) from a batch; file_hash and batch are added here."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("file_hash", F.sha2("text", 256)).dropDuplicates(["file_hash"])
        try:
            known = spark.read.parquet(target).select("file_hash", "batch")
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(known.select("file_hash"), "file_hash", "left_anti")
        steps(new).withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    t = spark.readStream.option("wholetext", True).option("pathGlobFilter", pattern).text(folder)
    return t.select(F.input_file_name().alias("file"), F.col("value").alias("text"))
