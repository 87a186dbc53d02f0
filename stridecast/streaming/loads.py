"""Streaming forms of the load operators: sliding loads, sessions, and appends of rows not stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridecast.operators.entities import new_rows


def event_time(stream: DataFrame, ts: str) -> DataFrame:
    """ts as an instant: event time can't be a timestamp without a zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def sliding_load(stream: DataFrame, ts: str, entity: str, load: str, window: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """entity, window_start, window_end, load, n: loads over sliding windows; rows later than the watermark are dropped.

    State is one partial sum an entity and open window, and goes when the watermark passes the window.
    """
    marked = event_time(stream, ts).filter(F.col(entity).isNotNull()).withWatermark(ts, late)
    sums = marked.groupBy(F.window(ts, window, slide), entity).agg(F.sum(load).alias("load"), F.count("*").alias("n"))
    return sums.select(entity, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "load", "n")


def sessions(stream: DataFrame, ts: str, entity: str, gap: str = "2 days", late: str = "2 days") -> DataFrame:
    """entity, session_start, session_end, n: runs of events without a gap as long as that."""
    marked = event_time(stream, ts).filter(F.col(entity).isNotNull()).withWatermark(ts, late)
    runs = marked.groupBy(F.session_window(ts, gap), entity).agg(F.count("*").alias("n"))
    return runs.select(entity, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def append_new(stream: DataFrame, path: str, checkpoint: str, name: str, day: str):
    """Append to a Parquet table the rows of each micro-batch whose (name, day) it doesn't hold; returns the writer.

    A batch that runs again finds its rows stored and appends none of them twice. Of the table only the batch's days are read.
    """

    def store(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        days = batch.agg(F.min(F.col(day).cast("date")).alias("a"), F.max(F.col(day).cast("date")).alias("b")).first()
        stored = spark.read.schema(batch.schema).option("recursiveFileLookup", True).parquet(path)
        if days["a"] is not None:
            stored = stored.filter(F.col(day).cast("date").between(days["a"], days["b"]))
        new_rows(batch, stored, name, day).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
