"""Streams: windowed counts, sessions, deduplication, masking and profiling of arriving rows (beyond the reference's own batch jobs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 16) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed(df: DataFrame, by: list[str], column: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "1 day", value: str = "value") -> DataFrame:
    """Rows and sums by window and key; rows later than `late` behind the newest are dropped. Works on streams and tables."""
    w = F.window(column, size, slide) if slide else F.window(column, size)
    marked = df.withWatermark(column, late)
    return marked.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(df: DataFrame, by: list[str], column: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions by key: rows less than `gap` apart."""
    s = F.session_window(column, gap)
    return df.withWatermark(column, late).groupBy(s.alias("s"), *by).agg(F.count("*").alias("n")).select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_arrivals(df: DataFrame, keys: list[str], column: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, as far back as `late` reaches."""
    marked = df.withWatermark(column, late)
    return marked.dropDuplicatesWithinWatermark(keys) if df.isStreaming else marked.dropDuplicates(keys)


def apply_each(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run a batch operator, such as a mask or a profile, over everything that has arrived and stop."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append finished windows to a parquet table and stop when everything has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
