"""Event operators on unbounded input: deduplication, windowed counts, sessions, incremental contacts.

State is bounded by a watermark throughout; late rows behind it are dropped, as Structured Streaming
defines it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_folder(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def timed(events: DataFrame, time_col: str = "ts") -> DataFrame:
    """The time column as an instant, which watermarks need."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp"))


def dedupe(events: DataFrame, keys: list[str], time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first of the events that agree in ``keys`` and time, remembered for ``delay``."""
    return timed(events, time_col).withWatermark(time_col, delay).dropDuplicates([*keys, time_col])


def windowed(events: DataFrame, key: str, value: str, window: str = "1 hour", slide: str | None = None, time_col: str = "ts", delay: str = "2 hours") -> DataFrame:
    """(start, end, key, n, total, low, high) for each window."""
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    got = timed(events, time_col).withWatermark(time_col, delay).groupBy(span.alias("w"), key).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "low", "high")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", time_col: str = "ts", delay: str = "2 hours") -> DataFrame:
    """(key, start, end, n): events no further apart than ``gap``."""
    got = timed(events, time_col).withWatermark(time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def contacts_within(events: DataFrame, key: str, element: str, window: str = "1 hour", time_col: str = "ts", delay: str = "2 hours") -> DataFrame:
    """(start, id1, id2): pairs of elements that a key met in one window, id1 < id2; a stream-stream join."""
    base = timed(events, time_col).withWatermark(time_col, delay).select(key, element, time_col, F.window(time_col, window).alias("w"))
    a = base.select(F.col(key).alias("k1"), F.col(element).alias("id1"), F.col("w").alias("w1"), F.col(time_col).alias("t1"))
    b = base.select(F.col(key).alias("k2"), F.col(element).alias("id2"), F.col("w").alias("w2"), F.col(time_col).alias("t2"))
    met = a.join(b, (F.col("k1") == F.col("k2")) & (F.col("w1") == F.col("w2")) & (F.col("id1") < F.col("id2")))
    return met.select(F.col("w1.start").alias("start"), "id1", "id2")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Run all input that is there into an in-memory table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
