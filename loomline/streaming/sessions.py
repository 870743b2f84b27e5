"""Sessions and stalls of an unbounded stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_sessions(points: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Points of each key joined while they are at most `gap` apart; rows later than `late` are dropped."""
    grouped = points.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(key, "first", "last", "n")


def stream_counts(points: DataFrame, key: str, ts: str, width: str, late: str) -> DataFrame:
    """Points of each key in each window of time."""
    grouped = points.withWatermark(ts, late).groupBy(F.window(ts, width), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def finished(stream: DataFrame, where: str) -> DataFrame:
    """What a stream over the files that are there now has written under the folder `where`, read back."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")
