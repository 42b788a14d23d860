"""The event log as a stream: windowed failure counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def failure_windows(events: DataFrame, key: str = "user_id", at: str = "ts", kind: str = "event_type", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Failures of each key and window; works on a stream as on a table. Rows later than the watermark are left out of a stream."""
    rows = events.where(F.col(kind) == "error").withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late)
    counts = rows.groupBy(F.window("event_time", window).alias("w"), key).agg(F.count("*").alias("failures"))
    return counts.select(key, F.col("w.start").alias("window_start"), "failures")


def run_once(stream: DataFrame, name: str, checkpoint: str, path: str) -> None:
    """All that is there now, appended as Parquet; windows that the watermark has passed are final."""
    stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path).queryName(name).trigger(availableNow=True).start().awaitTermination()
