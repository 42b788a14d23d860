"""Work queues and event logs: leases, streaks, rates, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds_between(a: Column, b: Column) -> Column:
    return F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))


def expired(rows: DataFrame, heartbeat: str, now: Column, timeout: int, null_expires: bool) -> DataFrame:
    """Leases whose last heartbeat is more than ``timeout`` seconds ago."""
    late = seconds_between(F.col(heartbeat), now) > timeout
    return rows.where(F.coalesce(late, F.lit(null_expires)))


def failure_streaks(history: DataFrame, key: str, id: str, outcome: str, at: str, text: str | None = None) -> DataFrame:
    """For each key the failures after its last success: how many, when the last was and, with ``text``, the greatest text.

    The last successes are one row a key and are joined back, so that adaptive execution may split a busy key.
    """
    done = history.where(F.col(outcome) == "success").groupBy(F.col(key).alias("_key")).agg(F.max(id).alias("_last"))
    failed = history.where(F.col(outcome) == "failed")
    tail = failed.join(done, F.col(key).eqNullSafe(F.col("_key")), "left").where(F.col(id) > F.coalesce("_last", F.lit(-1)))
    found = [F.count("*").alias("failures"), F.max(at).alias("last_failed_at")]
    return tail.groupBy(key).agg(*found, *([F.max(text).alias("greatest_text")] if text else []))


def rate_limited(events: DataFrame, key: str, at: str, id: str, seconds: int, least: int) -> DataFrame:
    """Events that see ``least`` or more of their key within the last ``seconds``, themselves included."""
    frame = Window.partitionBy(key).orderBy(F.unix_seconds(F.col(at).cast("timestamp"))).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count("*").over(frame)).where(F.col("recent") >= least)
