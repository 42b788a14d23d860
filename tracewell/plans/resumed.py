"""Registered queries: streams that go on where a history or an earlier run ended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import kept
from ..sources import tables
from ..sources.tables import table
from ..streaming import leases
from .catalog import query


@query("""WITH m AS (SELECT (floor(epoch(min(ts)))::BIGINT + floor(epoch(max(ts)))::BIGINT) // 2 AS mid FROM events),
x AS (SELECT *, count_if(event_type = 'error') OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, n - coalesce(max(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS streak FROM x)
SELECT user_id, event_id, streak::INTEGER AS streak, floor(epoch(ts))::BIGINT + 180 AS blocked_until FROM y, m WHERE event_type = 'error' AND streak >= 3 AND floor(epoch(ts))::BIGINT >= mid""")
def q_stream_hydrated(spark: SparkSession, sf: str) -> DataFrame:
    """The later half of the log's time as a stream that begins with the failures in a row at the end of the earlier half."""
    events = table(spark, sf, "events")
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    mid = events.agg(F.floor((F.min(second) + F.max(second)) / 2)).first()[0]
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    return leases.failure_pauses(stream.where(second >= F.lit(mid)), f"{tables.shared_dir(spark)}/hydrated-{uuid.uuid4().hex}", events.where(second < F.lit(mid)))


@query("""WITH RECURSIVE d AS (SELECT user_id, floor(epoch(ts))::BIGINT // 86400 AS day, count_if(event_type = 'purchase') AS f, count_if(event_type = 'signup') AS h, count_if(event_type = 'error') AS p FROM events GROUP BY 1, 2),
s AS (SELECT user_id, day, CAST(sum(f) OVER w AS BIGINT) AS facts, CAST(sum(h) OVER w AS BIGINT) AS hints, CAST(p AS BIGINT) AS pending, row_number() OVER w AS n FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
r AS (SELECT user_id, day, n, facts, hints, pending, 'initial' AS reason FROM s WHERE n = 1
 UNION ALL SELECT user_id, day, n, CASE WHEN why = '' THEN f0 ELSE facts END, CASE WHEN why = '' THEN h0 ELSE hints END, CASE WHEN why = '' THEN p0 ELSE pending END, why FROM
 (SELECT s.*, r.facts AS f0, r.hints AS h0, r.pending AS p0, concat_ws(',', CASE WHEN s.facts > r.facts THEN 'facts:' || r.facts || '->' || s.facts END, CASE WHEN s.hints > r.hints THEN 'hints:' || r.hints || '->' || s.hints END, CASE WHEN r.pending > 0 AND s.pending = 0 THEN 'pending:' || r.pending || '->0' END) AS why
  FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1))
SELECT user_id AS project_id, day AS at, reason FROM r WHERE reason <> ''""")
def q_change_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why each user has to be looked at again, from daily counts in two streams: the second begins with what the first has left.

    Purchases are facts, signups hints, the day's errors are pending. Counts are reduced to one row a user and day before anything is put in order.
    """
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    kinds = {"facts": "purchase", "hints": "signup", "pending": "error"}
    days = table(spark, sf, "events").groupBy(F.col("user_id").alias("project_id"), day.alias("at")).agg(*[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in kinds.items()])
    so_far = Window.partitionBy("project_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counts = kept(days.withColumns({"facts": F.sum("facts").over(so_far), "hints": F.sum("hints").over(so_far)}), "counts")
    mid = counts.agg(F.floor((F.min("at") + F.max("at")) / 2)).first()[0]
    place = f"{tables.shared_dir(spark)}/reasons-{uuid.uuid4().hex}"
    stream = lambda: spark.readStream.schema(counts.schema).parquet(counts.tracewell_path)
    first = leases.change_reasons(stream().where(F.col("at") <= F.lit(mid)), f"{place}/first")
    looked = first.groupBy("project_id").agg(F.max_by(F.struct("facts", "hints", "pending"), "at").alias("last")).select("project_id", "last.*")
    second = leases.change_reasons(stream().where(F.col("at") > F.lit(mid)), f"{place}/second", looked)
    return first.unionByName(second).select("project_id", "at", "reason")
