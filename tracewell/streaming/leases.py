"""Failures in a row, reasons to look again, and leases with timers, as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LIMIT, PAUSE = 3, 180
OUT = "user_id long, event_id long, streak int, blocked_until long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for the queries started within; the session's own is set back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _drained(out: DataFrame, place: str, schema: str, run: str = "state") -> DataFrame:
    """All that is there now, appended to the rows below ``place``; a checkpoint that exists goes on where it stopped."""
    out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{place}/{run}").option("path", f"{place}/rows").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(schema).parquet(f"{place}/rows")


def _columns(rows: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray]:
    """The named columns of all chunks, as narrow arrays."""
    chunks = [[part[c].to_numpy() for c in names] for part in rows]
    return [np.concatenate(column) for column in zip(*chunks, strict=True)]


def _by(df: DataFrame, column: str) -> GroupedData:
    """Groups by the text of a number: workers get whole numbers beside null as floats, which round them and tell every null from the next."""
    return df.withColumn("key", F.col(column).cast("string")).groupBy("key")


def _number(key: tuple[str | None]) -> int | None:
    return None if key[0] is None else int(key[0])


class Streak(StatefulProcessor):
    """Counts a key's failures since its last success; from the LIMIT-th on each one begins a pause of PAUSE seconds.

    A batch's rows of a key are taken in order of time and id, as arrays of numbers. Keys may begin with failures known from a history.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "n int")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        self.state.update((int(initialState["failures"].sum()),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, event, failed = _columns(rows, ["at", "event_id", "failed"])
        order = np.lexsort((event, at))
        at, event, failed = at[order], event[order], failed[order].astype(bool)
        total = np.cumsum(failed) + (self.state.get()[0] if self.state.exists() else 0)
        streak = total - np.maximum.accumulate(np.where(failed, 0, total))
        self.state.update((int(streak[-1]),))
        hit = failed & (streak >= LIMIT)
        yield pd.DataFrame({"user_id": pd.Series([_number(key)] * int(hit.sum()), dtype="Int64"), "event_id": event[hit].astype("int64"), "streak": streak[hit].astype("int32"), "blocked_until": at[hit] // 1_000_000 + PAUSE})

    def close(self) -> None:
        pass


def _outcomes(events: DataFrame) -> DataFrame:
    """Failures and successes with their time in microseconds; other kinds of events change no streak, nor do those without time or id."""
    decisive = events.where("event_type in ('error', 'purchase') and ts is not null and event_id is not null")
    return decisive.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") == "error").alias("failed"))


def failures_so_far(history: DataFrame) -> DataFrame:
    """(user_id, failures): the failures of each key after its last success, for keys that have any.

    Last successes are one row a key and are joined back, so that adaptive execution may split a busy key.
    """
    rows = _outcomes(history)
    done = rows.where("not failed").groupBy(F.col("user_id").alias("_key")).agg(F.max(F.struct("at", "event_id")).alias("_done"))
    tail = rows.where("failed").join(done, F.col("user_id").eqNullSafe(F.col("_key")), "left").where("_done is null or struct(at, event_id) > _done")
    return tail.groupBy("user_id").agg(F.count("*").cast("int").alias("failures"))


def failure_pauses(events: DataFrame, place: str, history: DataFrame | None = None) -> DataFrame:
    """(user_id, event_id, streak, blocked_until) of a stream of events, read to its end into the folder ``place``.

    With a ``history`` of earlier events, keys begin with the failures they had at its end, so a stream that starts
    after it finds what one over all would. A stream whose files are in order of time may be read in bounded batches.
    """
    known = None if history is None else _by(failures_so_far(history), "user_id")
    with keyed_state(events.sparkSession):
        return _drained(_by(_outcomes(events), "user_id").transformWithStateInPandas(Streak(), OUT, "Append", "None", initialState=known), place, OUT)


COUNTED = ["facts", "hints", "pending"]
REASONS = "project_id long, at long, reason string, facts long, hints long, pending long"


class Reasons(StatefulProcessor):
    """Compares a key's counts with those at which it was last looked at, and says why it has to be looked at again.

    The first counts are a reason of their own, then more facts, more hints, or the end of what was pending. What is compared
    with is kept until there is a reason; so counts that fall and rise again to the same are none.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("looked", "facts long, hints long, pending long")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        self.state.update(tuple(int(x) for x in initialState[COUNTED].iloc[-1]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        looked = self.state.get() if self.state.exists() else None
        at, *counts = _columns(rows, ["at", *COUNTED])
        found = []
        for i in np.lexsort((*counts[::-1], at)):
            facts, hints, pending = now = tuple(int(c[i]) for c in counts)
            if looked is None:
                why = ["initial"]
            else:
                why = [f"{name}:{old}->{new}" for name, old, new in (("facts", looked[0], facts), ("hints", looked[1], hints)) if new > old]
                if looked[2] > 0 and pending == 0:
                    why.append(f"pending:{looked[2]}->0")
            if why:
                looked = now
                found.append((_number(key), int(at[i]), ",".join(why), *now))
        self.state.update(tuple(looked))
        out = pd.DataFrame(found, columns=["project_id", "at", "reason", *COUNTED])
        yield out.astype({c: "Int64" if c == "project_id" else "int64" for c in out.columns if c != "reason"})

    def close(self) -> None:
        pass


def change_reasons(counts: DataFrame, place: str, looked: DataFrame | None = None) -> DataFrame:
    """(project_id, at, reason, facts, hints, pending) of a stream of counts with these columns, read to its end into the folder ``place``.

    ``looked`` (project_id, facts, hints, pending) has the counts at which projects were last looked at, one row each. Called again
    with the same place, what has come since is read. Batches must follow one another in time; rows with a missing value are left out.
    """
    rows = counts.select("project_id", *[F.col(c).cast("long").alias(c) for c in ("at", *COUNTED)]).na.drop(subset=["at", *COUNTED])
    known = None if looked is None else _by(looked.select("project_id", *[F.col(c).cast("long").alias(c) for c in COUNTED]), "project_id")
    with keyed_state(counts.sparkSession):
        return _drained(_by(rows, "project_id").transformWithStateInPandas(Reasons(), REASONS, "Append", "None", initialState=known), place, REASONS)


EXPIRED = "user_id long, last_at long, expired_at long"


class Lease(StatefulProcessor):
    """Keeps the last heartbeat of a key and a timer for its end, ``hold`` microseconds later; a heartbeat in time renews the lease, a later one begins another.

    The timer ends a lease when the watermark has passed it, so a key that falls silent is reported without a further row.
    """

    def __init__(self, hold: int) -> None:
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer(self.timer_of(last))
        ended = []
        for at in np.sort(_columns(rows, ["micros"])[0]).tolist():
            if last is not None and at - last > self.hold:
                ended.append(last)
            last = at if last is None else max(last, at)
        self.last.update((last,))
        self.handle.registerTimer(self.timer_of(last))
        yield self.expiries(key, ended)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0]
        self.last.clear()
        yield self.expiries(key, [last])

    def close(self) -> None:
        pass

    def timer_of(self, last: int) -> int:
        """The millisecond at which a lease has ended, rounded up."""
        return -(-(last + self.hold) // 1000)

    def expiries(self, key: Any, ended: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]] * len(ended), "last_at": ended, "expired_at": [x + self.hold for x in ended]}, dtype="int64")


def expired_leases(events: DataFrame, place: str, hold: int) -> DataFrame:
    """(user_id, last_at, expired_at) in microseconds, of a stream of heartbeats (user_id, ts) read to its end into the folder ``place``; one holds for ``hold`` microseconds.

    Heartbeats without a user or time hold nothing. A heartbeat behind the watermark is dropped by Spark.
    """
    at = F.col("ts").cast("timestamp")
    beats = events.where("user_id is not null and ts is not null").select("user_id", at.alias("at"), F.unix_micros(at).alias("micros")).withWatermark("at", "0 seconds")
    with keyed_state(events.sparkSession):
        return _drained(beats.groupBy("user_id").transformWithStateInPandas(Lease(hold), EXPIRED, "Append", "EventTime"), place, EXPIRED)
