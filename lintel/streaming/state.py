"""Event streams: exact rate limit, expiry, page context, windows with late data."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

LIMIT, SPAN_S = 20, 3600


def allowed(times: list[float], recent: list[float], limit: int, span: float) -> tuple[list[bool], list[int], list[float]]:
    """Decisions on attempts in order; an attempt that is turned down does not count for later ones."""
    decisions, waits = [], []
    for t in times:
        recent = [r for r in recent if r >= t - span]
        ok = len(recent) < limit
        decisions.append(ok)
        waits.append(0 if ok else int(max(1, span - (t - recent[0]))))
        if ok:
            recent.append(t)
    return decisions, waits, recent


def rate_limited(events: DataFrame, limit: int = LIMIT, span: float = SPAN_S) -> DataFrame:
    """M1, exactly, in batch: (event_id, user_id, ts, allowed, retry_after); a user's events in order of time and id.

    Each decision depends on the ones before it. Events arrive sorted, and a task keeps the accepted attempts of its current
    user's last span: limit of them at most, however long the history.
    """
    schema = f"event_id long, user_id long, ts {events.schema['ts'].dataType.simpleString()}, allowed boolean, retry_after int"

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, recent = object(), []
        for rows in batches:
            ok, wait = [], []
            seconds = (rows["ts"] - pd.Timestamp(0)).dt.total_seconds()
            for own, times in seconds.groupby((rows["user_id"] != rows["user_id"].shift()).cumsum(), sort=False):
                if rows["user_id"].loc[times.index[0]] != user:
                    user, recent = rows["user_id"].loc[times.index[0]], []
                good, waits, recent = allowed(times.tolist(), recent, limit, span)
                ok += good
                wait += waits
            yield rows.assign(allowed=ok, retry_after=wait)

    sorted_ = events.select("event_id", "user_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return sorted_.mapInPandas(decide, schema)


def rate_limited_stream(events: DataFrame, limit: int = LIMIT, span: float = SPAN_S) -> DataFrame:
    """M1 on a stream: the accepted attempts of the last span are a user's state, which expires with them."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        for rows in [pd.concat(list(batches))]:
            rows = rows.sort_values(["ts", "event_id"])
            ok, wait, recent = allowed((rows["ts"] - pd.Timestamp(0)).dt.total_seconds().tolist(), recent, limit, span)
            yield rows.assign(allowed=ok, retry_after=wait)[["event_id", "user_id", "ts", "allowed", "retry_after"]]
        state.update((recent,))
        state.setTimeoutDuration(int(span * 1000))

    out = "event_id long, user_id long, ts timestamp, allowed boolean, retry_after int"
    return events.select("event_id", "user_id", "ts").groupBy("user_id").applyInPandasWithState(decide, out, "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Hours that a finished job is kept; statuses that finish a job.
JOB_HOURS, FINISHED = 6, ("completed", "failed")


def expired_jobs(events: DataFrame, now: Column, hours: int = JOB_HOURS) -> DataFrame:
    """M2 in batch: job events (job_id, event_id, status, ts) to the expiries until now: (job_id, status, finished_at, expired_at, n_events).

    A job expires so many hours after the event that finished it, if it has no event by then; its next event begins a new life.
    Jobs that have not finished are kept.
    """
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    expires = F.col("ts") + F.make_interval(hours=F.lit(hours))
    following = F.lead("ts").over(order)
    ends = F.col("status").isin(*FINISHED) & (following.isNull() | (following > expires))
    lives = events.withColumn("expired_at", F.when(ends, expires)).withColumn("life", F.coalesce(F.count("expired_at").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counted = lives.withColumn("n_events", F.count("*").over(Window.partitionBy("job_id", "life")))
    return counted.where(F.col("expired_at") < now).select("job_id", "status", F.col("ts").alias("finished_at"), "expired_at", "n_events")


class _Jobs(StatefulProcessor):
    """A job's last event, its statuses so far, and a timer for its end."""

    def __init__(self, hours: int):
        self.span = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at long, event_id long")
        self.steps = handle.getListState("steps", "status string")

    def _ended(self, key: tuple) -> tuple:
        status, at, _ = self.last.get()
        out = (key[0], status, pd.Timestamp(at, unit="ms"), pd.Timestamp(at + self.span, unit="ms"), sum(1 for _ in self.steps.get()))
        self.last.clear()
        self.steps.clear()
        return out

    def _timers(self, at: int | None) -> None:
        for held in list(self.handle.listTimers()):
            self.handle.deleteTimer(held)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        ended = []
        for status, ts, event_id in zip(came["status"], came["ts"], came["event_id"], strict=True):
            at = int(ts.value // 1_000_000)
            if self.last.exists() and self.last.get()[0] in FINISHED and at > self.last.get()[1] + self.span:
                ended.append(self._ended(key))
            self.steps.appendValue((status,))
            if not self.last.exists() or (at, event_id) > tuple(self.last.get()[1:]):
                self.last.update((status, at, int(event_id)))
        status, at, _ = self.last.get()
        self._timers(at + self.span if status in FINISHED else None)
        if ended:
            yield pd.DataFrame(ended, columns=_EXPIRY)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists() and self.last.get()[0] in FINISHED and self.last.get()[1] + self.span <= expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame([self._ended(key)], columns=_EXPIRY)

    def close(self) -> None:
        pass


_EXPIRY = ["job_id", "status", "finished_at", "expired_at", "n_events"]


def expired_jobs_stream(events: DataFrame, late: str = "10 minutes", hours: int = JOB_HOURS) -> DataFrame:
    """M2 on a stream: like expired_jobs() with the watermark as now. Event-time timers end a finished job's state; an event that comes
    after the watermark has passed it is dropped, one that comes out of order within it counts, and changes nothing if it is older than the last.

    Times are kept to the millisecond. The session needs the state store that supports timers (RocksDB).
    """
    kept = events.withWatermark("ts", late).select("job_id", "event_id", "status", "ts")
    out = "job_id long, status string, finished_at timestamp, expired_at timestamp, n_events long"
    return kept.groupBy("job_id").transformWithStateInPandas(_Jobs(hours), outputStructType=out, outputMode="append", timeMode="EventTime")


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and type, with a watermark for late events; batch or stream."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    counted = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
