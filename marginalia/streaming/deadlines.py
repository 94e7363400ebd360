"""Deadlines and cancellation of jobs: a job ends by its own word, by a cancel, or at its limit, whichever comes first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of events that end a job, and how it ended; other kinds are its output.
ENDS = {"end": "done", "error": "failed", "cancel": "cancelled"}
START, TIMEOUT = "start", "timeout"
OUTCOME = "job string, started long, ended long, outcome string, lines long"


class Deadlines(StatefulProcessor):
    """Of each running job: when it began (milliseconds) and its lines so far. A timer ends it if nothing else does.

    Events of a micro-batch are taken in the order of their times; at equal times starts come first and ends last. One behind the limit finds the job ended there, even if
    the timer hasn't fired yet: the outcome doesn't depend on when micro-batches begin. A job that has ended is forgotten;
    what still comes of it is ignored unless it starts anew.
    """

    def __init__(self, limit: int, by_event_time: bool):
        self.limit, self.by_event_time = limit, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "started long, lines long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        started, lines, timer = self.state.get() if self.state.exists() else (None, 0, None)
        out = []
        for at, _, kind in sorted((int(a), (k != START) + (k in ENDS), k) for part in rows for a, k in zip(part["at"], part["kind"])):
            if started is not None and at > started + self.limit:
                out.append((key[0], started, started + self.limit, TIMEOUT, lines))
                started = None
            if started is None:
                started, lines = (at, 0) if kind == START else (None, 0)
            elif kind in ENDS:
                out.append((key[0], started, at, ENDS[kind], lines))
                started = None
            else:
                lines += kind != START
        if timer is not None:
            self.handle.deleteTimer(timer)
        if started is None:
            self.state.clear()
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
            timer = started + self.limit if self.by_event_time else max(now + 1, started + self.limit)
            self.handle.registerTimer(timer)
            self.state.update((started, lines, timer))
        yield pd.DataFrame(out, columns=["job", "started", "ended", "outcome", "lines"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            started, lines, _ = self.state.get()
            out.append((key[0], started, started + self.limit, TIMEOUT, lines))
            self.state.clear()
        yield pd.DataFrame(out, columns=["job", "started", "ended", "outcome", "lines"])

    def close(self) -> None:
        pass


def outcomes_stream(events: DataFrame, limit_ms: int, late: str | None = None) -> DataFrame:
    """A stream of job events (job, ts, kind) into one row per job that has ended: job, started, ended (milliseconds since
    the epoch), outcome, lines.

    Without ``late``, timers run by the clock: a silent job ends at its limit, in the first micro-batch behind it. With it,
    the clock is the events' own time: the watermark, which stays ``late`` behind the newest event.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed if late is None else timed.withWatermark("ts", late)
    rows = timed.select("job", "ts", F.unix_millis("ts").alias("at"), "kind")
    return rows.groupBy("job").transformWithStateInPandas(Deadlines(limit_ms, late is not None), OUTCOME, "Append", "ProcessingTime" if late is None else "EventTime")


def outcomes(events: DataFrame, limit_ms: int, now: int | None = None) -> DataFrame:
    """The same over a table of events, for jobs that start once: their first start counts. ``now`` (milliseconds): jobs
    that neither ended nor reached their limit by then are left out; None: all time has passed.

    Two aggregations with partial sums: a job with many lines is split over the tasks that read it.
    """
    rows = events.select("job", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "kind")
    starts = rows.where(F.col("kind") == START).groupBy("job").agg(F.min("at").alias("started"))
    live = rows.join(starts, "job").where((F.col("at") >= F.col("started")) & (F.col("at") <= F.col("started") + limit_ms))
    ends = live.where(F.col("kind").isin(*ENDS)).groupBy("job").agg(F.min(F.struct("at", "kind")).alias("end"))
    ended = starts.join(ends, "job", "left").select("job", "started", F.coalesce("end.at", F.col("started") + limit_ms).alias("ended"), "end.kind")
    said = live.join(ended.select("job", "ended"), "job").where(~F.col("kind").isin(START, *ENDS) & (F.col("at") <= F.col("ended"))).groupBy("job").agg(F.count(F.lit(1)).alias("lines"))
    outcome = F.coalesce(F.create_map(*[F.lit(x) for pair in ENDS.items() for x in pair])[F.col("kind")], F.lit(TIMEOUT))
    found = ended.join(said, "job", "left").select("job", "started", "ended", outcome.alias("outcome"), F.coalesce("lines", F.lit(0)).alias("lines"))
    return found if now is None else found.where(F.col("ended") <= now)
