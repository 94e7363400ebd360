"""Job events as streams: decoding, running state per key, change feeds, and windows by event time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import printed

#: Longest preview of running text.
PREVIEW = 200

EVENT = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("payload", T.StringType())])


def decoded(lines: DataFrame) -> DataFrame:
    """key, seq and fields of each line's payload; lines that are no JSON objects are left out.

    Works on streams and on tables.
    """
    fields = "type string, subtype string, session_id string, model string, status string, duration_ms double, total_cost_usd double, is_error boolean, result string, event struct<type: string, delta: struct<type: string, text: string>, content_block: struct<type: string, name: string, input: map<string, string>>>"
    return lines.select("key", "seq", F.from_json("payload", fields).alias("p")).where("p.type IS NOT NULL").select("key", "seq", "p.*")


def log_entries(events: DataFrame) -> DataFrame:
    """key, seq, entry: what a decoded event adds to a job's log; others are left out."""
    block, delta = F.col("event.content_block"), F.col("event.delta")
    path = F.element_at(F.split(F.element_at(block["input"], "file_path"), "/"), -1)
    tool = F.when(block["name"] == "Bash", F.concat(F.lit("Bash: "), F.substring(F.element_at(block["input"], "command"), 1, 80))).otherwise(F.concat_ws(" ", block["name"], path))
    number = lambda c, decimals: F.coalesce(printed(F.when(F.col("type") == "result", c), decimals), F.lit("null"))
    entry = (
        F.when((F.col("type") == "system") & (F.col("subtype") == "init"), F.concat(F.lit("init "), F.coalesce("model", F.lit("?"))))
        .when((F.col("type") == "system") & (F.col("subtype") == "status"), F.coalesce("status", F.lit("?")))
        .when((F.col("type") == "stream_event") & (block["type"] == "tool_use"), tool)
        .when((F.col("type") == "result") & F.coalesce("is_error", F.lit(False)), F.concat(F.lit("error "), F.substring("result", 1, 200)))
        .when(F.col("type") == "result", F.concat(number(F.col("duration_ms") / 1000, 1), F.lit("s $"), number(F.col("total_cost_usd"), 4)))
    )
    text = F.when((F.col("type") == "stream_event") & (delta["type"] == "text_delta"), delta["text"])
    return events.select("key", "seq", entry.alias("entry"), text.alias("text")).where("entry IS NOT NULL OR text IS NOT NULL")


class JobLog(StatefulProcessor):
    """Of each key: the last log entry, so that a repeated one isn't logged twice, and the tail of the running text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "entry string, preview string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        entry, preview = self.state.get() if self.state.exists() else (None, "")
        out = []
        events = pd.concat(list(rows)).sort_values("seq")
        for seq, new, text in zip(events["seq"], events["entry"], events["text"]):
            if isinstance(text, str):
                preview = (preview + text)[-PREVIEW:]
            if isinstance(new, str) and new != entry:
                entry = new
                out.append((key[0], seq, new, preview))
        self.state.update((entry, preview))
        yield pd.DataFrame(out, columns=["key", "seq", "entry", "preview"])

    def close(self) -> None:
        pass


def job_log(entries: DataFrame) -> DataFrame:
    """A stream of log entries without repetitions, each with the text so far."""
    return entries.groupBy("key").transformWithStateInPandas(JobLog(), "key string, seq long, entry string, preview string", "Append", "None")


class OneAtATime(StatefulProcessor):
    """One running job per key: a start is refused while one runs; a stop or an error ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("running", "id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        running = self.state.get()[0] if self.state.exists() else None
        out = []
        events = pd.concat(list(rows)).sort_values("seq")
        for seq, kind, job in zip(events["seq"], events["kind"], events["job"]):
            accepted = True
            if kind == "start":
                accepted = running is None
                running = job if accepted else running
            elif job == running:
                running = None
            else:
                accepted = False
            out.append((key[0], seq, kind, job, accepted))
        self.state.update((running,))
        yield pd.DataFrame(out, columns=["key", "seq", "kind", "job", "accepted"])

    def close(self) -> None:
        pass


def one_at_a_time(requests: DataFrame) -> DataFrame:
    """A stream of requests (key, seq, kind, job), each with whether it is accepted."""
    return requests.groupBy("key").transformWithStateInPandas(OneAtATime(), "key string, seq long, kind string, job string, accepted boolean", "Append", "None")


class Revisions(StatefulProcessor):
    """Compare and set: a write counts when it is based on the current revision, or forced."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("revision", "rev long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        current = self.state.get()[0] if self.state.exists() else 0
        out = []
        events = pd.concat(list(rows)).sort_values("seq")
        for seq, base, forced in zip(events["seq"], events["base"], events["forced"]):
            accepted = bool(forced) or base == current
            current += accepted
            out.append((key[0], seq, accepted, current))
        self.state.update((int(current),))
        yield pd.DataFrame(out, columns=["key", "seq", "accepted", "rev"])

    def close(self) -> None:
        pass


def revisions(writes: DataFrame) -> DataFrame:
    """A stream of writes (key, seq, base, forced), each with whether it counts and the revision after it."""
    return writes.groupBy("key").transformWithStateInPandas(Revisions(), "key string, seq long, accepted boolean, rev long", "Append", "None")


def windowed(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Extension: counts of each kind by event-time window, with late rows let in for a while."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path, change between two listings (path, changed_at): added, changed or gone."""
    old = previous.select("path", F.col("changed_at").alias("_before"))
    change = F.when(F.col("_before").isNull(), "added").when(F.col("changed_at").isNull(), "gone").when(F.col("changed_at") != F.col("_before"), "changed")
    return current.join(old, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def json_line(**fields: object) -> str:
    return json.dumps(fields)
