"""Events out of server-sent text that arrives in chunks cut anywhere.

A block ends with a blank line. What follows the last blank line of a chunk is carried over to the next chunk of the same
key, in a batch as in a stream, so events are the same however the text was cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import materialize

BREAK, PREFIX = "\n\n", "data:"


def payload(block: str) -> str | None:
    """What a block says, if it is a data block."""
    said = block.strip()
    return said[len(PREFIX) :].strip() or None if said.startswith(PREFIX) else None


def cut(rest: str, text: str) -> tuple[list[str], str]:
    """The payloads of the blocks that a chunk completes, and what is left over."""
    *blocks, left = (rest + text).split(BREAK)
    return [p for p in map(payload, blocks) if p is not None], left


def _events(rows: DataFrame) -> DataFrame:
    return rows.where(F.try_parse_json("data").isNotNull())


def frames(chunks: DataFrame) -> DataFrame:
    """Rows (key, seq, text) into key, seq, n, data: the JSON events of each key, by the chunk ``seq`` that completes them
    and, by ascending ``n``, in their order there. Broken JSON, other blocks and an unfinished end are left out; null texts
    are empty.

    Chunks are dealt out by ranges of key and seq, so a key that makes up most rows is read by many tasks. A task carries
    the remainder from chunk to chunk. What it can't settle is the text of its first key before the first blank line, which
    an earlier task began, and the text of its last key behind the last one: these edges, two rows a task at most, are
    joined in order afterwards.
    """
    kind = dict(chunks.dtypes)["key"]
    rows = chunks.select("key", F.col("seq").cast("long"), "text").repartitionByRange("key", "seq").sortWithinPartitions("key", "seq")
    read = rows.mapInArrow(_read, f"key {kind}, seq long, n long, data string, edge string").withColumn("task", F.spark_partition_id())
    stored = materialize(read, "frames")
    edges = stored.where("edge IS NOT NULL").select("task", "key", "seq", "data", "edge").repartition(1).sortWithinPartitions("task", F.col("edge") == "tail").select("key", "seq", "data", "edge")
    settled = stored.where("edge IS NULL").select("key", "seq", "n", "data")
    return _events(settled.unionByName(edges.mapInArrow(_joined, f"key {kind}, seq long, n long, data string")))


def _batch(rows: list[tuple], key: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, seq, n, data, edge of a task's chunks in order; ``edge`` says what isn't a payload but raw text: the ``head`` of
    the first key or the ``tail`` of the last one."""
    names = ["key", "seq", "n", "data", "edge"]
    key, seq, rest, runs, opened = None, None, "", 0, True
    for batch in batches:
        out = []
        for now, seq, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not runs or now != key:
                key, rest, runs = now, "", runs + 1
                opened = runs > 1  # a later key begins here, so its first block is whole
            if not opened:
                head, found, text = (rest + (text or "")).partition(BREAK)
                rest = "" if found else head
                opened = bool(found)
                if not found:
                    continue
                out.append((key, seq, 0, head, "head"))
            blocks, rest = cut(rest, text or "")
            out += [(key, seq, n + 1, p, None) for n, p in enumerate(blocks)]
        yield _batch(out, batch.column(0).type, names)
    if runs:
        yield _batch([(key, seq, 0, rest, "tail")], batch.column(0).type, names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of the blocks that span tasks. A head ends with a blank line, a tail goes on with the next edge."""
    key, rest = None, ""
    for batch in batches:
        out = []
        for now, seq, text, edge in zip(*(c.to_pylist() for c in batch.columns)):
            blocks, left = cut(rest if now == key else "", text + BREAK * (edge == "head"))
            out += [(now, seq, n - len(blocks), p) for n, p in enumerate(blocks)]
            key, rest = now, left
        yield _batch(out, batch.column(0).type, ["key", "seq", "n", "data"])


class Frames(StatefulProcessor):
    """Of each key: the text behind its last blank line."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rest", "rest string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        rest, out = (self.state.get()[0] if self.state.exists() else ""), []
        for seq, text in sorted((s, t or "") for part in rows for s, t in zip(part["seq"], part["text"])):
            blocks, rest = cut(rest, text)
            out += [(key[0], seq, n + 1, p) for n, p in enumerate(blocks)]
        self.state.update((rest,))
        yield pd.DataFrame(out, columns=["key", "seq", "n", "data"])

    def close(self) -> None:
        pass


def frame_stream(chunks: DataFrame) -> DataFrame:
    """The same over a stream of chunks: an event comes with the micro-batch that completes it. A key's chunks have to reach
    the stream in order, or at least within one micro-batch."""
    return _events(chunks.groupBy("key").transformWithStateInPandas(Frames(), "key string, seq long, n long, data string", "Append", "None"))
