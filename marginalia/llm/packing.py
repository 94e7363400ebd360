"""Packing documents into training windows by the sum-of-squares rule.

A document's ids fill whole windows first; the rest, shorter than a window, is placed online: among the fill levels
that it fits, and a new window, the one that minimises the sum over levels of the squared number of partially filled
windows. Those numbers are kept in a level array. Each task packs its own documents; what is still open at its end is
cut anew into full windows, so a task leaves one partial window at most. Documents may be cut, since the windows'
pieces name their place in the document.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .words import encoder, in_slices, texts_of

WINDOW = 1024
END_ID = 0


class SumOfSquaresPacker:
    """Open windows by fill level. ``place`` gives the level to fill on top of: 0 is a new window."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.open = np.zeros(window + 1)  # partially filled windows of each level
        self.open[window] = -0.5  # a window that becomes full adds no square
        self.at_level: dict[int, list[list]] = defaultdict(list)

    def best_level(self, size: int) -> int:
        """Filling level h changes the sum by 2 (n[h + size] - n[h]) + 2; a new window by 2 n[size] + 1."""
        top = self.window - size
        here, then = self.open[1 : top + 1], self.open[size + 1 : self.window + 1]
        if len(here):
            change = np.where(here > 0, then - here, np.inf)
            at = len(change) - 1 - int(change[::-1].argmin())  # of equals the fullest
            if change[at] <= self.open[size] - 0.5:
                return at + 1
        return 0

    def place(self, size: int, item: object) -> list | None:
        """Put an item into a window; the window's items if it is full now."""
        level = self.best_level(size)
        items = []
        if level:
            items = self.at_level[level].pop()
            self.open[level] -= 1
        items.append(item)
        if level + size == self.window:
            return items
        self.at_level[level + size].append(items)
        self.open[level + size] += 1
        return None

    def drain(self) -> list[list]:
        """What is still open, fullest first."""
        return [items for level in sorted(self.at_level, reverse=True) for items in self.at_level[level]]


def pack_task(documents: Iterator[tuple[object, np.ndarray]], window: int = WINDOW) -> Iterator[tuple]:
    """(doc_id, start, length, crc, document's ids, window, offset) of each piece; windows count from 0."""
    packer, number = SumOfSquaresPacker(window), 0

    def pieces(items: list[tuple], number: int) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in items:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset
            offset += len(ids)

    for doc, ids in documents:
        n = len(ids)
        whole = n - n % window
        for start in range(0, whole, window):
            yield from pieces([(doc, start, ids[start : start + window], n)], number)
            number += 1
        if whole < n and (full := packer.place(n - whole, (doc, whole, ids[whole:].copy(), n))):
            yield from pieces(full, number)
            number += 1
    row, used = [], 0
    for doc, start, ids, total in (x for items in packer.drain() for x in items):
        while len(ids):
            part = ids[: window - used]
            row.append((doc, start, part, total))
            used, start, ids = used + len(part), start + len(part), ids[len(part) :]
            if used == window:
                yield from pieces(row, number)
                row, used, number = [], 0, number + 1
    if row:
        yield from pieces(row, number)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone. sequence_id counts from 0 without gaps, and so do offsets in
    a sequence. Repeated rows are packed as often as they occur; extra columns are ignored; an empty table gives none.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = encoder(vocabulary)

        kinds: list[pa.DataType] = []

        def documents() -> Iterator[tuple[object, np.ndarray]]:
            for batch in in_slices(batches, 1):
                kinds[:] = [batch.column(0).type]
                names, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
                for a, b, ids, bounds in coder.encode(texts):
                    for i in range(a, b):
                        yield names[i], np.append(ids[bounds[i - a] : bounds[i - a + 1]], end_id).astype("<u4")

        columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset")
        rows: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(x, pa.int64() if i else kinds[0]) for i, x in enumerate(zip(*rows))]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), *arrays], ["part", *columns])

        for piece in pack_task(documents(), window):
            rows.append(piece)
            if len(rows) == 20_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    schema = f"part int, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long"
    pieces = materialize(docs.select(id_col, text_col).mapInArrow(run, schema), "pieces")
    used = pieces.groupBy("part").agg((F.max("window") + 1).alias("windows"))
    before = used.select("part", F.coalesce(F.sum("windows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row per task of the scan, whatever the documents hold
    return pieces.join(F.broadcast(before), "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("window")).alias("sequence_id"), "offset")
