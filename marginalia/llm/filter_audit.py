"""How filters overlap: what each removes in every order, and its Shapley value.

Every text is reduced to a mask of the filters it fails, and masks are counted by part of the corpus: that is all an audit
needs. The orders of the filters are then visited by single swaps of neighbours (Steinhaus, Johnson and Trotter). A swap
of the filters at two steps changes what these two steps remove and nothing else, so two steps are taken anew from the
mask cells; each filter's removals are added up along the walk, which gives its Shapley value times the number of orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Filters in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS = 200
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_failures(text: Column) -> list[Column]:
    """Of a text alone: A few words, B few distinct words, C many capitals, D markup characters."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One narrow row per row: doc_id, part (null as empty), digest of the text (null as empty), mask of the filters that
    look at the text alone."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    mask = sum((F.coalesce(fails, F.lit(False)).cast("int") * (1 << k) for k, fails in enumerate(own_failures(F.col("text")))), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def marks(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, good, toxic: whether any label row of the document says 1."""
    return labels.groupBy(F.col(id_col).alias("doc_id")).agg(*[F.max((F.coalesce(F.col(c) == 1, F.lit(False))).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: rows by the filters they fail, E (equal to a smaller id's text) included.

    Rows of a text are first counted by part and label, and only the smallest id of each count goes on: a text that makes
    up a third of all rows is a handful of rows where its smallest id is settled.
    """
    rows = failures(docs, id_col, text_col, part_col).join(marks(labels, id_col), "doc_id", "left")
    rows = rows.select("doc_id", "part", "digest", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    each = rows.groupBy("digest", "doc_id", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("c"))
    named = F.col("doc_id").isNotNull()
    groups = each.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum(F.when(named, F.col("c")).otherwise(0)).alias("named"), F.sum(F.when(~named, F.col("c")).otherwise(0)).alias("unnamed"), F.min(F.when(named, F.struct("doc_id", "c"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    spared = F.coalesce(F.when(F.col("first.doc_id") == least, F.col("first.c")), F.lit(0))
    groups = groups.select("part", "mask", "good", "toxic", F.col("named").alias("named"), "unnamed", spared.alias("spared"))
    bit = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), (F.col("spared") + F.col("unnamed")).alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("named") - F.col("spared")).alias("n"))))
    return groups.select("part", "good", "toxic", split.alias("x")).groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def neighbour_swaps(n: int) -> Iterator[int]:
    """Places k, one per step of the walk: swapping k and k + 1 leads from each order to the next, through all of them."""
    order, way = list(range(n)), [-1] * n
    while True:
        movable = [x for k, x in enumerate(order) if 0 <= k + way[x] < n and order[k + way[x]] < x]
        if not movable:
            return
        x = max(movable)
        k = order.index(x)
        yield min(k, k + way[x])
        order[k], order[k + way[x]] = order[k + way[x]], x
        for y in range(x + 1, n):
            way[y] = -way[y]


class Walk:
    """Orders of the filters over the cells of one part. ``counts``: a row (n, good, toxic) for each mask."""

    def __init__(self, counts: np.ndarray, filters: str = FILTERS):
        self.counts, self.filters = counts, filters
        self.order = list(range(len(filters)))
        self.bits = [(np.arange(len(counts)) >> f & 1).astype(bool) for f in self.order]
        self.steps = [self.step(k) for k in self.order]
        self.now = [self.steps[f][0][0] for f in self.order]  # what each filter removes in this order
        self.shapley = list(self.now)
        self.alone = [int(counts[1 << f, 0]) for f in self.order]

    def step(self, k: int) -> tuple[np.ndarray, int]:
        """(removed, good lost, toxic lost) of step ``k`` in the present order, and what an earlier filter has removed of
        what it would remove."""
        gone = np.zeros(len(self.counts), bool)
        for f in self.order[:k]:
            gone |= self.bits[f]
        hit = self.bits[self.order[k]]
        return self.counts[hit & ~gone].sum(0), int(self.counts[hit & gone, 0].sum())

    def rows(self) -> Iterator[tuple]:
        """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost of the present order."""
        name, left = "".join(self.filters[f] for f in self.order), int(self.counts[:, 0].sum())
        for k, (lost, redundant) in enumerate(self.steps):
            left -= int(lost[0])
            yield name, k + 1, left, int(lost[0]), redundant, self.alone[self.order[k]], int(lost[1]), int(lost[2])

    def swap(self, k: int) -> None:
        """Go to the next order; only steps ``k`` and ``k + 1`` change."""
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]
        for j in (k, k + 1):
            self.steps[j] = self.step(j)
            self.now[self.order[j]] = self.steps[j][0][0]
        self.shapley = [a + b for a, b in zip(self.shapley, self.now)]

    def table(self) -> pd.DataFrame:
        out = list(self.rows())
        for k in neighbour_swaps(len(self.filters)):
            self.swap(k)
            out += self.rows()
        frame = pd.DataFrame(out, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
        frame["shapley"] = [int(self.shapley[self.filters.index(order[step - 1])]) for order, step in zip(frame.filter_order, frame.step)]
        return frame


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, with what is kept, removed, redundant, failed by this filter
    only, lost of good and of toxic documents, and the filter's removals summed over all orders.

    Whole texts are read, however long. Null texts are empty, a null part is the empty one. A document is good or toxic if any of its label rows says so. Rows
    that repeat a doc_id count each, and none makes another a copy; rows without a doc_id are never copies. Extra columns
    are ignored. An empty table has no parts and gives no rows. A part is at most 32 cells when it reaches its task.
    """

    def orders(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(FILTERS), 3), np.int64)
        counts[rows["mask"].to_numpy()] = rows[["n", "good", "toxic"]].to_numpy()
        return Walk(counts).table().assign(part=part[0])

    counted = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return cells(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(lambda part, rows: orders(part, rows)[names], f"part string, filter_order string, step int, {counted}")
