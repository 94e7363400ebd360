"""Connected components of links by alternating large and small stars, as joins.

Every node is tied to the smallest node of its component. Links never meet in one task: the minimum of a node's
neighbours is an aggregate that is joined back, so that a hub's links stay splittable. Superseded tables are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release


def _minima(links: DataFrame) -> DataFrame:
    """Of each node ``a`` the smallest neighbour ``b``."""
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are tied to the smallest of its neighbours and itself."""
    both = _both_ways(links)
    return both.join(_minima(both), "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"), F.col("a").alias("hub")).where("a > hub AND a <> b").select("a", "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    minima = _minima(down)
    tied = down.join(minima, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
    return tied.unionByName(minima.select("a", F.col("least").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def stars(links: DataFrame) -> DataFrame:
    """``links``: two columns a, b of one orderable type. Returns (a, b): each node but the smallest of its component,
    tied to that one. Null ends and loops are no links. No links give no rows."""
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.isEmpty():
        return now
    before = None
    while (state := _state(now)) != before:
        before = state
        large = materialize(_large_star(now), "large-star")
        small = materialize(_small_star(large), "small-star")
        release(now, large)
        now = small
    return now
