"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of whole texts are made batch by batch; equal fingerprints become one row. Two fingerprints that differ in
at most RADIUS bits agree in all but RADIUS of any equal blocks, so they meet in a bucket of the agreeing blocks for
some choice of these; the number of blocks follows the number of fingerprints, which changes bucket sizes, not results.
Inside a bucket, fingerprints sorted by population count are cut into tiles; tile pairs are compared exactly by
exclusive-or and bit counts, and those whose counts differ beyond the radius are skipped. A tile pair passes on a
spanning forest of its links, never all pairs. Buckets above SPLIT rows are dealt out tile pair by tile pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, spread
from .components import stars
from .words import texts_of

RADIUS = 3
TILE = 512
#: Rows above which a bucket's tile pairs go to different tasks.
SPLIT = 20_000
#: Rows of all buckets of a task.
TASK_ROWS = 5_000_000
#: Fingerprints for which a number of blocks is chosen: buckets hold about this many at most on average.
BUCKET = 256

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, shingle: int = 3) -> bytes:
    """Eight bytes, most significant first. A bit is set if it is in over half the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_digest

    words = text.encode().lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_digest(line, 42)
    ends = list(accumulate([len(w) + 1 for w in words]))
    begins = [0, *ends]
    raw = np.frombuffer(b"".join([xxh64_digest(line[a : b - 1], 42) for a, b in zip(begins, ends[shingle - 1 :])]), np.uint8).reshape(-1, 8)
    n = len(raw)
    if n < 200:
        votes = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    else:
        votes = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BITS for k in range(8)])
    return np.packbits(2 * votes > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (the fingerprint as a long) of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(t, shingle) for t in texts_of(batch.column(1)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "print": pa.array(np.frombuffer(raw, ">i8").astype(np.int64))})

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, print long")


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """As signed 64-bit numbers: the bits of every choice of all but ``radius`` of the blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(choice) for choice in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(rows: int, radius: int = RADIUS) -> int:
    """The fewest blocks that leave BUCKET rows or fewer in an average bucket of random fingerprints."""
    blocks = radius + 1
    while rows / 2 ** (64 * (blocks - radius) // blocks) > BUCKET and blocks < radius + 5:
        blocks += 1
    return blocks


def union(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the sets of pairs; ``parent`` names the smallest member of each row's set, before and after."""
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        if not len(left):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def compare_tiles(prints: np.ndarray, parent: np.ndarray, first: slice, second: slice, radius: int = RADIUS) -> None:
    """All pairs between two tiles of uint64 fingerprints."""
    near = np.bitwise_count(prints[first, None] ^ prints[None, second]) <= radius
    left, right = np.nonzero(near)
    union(parent, left + first.start, right + second.start)


def link_group(prints: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """The smallest row that each row of a bucket is linked with; ``prints`` are sorted by population count."""
    n = len(prints)
    parent = np.arange(n)
    counts = np.bitwise_count(prints)
    tiles = [slice(a, min(a + tile, n)) for a in range(0, n, tile)]
    for i, first in enumerate(tiles):
        for second in tiles[i:]:
            if int(counts[second.start]) - int(counts[first.stop - 1]) > radius:
                break  # and so do all later tiles
            compare_tiles(prints, parent, first, second, radius)
    return parent


def _bits_of(column: Column) -> Column:
    return F.bit_count(column)


def _link_sorted(batches: Iterator[pa.RecordBatch], keys: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``keys`` key columns, then population count; the last column is the fingerprint."""

    def finish(table: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch | None:
        prints = table[-1].view(np.uint64)
        left, right = [], []
        sizes = np.diff(cuts)
        pairs = cuts[:-1][sizes == 2]
        near = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= radius]
        left.append(near + 1)
        right.append(near)
        for a, n in zip(cuts[:-1][sizes > 2], sizes[sizes > 2]):
            parent = link_group(prints[a : a + n], radius)
            moved = np.flatnonzero(parent != np.arange(n))
            left.append(moved + a)
            right.append(parent[moved] + a)
        left, right = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_pydict({"a": pa.array(table[-1][left]), "b": pa.array(table[-1][right])}) if len(left) else None

    held: list[np.ndarray] = []
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        change = np.zeros(len(held[0]), bool)
        for column in held[:keys]:
            change[1:] |= column[1:] != column[:-1]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            continue  # still in one bucket
        last = cuts[-1]
        if (out := finish([x[:last] for x in held], np.concatenate([[0], cuts]))) is not None:
            yield out
        held = [x[last:] for x in held]
    if held and len(held[0]) and (out := finish(held, np.array([0, len(held[0])]))) is not None:
        yield out


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, split: int = SPLIT, tile: int = TILE) -> DataFrame:
    """(a, b): a forest that links the same fingerprints as all pairs within the radius. ``distinct``: column print."""
    rows = distinct.count()
    masks = block_masks(blocks or blocks_for(rows, radius), radius)
    partitions = spread(distinct.sparkSession, len(masks) * rows, TASK_ROWS)
    keyed = distinct.select("print", F.posexplode(F.array(*[F.lit(m).bitwiseAND(F.col("print")) for m in masks])).alias("choice", "bucket"))
    sizes = materialize(keyed.groupBy("choice", "bucket").count().where(F.col("count") > split), "hot-buckets")
    usual = keyed
    found = None
    if not sizes.isEmpty():
        usual = keyed.join(sizes, ["choice", "bucket"], "left_anti")
        found = _links_of_large(keyed.join(sizes, ["choice", "bucket"]), radius, tile, partitions)
    near = usual.repartition(partitions, "choice", "bucket").sortWithinPartitions("choice", "bucket", _bits_of(F.col("print"))).select("choice", "bucket", "print")
    pairs = near.mapInArrow(lambda batches: _link_sorted(batches, 2, radius), "a long, b long")
    return pairs if found is None else pairs.unionByName(found)


def _links_of_large(rows: DataFrame, radius: int, tile: int, partitions: int) -> DataFrame:
    """Buckets dealt out by tile pairs: a tile holds one population count and one share of it, by a hash."""
    share = F.greatest(F.lit(1), F.ceil(F.col("count") / (8 * tile))).cast("long")
    own = rows.withColumns({"bits": _bits_of(F.col("print")).cast("long"), "shares": share})
    own = own.withColumn("tile", F.col("bits") * F.col("shares") + F.pmod(F.xxhash64("print"), F.col("shares")))
    other = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("bits") - radius) * F.col("shares"), (F.least(F.lit(64).cast("long"), F.col("bits") + radius) + 1) * F.col("shares") - 1)
    dealt = own.withColumn("other", F.explode(other)).select("choice", "bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "print")
    dealt = dealt.repartition(partitions, "choice", "bucket", "low", "high").sortWithinPartitions("choice", "bucket", "low", "high", _bits_of(F.col("print")))
    return dealt.mapInArrow(lambda batches: _link_sorted(batches, 4, radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every row.

    component_id is the smallest doc_id that is reachable over fingerprints within ``radius`` bits. Null, empty and
    blank texts have fingerprint zero, which is linked like any other. Null doc_ids belong to components but don't name
    them. Repeated rows repeat; extra columns are ignored; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "prints")
    distinct = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-prints")
    tied = stars(links(distinct.select("print"), radius, **how))
    members = materialize(tied.unionByName(tied.select(F.col("b").alias("a"), "b").distinct()), "members")
    named = members.join(distinct, members["a"] == distinct["print"]).select("a", "b", "first")
    least = materialize(named.groupBy("b").agg(F.min("first").alias("component_id")), "components")
    label = members.join(least, "b").select(F.col("a").alias("print"), "component_id")
    by_print = materialize(distinct.join(label, "print", "left").select("print", F.coalesce("component_id", "first").alias("component_id")), "labels")
    return prints.join(by_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
