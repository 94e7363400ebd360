"""Near-deduplication of whole corpora with wide SimHash fingerprints.

Texts with a similarity of 0.8 (Jaccard, five-word shingles) differ in about 15 % of fingerprint bits, far beyond what
equal blocks can find. So fingerprints have 256 bits here, buckets come from bands of minima of the same shingle hashes,
and the tiled exclusive-or and bit counts of ``simhash`` compare fingerprints inside each bucket. A bucket passes on the
spanning forest of its closest links, and their texts are compared exactly. Where such a link fails, the groups at its
ends are searched again: inside each family of linked texts, tile by tile, every pair of two groups within the radius is
compared exactly unless links found there join it already; components keep one document.

Two texts are compared if they share a band (or, in a family, without one), which those of similarity s miss with a probability of
(1 - s ** ROWS) ** BANDS: 0.0018 at 0.8, 0.0006 at 0.825, 0.0001 at 0.85; and if they are within RADIUS bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release, spread
from .carried import carried, restored
from .components import stars
from .simhash import TILE
from .words import in_slices, texts_of

SHINGLE, SIMILARITY = 5, 0.8
WORDS = 4  # of 64 bits
#: Six standard deviations above the mean distance of texts with similarity 0.8, in bits of 256.
RADIUS = 72
#: Minima of a band, and bands: texts with similarity 0.8 share one with a probability of 0.998.
ROWS, BANDS = 4, 12
SPLIT = 20_000
#: Band rows of a task.
TASK_ROWS = 2_000_000
#: Shingle hashes of a tile of texts that are compared exactly, and of a task.
BLOCK_HASHES, TASK_HASHES = 1 << 20, 1 << 23

_random = np.random.default_rng(20240117)
_MIX = _random.integers(0, 1 << 63, (WORDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _random.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, (ROWS * BANDS, 1), dtype=np.uint64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of lower-cased words (of a short text: the whole sequence); none without words."""
    from xxhash import xxh64_digest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    raw = b"".join([xxh64_digest(line[a : b - 1], 42) for a, b in zip([0, *ends], ends[min(shingle, len(words)) - 1 :])])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint (WORDS numbers) and the key of each band."""
    prints = np.zeros(WORDS, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WORDS):
            mixed = hashes * _MIX[i]
            raw = np.ascontiguousarray((mixed ^ (mixed >> np.uint64(31))).astype(">u8")).view(np.uint8).reshape(-1, 8)
            if len(raw) < 200:
                votes = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
            else:
                votes = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BITS for k in range(8)])
            prints[i] = np.frombuffer(np.packbits(2 * votes > len(raw)).tobytes(), ">u8")[0]
        least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(hashes), 4096):
            least = np.minimum(least, (hashes[None, a : a + 4096] * _MULTIPLY + _SHIFT).min(axis=1))
        keys = np.zeros(BANDS, np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            keys = (keys ^ row ^ (row >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return prints, keys


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (a hash of the text), prints, bands of every row; no bands for texts without words."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 2):
            prints, bands = [], []
            for text in texts_of(batch.column(2)):
                hashes = shingle_hashes(text)
                p, k = sketch(hashes)
                prints.append(p.view(np.int64))
                bands.append(k.view(np.int64) if len(hashes) else k[:0].view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "node": batch.column(1), "prints": pa.array(prints, pa.list_(pa.int64())), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return docs.select(id_col, _node(text_col), text_col).mapInArrow(run, f"doc_id {kind}, node long, prints array<long>, bands array<long>")


def _node(text_col: str):
    return F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("node")


def near_pairs(prints: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distance, left and right row of all pairs within the radius, tile pair by tile pair.

    ``prints``: rows of WORDS numbers, sorted by population count.
    """
    n = len(prints)
    counts = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    tiles = [slice(a, min(a + tile, n)) for a in range(0, n, tile)]
    for i, first in enumerate(tiles):
        for second in tiles[i:]:
            if counts[second.start] - counts[first.stop - 1] > radius:
                break
            apart = np.zeros((first.stop - first.start, second.stop - second.start), np.uint16)
            for k in range(WORDS):
                apart += np.bitwise_count(prints[first, None, k] ^ prints[None, second, k])
            if first is second:
                apart[np.tril_indices(len(apart))] = radius + 1
            x, y = np.nonzero(apart <= radius)
            yield apart[x, y], x + first.start, y + second.start


def closest_forest(prints: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """The minimum spanning forest of all links within the radius. Connectivity is kept at every smaller radius, too."""
    far, left, right = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for f, x, y in near_pairs(prints, radius, tile):
        far, left, right = _forest(np.concatenate([far, f]), np.concatenate([left, x]), np.concatenate([right, y]), len(prints))
    return left, right


def close_between(prints: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], tiles: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Links of similar texts that join the groups as all links within the radius would; a link whose ends are joined
    already is not compared. ``sets``: sorted shingle hashes. ``tiles``: only rows of different ones are compared."""
    order = np.argsort(np.bitwise_count(prints).sum(axis=1), kind="stable")
    sizes, root = np.array([len(s) for s in sets]), np.unique(groups, return_inverse=True)[1]
    left, right = [], []
    for _, x, y in near_pairs(prints[order]):
        x, y = order[x], order[y]
        may = (root[x] != root[y]) & (np.minimum(sizes[x], sizes[y]) >= SIMILARITY * np.maximum(sizes[x], sizes[y]))
        if tiles is not None:
            may &= tiles[x] != tiles[y]
        x, y = x[may], y[may]
        for others in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1) if len(x) else []:
            one, others = x[others[0]], y[others]
            others = others[root[others] != root[one]]
            if not len(others):
                continue
            theirs = np.concatenate([sets[o] for o in others])
            at = np.minimum(np.searchsorted(sets[one], theirs), sizes[one] - 1)
            found = np.concatenate([[0], np.cumsum(sets[one][at] == theirs)])
            ends = np.cumsum(sizes[others])
            both = found[ends] - found[ends - sizes[others]]
            others = others[both >= SIMILARITY * (sizes[one] + sizes[others] - both)]
            roots, first = np.unique(root[others], return_index=True)
            left += [one] * len(first)
            right += list(others[first])
            root[np.isin(root, roots)] = root[one]
    return left, right


def _forest(far: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spanning forest of the closest links, one distance after the other.

    Links between two sets are taken all at once where each set's root joins one smaller root, so none closes a ring.
    """
    parent, kept = np.arange(n), []
    for distance in np.unique(far):
        at = np.flatnonzero(far == distance)
        while True:
            a, b = parent[left[at]], parent[right[at]]
            apart = a != b
            at, a, b = at[apart], a[apart], b[apart]
            if not len(at):
                break
            roots, one = np.unique(np.maximum(a, b), return_index=True)
            kept.append(at[one])
            parent[roots] = np.minimum(a, b)[one]
            while (parent[parent] != parent).any():
                parent = parent[parent]
    chosen = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return far[chosen], left[chosen], right[chosen]


def _bucket_links(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The forest of each bucket. Rows are sorted by ``keys`` key columns, then population count; then node and the
    fingerprint's numbers."""

    def of(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        nodes = rows.column(keys).to_numpy()
        prints = np.stack([rows.column(keys + 1 + i).to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]).sum(axis=1) <= RADIUS]
        left, right = [near], [near + 1]
        for a, n in zip(cuts[:-1][sizes > 2], sizes[sizes > 2]):
            x, y = closest_forest(prints[a : a + n])
            left.append(x + a)
            right.append(y + a)
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes[np.concatenate(left)]), "b": pa.array(nodes[np.concatenate(right)])})

    return _whole(batches, keys, of)


def _close_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of ``close_between`` in each block of rows: family, low, high; then tile, node, group, prints, hashes."""

    def of(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        low, high, tiles, nodes, groups = (rows.column(i).to_numpy() for i in range(1, 6))
        left, right = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if (groups[a:b] == groups[a]).all():
                continue
            prints, hashes = (_lists(rows.column(i).slice(a, b - a)) for i in (6, 7))
            x, y = close_between(np.stack(prints), groups[a:b], hashes, tiles[a:b] if low[a] != high[a] else None)
            left += [a + i for i in x]
            right += [a + i for i in y]
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes[np.array(left, int)]), "b": pa.array(nodes[np.array(right, int)])})

    return _whole(batches, 3, of)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = pa.concat_arrays(column.chunks)
    return np.split(column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy())[:-1])


def _whole(batches: Iterator[pa.RecordBatch], keys: int, of: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``of`` (rows, where their buckets start and the last one ends) for runs of whole buckets: rows are contiguous by
    their ``keys`` first columns, and the last bucket of a batch may go on in the next one."""
    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        cuts = _cuts(held, keys)
        if len(cuts) > 2:
            yield of(held.slice(0, cuts[-2]), cuts[:-1])
            held = held.slice(cuts[-2])
    if held is not None and held.num_rows:
        yield of(held, _cuts(held, keys))


def _cuts(rows: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    for i in range(keys):
        column = rows.column(i).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [len(change)]])


def candidate_links(nodes: DataFrame, split: int = SPLIT, tile: int = TILE) -> DataFrame:
    """(a, b): the closest links of each bucket. ``nodes``: node, prints, bands. Large buckets are dealt out by tile pairs."""
    partitions = spread(nodes.sparkSession, BANDS * nodes.count(), TASK_ROWS)
    words = [F.col("prints")[i].alias(f"p{i}") for i in range(WORDS)]
    keyed = nodes.select("node", *words, F.posexplode("bands").alias("band", "bucket"))
    weight = sum((F.bit_count(f"p{i}") for i in range(1, WORDS)), F.bit_count("p0"))
    columns = ["node", *[f"p{i}" for i in range(WORDS)]]
    hot = materialize(keyed.groupBy("band", "bucket").count().where(F.col("count") > split), "hot-bands")
    large = not hot.isEmpty()
    usual = keyed.join(hot, ["band", "bucket"], "left_anti") if large else keyed
    dealt = usual.repartition(partitions, "band", "bucket").sortWithinPartitions("band", "bucket", weight).select("band", "bucket", *columns)
    found = dealt.mapInArrow(lambda b: _bucket_links(b, 2), "a long, b long")
    if large:
        own = _dealt(keyed.join(hot.withColumn("shares", F.ceil(F.col("count") / (8 * tile))), ["band", "bucket"]))
        own = own.select("band", "bucket", "low", "high", *columns)
        own = own.repartition(partitions, "band", "bucket", "low", "high").sortWithinPartitions("band", "bucket", "low", "high", weight)
        found = found.unionByName(own.mapInArrow(lambda b: _bucket_links(b, 4), "a long, b long"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row goes to the pairs (low, high) of its tile with every tile; there are ``shares`` tiles."""
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("shares"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    return rows.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))


def links_between(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of similar texts between different groups of one family. ``nodes``: node, family, group, prints.

    Texts are compared inside tasks, each of which holds two tiles of a family at most, so links that fail are never
    rows. Tiles of a family have BLOCK_HASHES shingle hashes, or 8 * TILE texts, about.
    """
    rows = nodes.join(sets, "node")
    shares = F.greatest(F.ceil(F.sum(F.size("hashes")) / BLOCK_HASHES), F.ceil(F.count(F.lit(1)) / (8 * TILE)), F.lit(1)).cast("long")
    families = materialize(rows.groupBy("family").agg(shares.alias("shares"), F.sum(F.size("hashes")).alias("size")), "families")
    dealt = families.agg(F.sum(F.col("size") * F.col("shares"))).first()[0] or 0
    own = _dealt(rows.join(families, "family")).select("family", "low", "high", "tile", "node", "group", "prints", "hashes")
    own = own.repartition(spread(nodes.sparkSession, dealt, TASK_HASHES), "family", "low", "high").sortWithinPartitions("family", "low", "high")
    return own.mapInArrow(_close_links, "a long, b long")


def similarity(one: str, other: str, shingle: int = SHINGLE) -> float:
    a, b = shingle_hashes(one, shingle), shingle_hashes(other, shingle)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def shingle_sets(links: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """node, hashes of the texts that links touch; each is cut into shingles once."""
    involved = materialize(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct(), "linked")
    texts = docs.select(_node(text_col), F.coalesce(text_col, F.lit("")).alias("text")).join(involved, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            sets = [shingle_hashes(t).view(np.int64) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    sets = materialize(texts.mapInArrow(run, "node long, hashes array<long>"), "linked-sets")
    release(involved)
    return sets


def judged(links: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, close): whether the texts of each link have a similarity of SIMILARITY or more."""
    pairs = links.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b", (both >= SIMILARITY * (F.size("x") + F.size("y") - both)).alias("close"))


def tied(nodes: DataFrame, docs: DataFrame, text_col: str, split: int = SPLIT) -> DataFrame:
    """(a, b): each node of a group but the smallest, tied to that one. ``nodes``: node, prints, bands.

    A bucket's forest leaves no link between groups untested unless one of its own links failed, and then both groups
    of the untested link have a failed one, and both lie in one family of the forest. So such groups are searched again,
    family by family, for all links within the radius.
    """
    forest = materialize(candidate_links(nodes, split), "candidate-links")
    sets = shingle_sets(forest, docs, text_col)
    tested = materialize(judged(forest, sets), "tested-links")
    groups = stars(tested.where("close"))
    failed = tested.where("NOT close").select("a", "b")
    for end in ("a", "b"):
        own = groups.select(F.col("a").alias(end), F.col("b").alias(f"{end}_group"))
        failed = failed.join(own, end, "left").withColumn(f"{end}_group", F.coalesce(f"{end}_group", end))
    between = failed.where("a_group <> b_group")
    opened = materialize(between.select(F.col("a_group").alias("group")).unionByName(between.select(F.col("b_group").alias("group"))).distinct(), "open-groups")
    if opened.isEmpty():
        release(forest, sets, tested, opened)
        return groups
    open_nodes = nodes.select("node", "prints")
    for name, ties in (("group", groups), ("family", stars(forest))):
        open_nodes = open_nodes.join(ties.select(F.col("a").alias("node"), F.col("b").alias(name)), "node", "left").withColumn(name, F.coalesce(name, "node"))
    open_nodes = materialize(open_nodes.join(opened, "group", "left_semi"), "open-nodes")
    fresh = materialize(links_between(open_nodes, sets), "links-between")
    found = stars(tested.where("close").select("a", "b").unionByName(fresh))
    release(forest, sets, tested, groups, opened, open_nodes, fresh)
    return found


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were, whatever their names: of each component the
    smallest doc_id.

    Equal texts are one node, whose smallest doc_id stands for it; rows that agree in doc_id and text stay or go
    together. Null counts as empty. Texts without words are near nothing but their equals. Null ids come after all
    others. An empty table stays empty.
    """
    marked = materialize(sketches(docs, id_col, text_col), "sketches")
    nodes = materialize(marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("first"), F.first("prints").alias("prints"), F.first("bands").alias("bands")), "nodes")
    groups = tied(nodes.select("node", "prints", "bands"), docs, text_col, split)
    members = groups.unionByName(groups.select(F.col("b").alias("a"), "b").distinct()).join(nodes.select(F.col("node").alias("a"), "first"), "a")
    best = materialize(members.groupBy("b").agg(F.min(F.struct("first", "a")).alias("best")), "keepers")
    losers = members.join(best, "b").where(F.col("a") != F.col("best.a")).select(F.col("a").alias("node"))
    lost = marked.join(losers, "node", "left_semi").select("doc_id", "node")
    copies = marked.join(nodes.select("node", "first"), "node").where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("doc_id", "node")
    dropped = materialize(lost.unionByName(copies).distinct(), "dropped")
    release(marked, nodes, groups, best)
    rows = carried(docs, id=F.col(id_col), own=_node(text_col))
    return restored(rows.join(dropped, rows["id"].eqNullSafe(dropped["doc_id"]) & (rows["own"] == dropped["node"]), "left_anti"))
