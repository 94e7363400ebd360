"""Ranked lexical search by Block-Max WAND over an index of compressed posting blocks.

The index is a table. Documents are dealt to segments as the scan meets them; a segment has a row for its documents and a
row for every block of at most 128 postings of a term, with the block's first and last document, its largest impact and
the postings as variable-length bytes. Any number of searches may read it.

A search sends the blocks of the wanted terms to one task a segment. There, the block pointers of a query's terms move
without looking into blocks ("shallow" moves): between two block borders the best score that any document can reach is the
sum of the largest impacts of the blocks that lie over it. Stretches of documents whose sum is below the query's threshold,
the score of the tenth best document that the task has seen in this and earlier segments, are passed over, and a block
that lies over no other stretch is never decompressed. Sparse lists then move from document to document and so name the
pivots; dense blocks are decompressed only where they can lift a pivot over the threshold. All shallow moves of a query in
a segment are one cumulative sum over its borders, all decompression is one pass over bytes: nothing loops over postings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize, spread
from .carried import whole_numbers

# The score's scale and the characters that terms lack.
SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE = 1_000_000_000, 1000, 8, 90
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]

BLOCK = 128
#: A segment is closed at so many postings or documents: bounds what a task holds, while searches see all segments.
SEGMENT_POSTINGS, SEGMENT_DOCS = 1_500_000, 65_536
#: Bytes of text that are cut into terms at once.
SLICE_BYTES = 2_000_000
#: Item and term pairs that a search broadcasts at once; more items are searched in turns.
PAIRS = 250_000
#: Documents of the most promising stretches that give a query its first threshold in a segment.
PRIMERS = 64
#: A block that spans so many times as many documents as it has postings is sparse.
SPARSE = 8
INDEX = "segment long, term binary, first int, last int, peak long, size int, data binary"

#: Of each byte of UTF-8 the byte in a term, with A-Z in lower case; 0 for bytes between terms.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[ord("A") : ord("Z") + 1] += 32
FOLDED[SEPARATORS] = 0


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, and for each the place of its text. Null texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    bounds = bounds - (bounds[0] if len(bounds) else 0)
    folded = FOLDED[raw]
    inside = folded > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(raw)]
    starts[heads] = inside[heads]
    where = np.flatnonzero(starts)
    begins = np.append((np.cumsum(inside, dtype=np.int64) - 1)[where], inside.sum())
    words = pa.Array.from_buffers(pa.large_binary(), len(where), [None, pa.py_buffer(begins.astype(np.int64).tobytes()), pa.py_buffer(folded[inside].tobytes())])
    return words, np.searchsorted(bounds, where, side="right") - 1


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of text (its last column), or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents that have a term, and all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, of = terms_of(part.column(0))
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(np.unique(of))], pa.int64()), "l": pa.array([len(of)], pa.int64())})

    found = docs.select(text_col).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return found[0] or 0, found[1] or 0


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 on in bytes of seven bits, lowest first, the eighth set where more follow; and their ends."""
    length = 1 + sum(((values >> 7 * k) > 0).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(length)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(5):
        has = length > k
        out[(ends - length)[has] + k] = (values[has] >> 7 * k & 127) | ((length[has] > k + 1).astype(np.int64) << 7)
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.append(0, ends[:-1] + 1)
    shift = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * shift, starts)


def impacts(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a term that occurs ``counts`` times adds to a document's score, before its weight."""
    return SCALE * counts // (TF_SCALE * counts + LENGTH_SCALE * norms)


class Segment:
    """Documents of one scan task on their way into the index."""

    def __init__(self, size: tuple[int, int]):
        self.documents, self.terms = size
        self.ids: list = []
        self.norms: list[int] = []
        self.words: list[pa.Array] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.distinct = 0

    def add(self, ids: list, texts: pa.Array) -> None:
        words, of = terms_of(texts)
        if not len(words):
            return
        lengths = np.bincount(of, minlength=len(ids))
        there = np.flatnonzero(lengths)
        number = np.zeros(len(ids), np.int64)
        number[there] = np.arange(len(there)) + len(self.ids)
        coded = words.dictionary_encode()
        key, counts = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + of, return_counts=True)
        self.postings.append((key // len(ids) + self.distinct, number[key % len(ids)], counts))
        self.words.append(coded.dictionary)
        self.distinct += len(coded.dictionary)
        self.held += len(key)
        self.ids += [ids[k] for k in there]
        base = 100 - LENGTH_SHARE
        self.norms += [base + LENGTH_SHARE * n * self.documents // self.terms for n in lengths[there].tolist()]

    def rows(self, number: int) -> pa.RecordBatch:
        """The row of documents (no term) and the blocks of all terms, ordered by term."""
        coded = pa.chunked_array(self.words).combine_chunks().dictionary_encode()
        rank = pc.array_sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        term, doc, count = (np.concatenate(x) for x in zip(*self.postings))
        term = place[coded.indices.to_numpy(zero_copy_only=False)[term]]
        order = np.lexsort((doc, term))
        term, doc, count = term[order], doc[order], count[order]
        new = np.append(True, np.diff(term) > 0)
        at = np.arange(len(term))
        starts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % BLOCK == 0)
        ends = np.append(starts[1:], len(term))
        norms = np.array(self.norms, np.int64)
        pairs = np.empty(2 * len(term), np.int64)
        pairs[0::2], pairs[1::2] = np.diff(doc, prepend=0), count
        pairs[2 * starts] = 0
        raw, byte_ends = packed(pairs)
        cuts = np.append(0, byte_ends[2 * ends - 1]).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw.tobytes())])
        unnamed = np.array([i is None for i in self.ids], np.uint8)
        head = norms.tobytes() + np.array([i or 0 for i in self.ids], np.int64).tobytes() + unnamed.tobytes()
        blocks = {
            "segment": pa.array(np.full(len(starts), number)), "term": coded.dictionary.take(pa.array(rank[term[starts]])).cast(pa.binary()), "first": pa.array(doc[starts], pa.int32()), "last": pa.array(doc[ends - 1], pa.int32()),
            "peak": pa.array(np.maximum.reduceat(impacts(count, norms[doc]), starts)), "size": pa.array(ends - starts, pa.int32()), "data": data,
        }
        header = {"segment": [number], "term": [None], "first": [0], "last": [len(self.ids) - 1], "peak": [0], "size": [len(self.ids)], "data": [head]}
        schema = pa.schema([(name, column.type) for name, column in blocks.items()])
        table = pa.concat_tables([pa.Table.from_pydict(header, schema), pa.Table.from_pydict(blocks, schema)])
        return table.combine_chunks().to_batches()[0]


def build(docs: DataFrame, size: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows of ``docs``; ``size`` as of ``corpus_size``. Rows without terms are not in it."""
    whole_numbers(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segment = TaskContext.get().partitionId() << 32, Segment(size)
        for batch in batches:
            for part in slices(batch):
                segment.add(part.column(0).to_pylist(), part.column(1))
                if segment.held >= SEGMENT_POSTINGS or len(segment.ids) >= SEGMENT_DOCS:
                    yield segment.rows(number)
                    number, segment = number + 1, Segment(size)
        if segment.ids:
            yield segment.rows(number)

    return docs.select(id_col, text_col).mapInArrow(run, INDEX)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id and term, once each."""
    kind = dict(items.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, of = terms_of(part.column(1))
                yield pa.RecordBatch.from_pydict({"item_id": part.column(0).take(pa.array(of)), "term": words.cast(pa.binary())})

    return items.select(id_col, text_col).mapInArrow(run, f"item_id {kind}, term binary").distinct()


class Blocks:
    """The wanted blocks of a segment, and what has been decompressed of them."""

    def __init__(self, table: pa.Table, weights: np.ndarray):
        column = {name: table.column(name).combine_chunks() for name in table.column_names}
        array = {name: column[name].to_numpy(zero_copy_only=False) for name in ("no", "first", "last", "peak", "size")}
        head = column["data"][0].as_buffer()
        n = int(array["size"][0])
        self.norms, self.ids, self.unnamed = np.frombuffer(head, np.int64, n), np.frombuffer(head, np.int64, n, 8 * n), np.frombuffer(head, np.uint8, n, 16 * n)
        self.term, self.first, self.last, self.size = (array[k][1:].astype(np.int64) for k in ("no", "first", "last", "size"))
        self.weight = weights[self.term]
        self.bound = self.weight * array["peak"][1:]
        self.data = column["data"].slice(1)
        self.from_row = np.append(0, np.cumsum(self.size))
        self.doc, self.gain = np.empty(self.from_row[-1], np.int64), np.empty(self.from_row[-1], np.int64)
        self.open = np.zeros(len(self.size), bool)
        self.score = np.zeros(n, np.int64)

    def of(self, terms: np.ndarray) -> np.ndarray:
        """The places of all blocks of some terms."""
        return ranges(np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, side="right"))

    def decompress(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        values = unpacked(np.concatenate([np.frombuffer(self.data[b].as_buffer(), np.uint8) for b in blocks.tolist()]))
        size = self.size[blocks]
        run = np.cumsum(values[0::2])
        begin = np.cumsum(size) - size
        doc = run - np.repeat(run[begin] - self.first[blocks], size)
        to = ranges(self.from_row[blocks], self.from_row[blocks + 1])
        self.doc[to] = doc
        self.gain[to] = impacts(values[1::2], self.norms[doc]) * np.repeat(self.weight[blocks], size)
        self.open[blocks] = True

    def scores(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of some blocks and the sums of their terms' gains."""
        self.decompress(blocks)
        at = ranges(self.from_row[blocks], self.from_row[blocks + 1])
        docs = self.doc[at]
        np.add.at(self.score, docs, self.gain[at])
        docs = np.unique(docs)
        sums = self.score[docs]
        self.score[docs] = 0
        return docs, sums


def ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after the other."""
    sizes = ends - begins
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


class Best:
    """The ``k`` best documents of one item: highest score, then smallest id (none last)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def threshold(self) -> int:
        """Below it nothing can enter; a document that reaches it may by its id."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            chosen = np.lexsort((ids, unnamed, -scores))[: self.k]
            scores, unnamed, ids = scores[chosen], unnamed[chosen], ids[chosen]
        self.rows = sorted([*self.rows, *zip((-scores).tolist(), unnamed.tolist(), ids.tolist())])[: self.k]


class Stretches:
    """What lies over the documents of a segment: ``most`` is, from each border to the next, the sum of the bounds of the
    intervals there. All pointers make their shallow moves at once, as one cumulative sum over the borders."""

    def __init__(self, first: np.ndarray, last: np.ndarray, bound: np.ndarray):
        at = np.concatenate([first, last + 1])
        order = np.argsort(at, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.border = at[order]
        self.begin, self.end = place[: len(first)], place[len(first) :]
        self.width = np.diff(self.border)
        self.most = np.cumsum(np.concatenate([bound, -bound])[order])[:-1]

    def reaching(self, threshold: int) -> np.ndarray:
        return (self.width > 0) & (self.most >= threshold)

    def under(self, stretches: np.ndarray) -> np.ndarray:
        """The intervals that lie over any of some stretches."""
        before = np.append(0, np.cumsum(stretches))
        return before[self.end] > before[self.begin]

    def of(self, docs: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.border, docs, side="right") - 1


def search_segment(blocks: Blocks, terms: np.ndarray, best: Best) -> None:
    """Block-Max WAND of one item over one segment.

    First all lists stand on blocks. Of the blocks over promising stretches, the sparse ones, whose next document is far
    from the last one, are opened, and their lists stand on documents: these are the pivots, between which nothing but the
    dense blocks' bounds is left. Dense blocks are opened last, where a pivot together with them reaches the threshold.
    """
    mine = blocks.of(terms)
    if not len(mine):
        return
    over = Stretches(blocks.first[mine], blocks.last[mine], blocks.bound[mine])
    mine = mine[over.under(over.reaching(best.threshold))]
    if not len(mine):
        return
    sparse = blocks.last[mine] - blocks.first[mine] >= SPARSE * blocks.size[mine]
    dense, sparse = mine[~sparse], mine[sparse]
    blocks.decompress(sparse)
    at = ranges(blocks.from_row[sparse], blocks.from_row[sparse + 1])
    owner = np.concatenate([dense, np.repeat(sparse, blocks.size[sparse])])
    over = Stretches(np.concatenate([blocks.first[dense], blocks.doc[at]]), np.concatenate([blocks.last[dense], blocks.doc[at]]), np.concatenate([blocks.bound[dense], blocks.gain[at]]))

    def visit(stretches: np.ndarray) -> None:
        needed = np.unique(owner[over.under(stretches)])
        if len(needed):
            docs, sums = blocks.scores(needed)
            good = stretches[over.of(docs)] & (sums >= best.threshold)
            docs, sums = docs[good], sums[good]
            best.add(sums, blocks.unnamed[docs], blocks.ids[docs])

    promising = np.flatnonzero(over.reaching(best.threshold))
    promising = promising[np.argsort(-over.most[promising], kind="stable")]
    primers = np.zeros(len(over.most), bool)
    primers[promising[: np.searchsorted(np.cumsum(over.width[promising]), PRIMERS) + 1]] = True
    visit(primers)
    visit(over.reaching(best.threshold) & ~primers)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one segment each, from batches that are sorted by segment."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)] if len(number) else [0]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(0)[0] != batch.column(0)[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _found(index: DataFrame, pairs: DataFrame, documents: int, kind: str, k: int, parts: int) -> DataFrame:
    """item_id, doc_id, score: of every task the best documents of the items of ``pairs``, which are at most some PAIRS."""
    spark = index.sparkSession
    rows = pairs.collect()
    names = sorted({bytes(r["term"]) for r in rows})
    wanted = spark.createDataFrame([(name, n) for n, name in enumerate(names)], "term binary, no int")
    held = index.where("term IS NOT NULL").join(F.broadcast(wanted), "term").groupBy("no").agg(F.sum("size").alias("df")).collect()
    weights = np.zeros(len(names), np.int64)
    for r in held:
        weights[r["no"]] = weight(documents, r["df"])
    number = {name: n for n, name in enumerate(names)}
    of: dict[object, list[int]] = {}
    for r in rows:
        of.setdefault(r["item_id"], []).append(number[bytes(r["term"])])
    items = [(item, np.array(sorted(terms))) for item, terms in of.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for table in segments(batches):
            blocks = Blocks(table, weights)
            for (_, terms), found in zip(items, best):
                search_segment(blocks, terms, found)
        out = [(n, None if unnamed else i, -less) for n, found in enumerate(best) for less, unnamed, i in found.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int32(), pa.int64(), pa.int64()))], ["n", "doc_id", "score"])

    blocks = index.join(F.broadcast(wanted), "term", "left").where("term IS NULL OR no IS NOT NULL").select("segment", F.coalesce("no", F.lit(-1)).alias("no"), "first", "last", "peak", "size", "data")
    found = blocks.repartition(parts, "segment").sortWithinPartitions("segment", "no", "first").mapInArrow(run, "n int, doc_id long, score long")
    named = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(items)], f"n int, item_id {kind}")
    return found.join(F.broadcast(named), "n").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: of every item the ``k`` documents with the highest score above 0, all if there are
    fewer, equal scores by ascending doc_id (null last).

    Whole texts are read, however long. Null and empty texts have no term: such documents are never found, such items find nothing. Rows that repeat an item's
    id are one item with the terms of all; rows that repeat a doc_id are documents of their own and may both be found.
    Extra columns are ignored; empty tables give no rows. Items are searched in turns of about ``pairs`` pairs of item and
    term, so that what is broadcast stays bounded however many items there are.
    """
    size = corpus_size(docs, text_col)
    asked = materialize(item_terms(items, item_col, item_text_col), "item-terms")
    count = asked.count()
    kind = dict(asked.dtypes)["item_id"]
    if not size[0] or not count:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {dict(docs.dtypes)[id_col]}, score long")
    index = materialize(build(docs, size, id_col, text_col), "posting-blocks")
    parts = spread(docs.sparkSession, index.where("term IS NULL").count(), 4)
    turns = -(-count // pairs)
    turn = F.pmod(F.xxhash64("item_id"), F.lit(turns))
    found = reduce(DataFrame.unionByName, [_found(index, asked.where(turn == t), size[0], kind, k, parts) for t in range(turns)])
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", F.col("doc_id").cast(dict(docs.dtypes)[id_col]).alias("doc_id"), "score")
