"""Token ids in files: canonical, length-limited Huffman codes from global counts, decoded by table in blocks.

A first pass stores every document's ids, compressed. Global counts of ids (one number per vocabulary entry, whatever
the data) give one canonical code. Documents are then ordered by doc_id over range partitions, and each task cuts its
run of them into shard images:

    magic "MHF1" | window bits, block ids, vocabulary size, documents, ids, blocks, payload bytes (uint64 each)
    | code length of each id (uint8) | doc_id and a null flag of each document (int64, uint8) | ids of each document (uint32)
    | bit offset of each block (uint64) | payload bits, most significant first

Each block of BLOCK ids starts at a checkpointed bit offset, so blocks decode independently: a table indexed by the next
window of bits gives id and length, and numpy steps through all blocks of a shard at once. Images are stored as rows
of a binary column, since only Spark's writers reach every store.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize, spread
from .carried import whole_numbers
from .words import encoder, texts_of

MAGIC = b"MHF1"
#: Longest code: the decoding table has 2 ** LIMIT entries.
LIMIT = 18
#: Ids of a block between checkpoints, and about as many ids as a shard holds.
BLOCK, SHARD_IDS = 256, 1 << 19
#: Ids of a range of documents, which a task sorts and writes.
TASK_IDS = 200_000_000
END_ID = 1


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits for ids that occur (0 for others), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # level by level: items are single ids (their place) or packages; only how many single ids a level takes is needed
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < n)
        merged = merged[place]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * (n - 1)
    depth = np.zeros(n, np.int64)
    for single in reversed(levels):
        ids = int(single[:take].sum())
        depth[:ids] += 1
        take = 2 * (take - ids)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    bits = lengths[order].astype(np.int64)
    if len(order):
        top = int(bits.max())
        step = (1 << (top - bits)).astype(np.int64)  # room that a code takes among codes of the longest length
        codes[order] = ((np.cumsum(step) - step) >> (top - bits)).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each value of the next ``limit`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    room = 1 << (limit - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.int64)
    total = int(room.sum())
    ids[:total] = np.repeat(order, room)
    bits[:total] = np.repeat(lengths[order], room)
    return ids, bits


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The payload, and the bit offset of each block. Eight spare bytes follow, for the decoder's look-ahead."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ends) else 0
    value = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
    word = at >> 5
    n = (total >> 5) + 2
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    return (high + low).astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8] + bytes(8), at[::BLOCK].astype("<u8")


def unpack_bits(payload: bytes, checkpoints: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray], limit: int) -> np.ndarray:
    """The ids, all blocks in step."""
    symbol, length = table
    raw = np.frombuffer(payload, np.uint8)
    words = np.zeros(len(raw), np.uint32)  # the four bytes from each byte on
    r = raw.astype(np.uint32)
    words[:-3] = r[:-3] << 24 | r[1:-2] << 16 | r[2:-1] << 8 | r[3:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((BLOCK, len(at)), np.uint32)
    mask, shift = np.uint32((1 << limit) - 1), 32 - limit
    last = len(raw) - 5
    for k in range(BLOCK):
        place = np.minimum(at >> 3, last)
        peek = (words[place] >> (shift - (at & 7)).astype(np.uint32)) & mask
        out[k] = symbol[peek]
        at = at + length[peek]
    return out.T.reshape(-1)[:count]


def write_image(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One shard."""
    payload, checkpoints = pack_bits(ids, codes, lengths)
    head = np.array([LIMIT, BLOCK, len(lengths), len(sizes), len(ids), len(checkpoints), len(payload)], "<u8")
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    missing = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, head.tobytes(), lengths.astype(np.uint8).tobytes(), names.tobytes(), missing.tobytes(), sizes.astype("<u4").tobytes(), checkpoints.tobytes(), payload])


_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def read_image(image: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids."""
    if image[:4] != MAGIC:
        raise ValueError("no shard image")
    limit, block, vocabulary, documents, count, blocks, size = (int(x) for x in np.frombuffer(image, "<u8", 7, 4))
    if block != BLOCK:
        raise ValueError("another block size")
    at = 4 + 56
    raw = image[at : at + vocabulary]
    if raw not in _tables:
        _tables.clear()
        _tables[raw] = decoding_table(np.frombuffer(raw, np.uint8), limit)
    at += vocabulary
    names = np.frombuffer(image, "<i8", documents, at).tolist()
    at += 8 * documents
    missing = image[at : at + documents]
    at += documents
    sizes = np.frombuffer(image, "<u4", documents, at).astype(np.int64)
    at += 4 * documents
    checkpoints = np.frombuffer(image, "<u8", blocks, at)
    at += 8 * blocks
    ids = unpack_bits(image[at : at + size], checkpoints, count, _tables[raw], limit) if count else np.zeros(0, np.uint32)
    return [None if m else d for d, m in zip(names, missing)], sizes, ids


class _Store:
    """Ids between passes: low bytes, then high bytes, compressed; the contexts last for a task."""

    def __init__(self) -> None:
        self.compress, self.decompress = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress

    def compact(self, ids: np.ndarray) -> bytes:
        return self.compress(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T.tobytes())

    def expand(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(self.decompress(data), np.uint8)
        return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def stored_ids(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, data (compressed ids with the end id): written once, since counts and the files' order both need it."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, store = encoder(vocabulary), _Store()
        for batch in batches:
            for a, b, ids, bounds in coder.encode(texts_of(batch.column(1))):
                ended = np.insert(ids, bounds[1:], end_id)
                at = bounds + np.arange(len(bounds))
                data = [store.compact(ended[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "data": pa.array(data, pa.binary())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(ids_of, "doc_id long, data binary")
    return materialize(rows, "ids", compression="uncompressed")


def global_counts(stored: DataFrame, vocabulary_size: int) -> np.ndarray:
    """How often each id occurs: as many numbers as the vocabulary has entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, expand = np.zeros(vocabulary_size, np.int64), _Store().expand
        for batch in batches:
            held, size = [], 0
            for data in batch.column(0):
                held.append(expand(data.as_py()))
                size += len(held[-1])
                if size > SHARD_IDS:
                    total += np.bincount(np.concatenate(held), minlength=vocabulary_size)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=vocabulary_size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    found = stored.select("data").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary_size, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return counts


def write_files(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of all documents: part, shard, before (ids of the part before it), n_ids, image; stored in the shared
    folder. Documents stand in ascending doc_id order, null first: parts are ranges of doc_id in order."""
    stored = stored_ids(docs, vocabulary, end_id, id_col, text_col)
    size = max(encoder(vocabulary).size, end_id + 1)
    counts = global_counts(stored, size)
    lengths = code_lengths(counts)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, expand = canonical_codes(lengths), _Store().expand
        part, shard, before, names, held, total = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            image = write_image(names, np.array([len(x) for x in held]), np.concatenate(held), lengths, codes)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([total], pa.int64()), "image": pa.array([image], pa.binary())})

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                held.append(expand(data.as_py()))
                total += len(held[-1])
                if total >= SHARD_IDS:
                    yield row()
                    shard, before, names, held, total = shard + 1, before + total, [], [], 0
        if names:
            yield row()

    partitions = spread(docs.sparkSession, int(counts.sum()), TASK_IDS)
    ordered = stored.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "data")
    return materialize(ordered.mapInArrow(images, "part int, shard int, before long, n_ids long, image binary"), "id-files", compression="uncompressed")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, sizes, ids = read_image(row["image"])
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64()), "start": pa.array(row["start"] + ends - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    # one row per range partition, whatever these hold
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return files.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("start"), "image").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens (with the end id), ids_crc32 of every row, after writing and reading the files.

    Null counts as empty: the end id alone. Rows of one doc_id stand together, ordered by their ids; null ids come
    first. Ids that aren't whole numbers raise a TypeError. Extra columns are ignored; an empty table
    gives an empty result.
    """
    whole_numbers(docs, id_col)
    return read_files(write_files(docs, vocabulary, end_id, id_col, text_col))
